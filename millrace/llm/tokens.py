"""Token ids and binary output: a wavelet matrix for each shard.

Documents are dealt out by ranges of their id and sorted; each task encodes its
texts and writes shards of about `shard_tokens` ids of whole documents. A shard
is one row of a Parquet table in the shared folder (so a task that is run again
leaves no half-written file): the documents' ids and token counts, and one
compressed file of bit-planes. The ids are not stored; the planes give access,
counting and lookup of occurrences through rank and select:

    "WMX1", levels (u8), tokens (u64), then for each level, most significant bit
    first: zeros (u64), ones before each block of 512 bits (u32 each), the bits
    (8 in a byte, most significant first).

Encoding: byte-level BPE splits before every run of white space that follows
something else, and where letters, digits and other signs meet, so a text is cut
there, each distinct piece (by 96 bits of hash) is given to the tokenizer once while it is remembered,
and the pieces' ids are laid end to end. A cut is made only where it surely
changes nothing; slices with a special token's string are cut at white space only.

Defined cases: null and empty texts are the end id alone; a null id comes first;
documents of equal id are ordered by text hash, then text; a document longer
than a shard is a shard of its own; an empty table writes no shard.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bytesfast import U64, byte_values, frugal, mix, powers, text_slices
from millrace.llm.keys import text_key, work_dir
from millrace.sources.work import small_batches

SHARD_TOKENS = 1 << 20
END = 0
BLOCK = 512
CACHE_WORDS = 1_500_000
MAGIC = b"WMX1"
V1, V2 = byte_values(31), byte_values(32)

_KIND = np.full(256, 5, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other sign, 4 apostrophe, 5 not ASCII
_KIND[:128] = 3
_KIND[9:14] = _KIND[32] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WaveletMatrix:
    """A sequence of non-negative integers as bit-planes."""

    def __init__(self, n: int, zeros: list[int], ranks: list[np.ndarray], planes: list[np.ndarray]):
        self.n, self.levels, self.zeros, self.ranks, self.planes = n, len(planes), zeros, ranks, planes

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        n, zeros, ranks, planes = len(cur), [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << level)) != 0
            packed = np.packbits(bit)
            per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
            ranks.append((np.cumsum(per) - per).astype(np.uint32))
            planes.append(packed)
            low = cur[~bit]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[bit]])
        return cls(n, zeros, ranks, planes)

    def to_bytes(self) -> bytes:
        parts = [MAGIC, struct.pack("<BQ", self.levels, self.n)]
        for z, r, p in zip(self.zeros, self.ranks, self.planes, strict=True):
            parts += [struct.pack("<Q", z), r.astype("<u4").tobytes(), p.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        levels, n = struct.unpack_from("<BQ", data, 4)
        at, zeros, ranks, planes = 13, [], [], []
        size, blocks = -(-n // 8), -(-n // BLOCK)
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            ranks.append(np.frombuffer(data, "<u4", blocks, at + 8))
            planes.append(np.frombuffer(data, np.uint8, size, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + size
        return cls(n, zeros, ranks, planes)

    def decode(self) -> np.ndarray:
        """All ids: planes from the least significant up, each undoing its level's stable partition."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for shift in range(self.levels):
            level = self.levels - 1 - shift
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            new = np.empty(self.n, kind)
            new[~bit] = cur[: self.zeros[level]]
            new[bit] = cur[self.zeros[level] :] | kind(1 << shift)
            cur = new
        return cur

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        block = i // BLOCK
        if block >= len(self.ranks[level]):
            return self.n - self.zeros[level]
        count = int(self.ranks[level][block]) + int(np.bitwise_count(self.planes[level][block * BLOCK // 8 : i // 8]).sum())
        return count + (int(self.planes[level][i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit = (int(self.planes[level][i // 8]) >> (7 - i % 8)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of symbol in [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value in a level."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def locate(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of symbol."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.levels - 1, -1, -1):
            bit = symbol >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i


def piece_starts(data: np.ndarray, off: np.ndarray, fine: bool = True) -> np.ndarray:
    """Where texts may be cut without a change of their ids; starts of texts that are not empty are among them.

    Before white space that follows something else; with `fine` also where ASCII (and Latin-1) letters, digits and
    other signs meet, but not after an apostrophe, between it and another sign, or next to any other character.
    """
    n = len(data)
    kind = _KIND[data]
    space = kind == 0
    cut = np.zeros(n, bool)
    cut[1:] = space[1:] & ~space[:-1]
    if n > 1 and (data >= 128).any():
        at = np.flatnonzero(cut)
        odd = at[data[at - 1] >= 128]  # white space beyond ASCII: C2 85, C2 A0, E1 9A 80, E2 80 .., E2 81 9F, E3 80 80
        two, three = data[odd - 2], data[np.maximum(odd - 3, 0)]
        cut[odd[(two == 0xC2) | (((two == 0x9A) | (two == 0x80) | (two == 0x81)) & (three >= 0xE1) & (three <= 0xE3))]] = False
        lead = np.flatnonzero(data[:-1] == 0xC3)  # letters, but for the signs of multiplication and division
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
    if fine and n > 1:
        a, b = kind[:-1], kind[1:]
        cut[1:] |= (a != b) & (a > 0) & (b > 0) & (a < 4) & (b < 5) & ~((a == 3) & (b == 4))
    first = off[:-1][np.diff(off) > 0]
    cut[first] = True
    return np.flatnonzero(cut)


class _Known:
    """Numbers of encoded pieces by two hashes of theirs, in sorted arrays of some 20 bytes a piece."""

    def __init__(self):
        self.levels = [tuple(np.zeros(0, t) for t in (U64, np.uint32, np.int64)) for _ in range(2)]  # large and seldom merged; small

    def find(self, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for kh, kv, number in self.levels:
            if len(kh):
                at = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
                same = (kh[at] == h) & (kv[at] == v)
                out[same] = number[at[same]]
        return out

    def add(self, h: np.ndarray, v: np.ndarray, number: np.ndarray) -> None:
        self.levels[1] = self._merged(self.levels[1], (h, v, number))
        if len(self.levels[1][0]) > 200_000:
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]

    @staticmethod
    def _merged(a, b):
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)


class Encoder:
    """Encodes slices of texts piece by piece, each distinct piece once while it is remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.levels = max(1, int(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        self.known = _Known()
        self.flat, self.begin = array("I", [END]), array("q", [0, 1])  # piece 0 is the end id

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; number of ids of each text)."""
        n = len(data)
        raw = data.tobytes()
        start = piece_starts(data, off, not any(x in raw for x in self.special))
        end = np.append(start[1:], n) if len(start) else start
        p, inv = powers(n + 1)
        pair = []
        for values in (V1, V2):
            total = np.zeros(n + 1, U64)
            np.cumsum(values[data] * p[:n], out=total[1:])
            pair.append(mix((total[end] - total[start]) * inv[start] + (end - start).astype(U64)))
        h, first, back = np.unique(pair[0], return_index=True, return_inverse=True)
        v = (pair[1][first] >> U64(32)).astype(np.uint32)
        if len(self.begin) > CACHE_WORDS:
            self._forget()
        place = self.known.find(h, v)
        new = np.flatnonzero(place < 0)
        if len(new):
            number = len(self.begin) - 1
            lo, hi = start[first[new]].tolist(), end[first[new]].tolist()
            for z in range(0, len(new), 10_000):
                some = [raw[x:y].decode() for x, y in zip(lo[z : z + 10_000], hi[z : z + 10_000], strict=True)]
                for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False):
                    self.flat.extend(e.ids)
                    self.begin.append(len(self.flat))
            place[new] = np.arange(number, number + len(new))
            self.known.add(h[new], v[new], place[new])
        begin, flat = np.array(self.begin, np.int64), np.array(self.flat, np.uint32)
        rows = np.searchsorted(start, off)
        index = np.insert(place[back], rows[1:], 0)
        count = begin[index + 1] - begin[index]
        total = np.cumsum(count)
        ids = flat[np.repeat(begin[index] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        ends = total[rows[1:] + np.arange(len(rows) - 1)]
        return ids, np.diff(np.concatenate([[0], ends]))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker, so what a task has encoded serves the next."""
    return Encoder(path)


_SHARD = "part int, shard int, levels int, n_tokens long, ids array<{kind}>, counts array<long>, file binary"


@frugal
def _encode_batches(it, path: str, most: int):
    from pyspark import TaskContext

    part, shard = TaskContext.get().partitionId(), 0
    encoder = _encoder(path)
    ids: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    names: list[pa.Array] = []
    held, kind = 0, None

    def row():
        file = WaveletMatrix.build(np.concatenate(ids), encoder.levels).to_bytes()
        doc, n = pa.concat_arrays(names), pa.array(np.concatenate(counts), pa.int64())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc, n)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([encoder.levels], pa.int32()), pa.array([held], pa.int64()), *lists, pa.array([file], pa.binary())], names=["part", "shard", "levels", "n_tokens", "ids", "counts", "file"])

    for batch in it:
        kind = batch.schema.field("k").type
        for a, b, data, off in text_slices(batch, "t", 2 << 20):
            got, n = encoder.encode(data, off)
            ids.append(got)
            counts.append(n)
            names.append(batch.column("k").slice(a, b - a))
            held += len(got)
            if held >= most:
                yield row()
                shard += 1
                ids, counts, names, held = [], [], [], 0
    if names:
        yield row()


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode and write all documents in ascending order of their ids."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    src = docs.select(docs[doc_id].alias("k"), text_key(t).alias("h"), t.alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartitionByRange(parts, F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h", "t").select("k", "t")
    kind = src.schema["k"].dataType.simpleString()
    ordered.mapInArrow(lambda it: _encode_batches(it, tokenizer, shard_tokens), _SHARD.format(kind=kind)).write.parquet(path)


@frugal
def _decode_batches(it):
    for batch in it:
        for i in range(batch.num_rows):
            ids = WaveletMatrix.from_bytes(batch.column("file")[i].as_py()).decode()
            counts = np.asarray(batch.column("counts")[i].values)
            wide = memoryview(ids.astype("<u4")).cast("B")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(wide[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(c)[i].as_py()), pa.int32()) for c in ("part", "shard")] + [batch.column("ids")[i].values, pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                names=["part", "shard", "k", "at", "n_tokens", "crc"],
            )


def read_shards(spark: SparkSession, path: str, doc_id: str = "doc_id") -> DataFrame:
    """A row for each document in the files: its id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    up = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = files.select("part", "shard", "n_tokens").withColumn("base", F.sum("n_tokens").over(up) - F.col("n_tokens"))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row for each written partition
    parts = parts.withColumn("first", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("all")).drop("all")
    before = before.join(parts, "part").select("part", "shard", (F.col("base") + F.col("first")).alias("base"))
    rows = files.select("part", "shard", "ids", "counts", "file").mapInArrow(_decode_batches, f"part int, shard int, k {kind}, at long, n_tokens long, crc long")
    return rows.join(before, ["part", "shard"]).select(F.col("k").alias(doc_id), (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards (to a new place in the shared folder where no path is given) and read them back."""
    spark = docs.sparkSession
    path = path or f"{work_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, doc_id, text, tokenizer, shard_tokens)
    return read_shards(spark, path, doc_id)
