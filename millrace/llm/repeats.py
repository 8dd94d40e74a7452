"""Removal of long byte repeats by bucket-pointer refinement, dealt out over minimiser buckets.

Every byte covered by a `length`-byte string (400) that starts anywhere else too
is removed. Whether a string is repeated needs its refined bucket only, so the
suffixes are refined to depth 400 and no further:

1. Initial q-gram buckets. Each 400-byte window has an anchor: the leftmost of
   its smallest-hashed 201-byte grams. The anchor's gram is the window's initial
   bucket; neighbouring windows with one anchor are one run, so a text has about
   one run for each 100 bytes. Equal windows have equal anchors at equal places.
2. A bucket with one run is a singleton and is settled: nothing in it repeats.
   Runs of equal content in a bucket are settled too: all their windows repeat.
3. What is left are buckets with runs of different content. One run of each
   content is refined there: 50-byte buckets of all its offsets, then rounds in
   which a position's new bucket is the sorted rank of its bucket identifier and
   of the identifier 50, 100, 200 bytes later, as updated by the round before;
   after three rounds equal identifiers are equal 400-byte strings.

Buckets go to tasks by hash, sorted, and are refined a few MB at a time. A
bucket with more than `hot_runs` different contents (a passage with thousands
of contexts) is not gathered: its windows are refined over all tasks, first by
their sub-buckets (the identifier of the first eighth), where windows alone in
one are settled, then by the identifiers of the whole window.

The same method finds passages that documents share: with words for bytes, 50
for 400, and equality that counts only between different documents.

Grouping is by 64-bit bucket and 64-bit content hash together. Documents are
named by id and text hash: rows equal in both have the same result, and count as
one document for shared passages.

Defined cases: null text is empty; texts under 400 bytes keep all; a repeat
within one document counts; matches do not cross documents; very long texts
are cut into overlapping pieces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesfast import SLICE_BYTES, U64, Words, byte_values, column_bytes, frugal, mix, powers, text_slices
from millrace.llm.keys import table, text_key
from millrace.sources.work import small_batches

LENGTH = 400
GRAM = 201
HOT_RUNS = 4096
BATCH_BYTES = 2 << 20
V1, V2 = byte_values(5), byte_values(6)
POS = U64((1 << 22) - 1)
WORDS, WORD_GRAM = 50, 13
IS_WORD = np.ones(256, bool)
IS_WORD[9:14] = IS_WORD[32] = False


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    p, inv = powers(n + 1)
    out = np.zeros(n + 1, U64)
    np.cumsum(values * p[:n], out=out[1:])
    return out, inv


class Bytes:
    """Texts as bytes."""

    length, gram, width = LENGTH, GRAM, 1

    @staticmethod
    def pieces(batch: pa.RecordBatch):
        """(first row, values of the symbols, offsets, symbols before them in the row) of parts of a batch; long rows come in overlapping pieces."""
        for a, b, data, off in text_slices(batch, "t"):
            if b - a == 1 and len(data) > SLICE_BYTES:
                step = SLICE_BYTES - (LENGTH - 1)
                for s in range(0, len(data) - (LENGTH - 1), step):
                    part = data[s : s + SLICE_BYTES]
                    yield a, part, np.array([0, len(part)]), s
            else:
                yield a, data, off, 0

    values = staticmethod(lambda x: V1[x])
    second = staticmethod(lambda x: V2[x])

    @staticmethod
    def rows(batch: pa.RecordBatch):
        """Symbols of all rows of a batch, and their offsets."""
        return column_bytes(batch.column("t"))

    @staticmethod
    def read(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint8)


class WordHashes:
    """Texts as hashes of their words (runs of what is not white space)."""

    length, gram, width = WORDS, WORD_GRAM, 8

    @staticmethod
    def hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(off) > 2 or len(data) <= SLICE_BYTES:
            w = Words(data, off, IS_WORD, V1)
            return w.hash, w.rows
        cuts = [0]  # one long row: by pieces that end between words
        white = np.flatnonzero(~IS_WORD[data])
        while len(data) - cuts[-1] > SLICE_BYTES:
            i = int(np.searchsorted(white, cuts[-1] + SLICE_BYTES // 2))
            if i == len(white):
                break
            cuts.append(int(white[i]))
        cuts.append(len(data))
        out = np.concatenate([Words(data[x:y], np.array([0, y - x]), IS_WORD, V1).hash for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        return out, np.array([0, len(out)])

    @staticmethod
    def pieces(batch: pa.RecordBatch):
        for a, _, data, off in text_slices(batch, "t"):
            x, rows = WordHashes.hashes(data, off)
            most = SLICE_BYTES // 8
            if len(rows) == 2 and len(x) > most:
                for s in range(0, len(x) - (WORDS - 1), most - (WORDS - 1)):
                    part = x[s : s + most]
                    yield a, part, np.array([0, len(part)]), s
            else:
                yield a, x, rows, 0

    values = staticmethod(lambda x: x)
    second = staticmethod(lambda x: mix(x + U64(0x1F83D9ABFB41BD6B)))

    @staticmethod
    def rows(batch: pa.RecordBatch):
        got = [WordHashes.hashes(data, off) for _, _, data, off in text_slices(batch, "t")]
        counts = np.concatenate([np.zeros(1, np.int64), *[np.diff(rows) for _, rows in got]])
        return np.concatenate([np.zeros(0, U64), *[x for x, _ in got]]), np.cumsum(counts)

    @staticmethod
    def read(x: bytes) -> np.ndarray:
        return np.frombuffer(x, U64)


def runs(data: np.ndarray, off: np.ndarray, unit=Bytes):
    """(row, start, windows, anchor offset of the first window, bucket, content hash) of the runs of a piece."""
    length, gram = unit.length, unit.gram
    n, w = len(data), length - gram + 1
    nw = n - length + 1
    if nw <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64, U64))
    total, inv = _sums(unit.values(data))
    g = mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
    m = len(g)
    packed = np.full(-(-m // w) * w, ~U64(0), U64)
    packed[:m] = (g & ~POS) | np.arange(m, dtype=U64)
    grid = packed.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(tail[:nw], head[w - 1 : w - 1 + nw]) & POS).astype(np.int64)
    rows = np.diff(off)
    whole = np.repeat(off[1:], rows)[:nw] >= np.arange(nw) + length
    cut = np.ones(nw, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = off[:-1]
    cut[first[first < nw]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, nw))
    start, size = start[whole[start]], size[whole[start]]
    total, _ = _sums(unit.second(data))
    content = mix((total[start + size + length - 1] - total[start]) * inv[start] + size.astype(U64))
    at = anchor[start]
    row = np.searchsorted(off, start, side="right") - 1
    return row, start - off[row], size, at - start, g[at], content


@frugal
def _run_batches(it, unit):
    for batch in it:
        for a, data, off, before in unit.pieces(batch):
            row, start, size, o, bucket, content = runs(data, off, unit)
            if unit is WordHashes and len(row):  # a document's own repeats do not count
                order = np.lexsort((start, o, size, content, bucket, row))
                same = np.ones(len(row), bool)
                same[1:] = np.any([x[order][1:] != x[order][:-1] for x in (row, bucket, content, size, o)], axis=0)
                row, start, size, o, bucket, content = (x[order[same]] for x in (row, start, size, o, bucket, content))
            take = pa.array(row + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), pa.array(content.view(np.int64)), pa.array(size.astype(np.int16)), pa.array(o.astype(np.int16)), batch.column("k").take(take), batch.column("h").take(take), pa.array((start + before).astype(np.int64))],
                names=["bucket", "content", "size", "o", "k", "h", "start"],
            )


@frugal
def _cut_batches(it, unit):
    """Symbols of the listed runs: text rows with arrays of runs in, a row for each run out."""
    for batch in it:
        data, off = unit.rows(batch)
        lists = batch.column("runs")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        n = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        row = np.repeat(np.arange(len(n)), n)
        start = np.asarray(flat.field("start"))
        size = np.asarray(flat.field("size")).astype(np.int64)
        lo = off[row] + start
        hi = lo + size + unit.length - 1
        for i in range(0, len(row), 4096):
            part = [data[x:y].tobytes() for x, y in zip(lo[i : i + 4096].tolist(), hi[i : i + 4096].tolist(), strict=True)]
            take = pa.array(row[i : i + 4096])
            yield pa.RecordBatch.from_arrays(
                [flat.field("bucket")[i : i + 4096], batch.column("k").take(take), batch.column("h").take(take), flat.field("start")[i : i + 4096], flat.field("alone")[i : i + 4096], flat.field("hot")[i : i + 4096], pa.array(part, pa.binary())],
                names=["bucket", "k", "h", "start", "alone", "hot", "bytes"],
            )


def refine(data: np.ndarray, valid: np.ndarray, length: int = LENGTH, owner: np.ndarray | None = None) -> np.ndarray:
    """For each position with `valid` (a whole window starts there): does its window stand elsewhere in data too (where
    another owner is, if owners are given)? data: bytes, or values of other symbols.

    Identifiers of depth q = length / 8, or the last that halving gives, are refined by those of q, 2q, 4q symbols
    later. A bucket of one position is settled, and its identifier stays as it is.
    """
    q = length
    while q % 2 == 0 and q > length // 8:
        q //= 2
    total, inv = _sums(V1[data] if data.dtype == np.uint8 else data)
    ident = np.zeros(len(data), np.int64)
    m = len(data) - q + 1
    _, ident[:m] = np.unique(mix((total[q:] - total[:-q]) * inv[:m]), return_inverse=True)
    depth = q
    while depth < length:
        last = length == 2 * depth
        pos = np.flatnonzero(valid) if last else np.arange(len(data) - 2 * depth + 1)
        many = np.bincount(ident)[ident[pos]] > 1
        open_ = pos[many]
        pair = ident[open_] * np.int64(len(data) + 1) + ident[open_ + depth]
        _, rank = np.unique(pair, return_inverse=True)
        new = np.arange(len(data), dtype=np.int64) + len(data)  # singletons: identifiers of their own
        new[open_] = rank
        ident = new
        if not last:
            _, ident = np.unique(ident, return_inverse=True)
        depth *= 2
    pos = np.flatnonzero(valid)
    out = np.zeros(len(data), bool)
    if len(pos):
        _, back, count = np.unique(ident[pos], return_inverse=True, return_counts=True)
        if owner is None:
            out[pos] = count[back] > 1
        else:
            order = np.argsort(back, kind="stable")
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            who = owner[pos][order]
            out[pos] = (np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first))[back]
    return out


def _spans_of(hit: np.ndarray):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


@frugal
def _refine_batches(it, unit):
    """Rows sorted by bucket in; spans of repeated symbols of the rows marked alone out."""
    held: list[tuple] = []
    size = 0

    def flush():
        if not held:
            return None
        lens = np.array([len(r[5]) // unit.width for r in held])
        data = unit.read(b"".join(r[5] for r in held))
        off = np.concatenate([[0], np.cumsum(lens)])
        valid = np.arange(len(data)) + unit.length <= np.repeat(off[1:], lens)
        owner = None
        if unit is WordHashes:
            numbers: dict[tuple, int] = {}
            owner = np.repeat([numbers.setdefault((r[1], r[2]), len(numbers)) for r in held], lens)
        found = refine(data, valid, unit.length, owner)
        k, h, lo, hi = [], [], [], []
        for i, r in enumerate(held):
            if r[4]:
                a, b = _spans_of(found[off[i] : off[i + 1]])
                k += [r[1]] * len(a)
                h += [r[2]] * len(a)
                lo += (a + r[3]).tolist()
                hi += (b + r[3] + unit.length - 1).tolist()
        held.clear()
        return k, h, lo, hi

    kind = None
    for batch in it:
        kind = batch.schema.field("k").type
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "k", "h", "start", "alone", "bytes")), strict=True):
            if size >= BATCH_BYTES and held[-1][0] != r[0]:
                got, size = flush(), 0
                yield pa.RecordBatch.from_arrays([pa.array(got[0], kind), *(pa.array(x, pa.int64()) for x in got[1:])], names=["k", "h", "lo", "hi"])
            held.append(r)
            size += len(r[5])
    if held:
        got = flush()
        yield pa.RecordBatch.from_arrays([pa.array(got[0], kind), *(pa.array(x, pa.int64()) for x in got[1:])], names=["k", "h", "lo", "hi"])


@frugal
def _window_batches(it, unit):
    """Hot buckets: a row for each window, with its sub-bucket and two identifiers of the whole."""
    length, q = unit.length, max(1, unit.length // 8)
    for batch in it:
        for i in range(batch.num_rows):
            data = unit.read(batch.column("bytes")[i].as_py())
            n = len(data) - length + 1
            got = []
            for values, k in ((unit.values(data), q), (unit.values(data), length), (unit.second(data), length)):
                total, inv = _sums(values)
                got.append(mix((total[k : k + n] - total[:n]) * inv[:n]).view(np.int64))
            one = pa.array(np.zeros(n, np.int64))
            at = batch.column("start")[i].as_py() + np.arange(n)
            yield pa.RecordBatch.from_arrays([*map(pa.array, got), *(batch.column(c).slice(i, 1).take(one) for c in ("k", "h")), pa.array(at), batch.column("alone").slice(i, 1).take(one)], names=["sub", "w1", "w2", "k", "h", "lo", "alone"])


def _several(unit):
    """More than one row, or for shared passages more than one document."""
    doc = F.xxhash64("k", "h")
    return F.min(doc) != F.max(doc) if unit is WordHashes else F.count("*") > 1


def repeated_spans(docs: DataFrame, hot_runs: int = HOT_RUNS, unit=Bytes) -> list[DataFrame]:
    """docs: k (id), h (text hash), t. Returns tables of k, h, lo, hi: spans that repeat, overlapping ones too. Each is
    written by itself, so that joins whose keys are hot stand alone in their stages and can be split."""
    kind = docs.schema["k"].dataType.simpleString()
    batches = lambda f: lambda it: f(it, unit)
    all_runs = table(docs.mapInArrow(batches(_run_batches), f"bucket long, content long, size short, o short, k {kind}, h long, start long"), "runs")
    buckets = all_runs.groupBy("bucket").agg(_several(unit).alias("open"), F.min("content").alias("c0"), F.max("content").alias("c1")).where("open").select("bucket", (F.col("c0") != F.col("c1")).alias("mixed"))
    buckets = table(buckets, "buckets")  # so that the join below deals both sides anew, and a hot bucket's runs can be split
    live = table(all_runs.join(buckets, "bucket"), "live")
    group = ["bucket", "content", "size", "o"]
    sets = live.groupBy(*group).agg(_several(unit).alias("many"), F.min(F.struct("k", "h", "start")).alias("one"), F.first("mixed").alias("mixed"))
    sets = table(sets, "contents")
    same = live.join(sets.where("many").select(*group), group).select("k", "h", F.col("start").alias("lo"), (F.col("start") + F.col("size") + unit.length - 1).alias("hi"))
    out = [table(same, "same")]
    mixed = sets.where("mixed").select("bucket", "content", "size", "many", "one.*")
    hot = mixed.groupBy("bucket").agg(F.count("*").alias("c")).select("bucket", (F.col("c") > hot_runs).alias("hot"))
    some = mixed.join(hot, "bucket")
    per = some.groupBy("k", "h").agg(F.collect_list(F.struct("bucket", "start", "size", (~F.col("many")).alias("alone"), "hot")).alias("runs"))
    per = per.select(F.col("k").alias("k0"), F.col("h").alias("h0"), "runs")
    rows = docs.join(per, docs["k"].eqNullSafe(per["k0"]) & (docs["h"] == per["h0"])).select("k", "h", "t", "runs")
    rows = table(rows.mapInArrow(batches(_cut_batches), f"bucket long, k {kind}, h long, start long, alone boolean, hot boolean, bytes binary"), "contexts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mild = rows.where("not hot").drop("hot").repartition(parts, "bucket").sortWithinPartitions("bucket")
    out.append(table(mild.mapInArrow(batches(_refine_batches), f"k {kind}, h long, lo long, hi long"), "refined"))
    if rows.where("hot").limit(1).count():
        windows = table(rows.where("hot").drop("hot").mapInArrow(batches(_window_batches), f"sub long, w1 long, w2 long, k {kind}, h long, lo long, alone boolean"), "windows")
        keep = table(windows.groupBy("sub").agg(_several(unit).alias("open")).where("open").select("sub"), "subs")  # a window alone in its sub-bucket is settled
        left = table(windows.join(keep, "sub", "left_semi"), "unsettled")
        keep = table(left.groupBy("sub", "w1", "w2").agg(_several(unit).alias("open")).where("open").select("sub", "w1", "w2"), "wholes")
        widely = left.where("alone").join(keep, ["sub", "w1", "w2"], "left_semi").select("k", "h", "lo", (F.col("lo") + unit.length).alias("hi"))
        out.append(table(widely, "widely"))
    return out


@frugal
def _cut_out(it):
    for batch in it:
        data, off = column_bytes(batch.column("t"))
        spans = batch.column("spans")
        n_bytes, removed, count, sha = [], [], [], []
        for i in range(batch.num_rows):
            own = data[off[i] : off[i + 1]]
            s = spans[i].values if spans[i].is_valid else None
            digest, at, gone, number = hashlib.sha256(), 0, 0, 0
            if s is not None and len(s):
                lo, hi = np.asarray(s.field("lo")), np.asarray(s.field("hi"))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.append(True, lo[1:] > hi[:-1])
                begin, end = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                number, gone = len(begin), int((end - begin).sum())
                for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                    digest.update(own[at:x])
                    at = y
            digest.update(own[at:])
            n_bytes.append(len(own))
            removed.append(gone)
            count.append(number)
            sha.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], names=["k", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[doc_id].alias("k"), text_key(t).alias("h"), t.alias("t"))


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """k, h (id and text hash) of the documents that hold a string of WORDS words which stands in another document too."""
    spans = repeated_spans(_source(docs, doc_id, text), hot_runs, WordHashes)
    got = spans[0].select("k", "h")
    for more in spans[1:]:
        got = got.unionByName(more.select("k", "h"))
    return table(got.distinct(), "passages")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS, passages: bool = False) -> DataFrame:
    """A row for each document: its id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay); with
    `passages` also shares_passage: does a string of WORDS of its words stand in another document?"""
    src = _source(docs, doc_id, text)
    spans = repeated_spans(src, hot_runs)
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    # rows equal in id and text have the same spans: a set, so that they are gathered (and joined to each such row) once
    per = found.groupBy("k", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).select(F.col("k").alias("k0"), F.col("h").alias("h0"), "spans")
    rows = src.join(per, src["k"].eqNullSafe(per["k0"]) & (src["h"] == per["h0"]), "left").select("k", "h", "t", "spans")
    kind = src.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(_cut_out, f"k {kind}, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if passages:
        two = shared_passages(docs, doc_id, text, hot_runs).select(F.col("k").alias("k0"), F.col("h").alias("h0"))
        shared = F.col("k0").isNotNull() | F.col("h0").isNotNull()
        out = out.join(two, out["k"].eqNullSafe(two["k0"]) & (out["h"] == two["h0"]), "left").withColumn("shares_passage", shared).drop("k0", "h0")
    return out.drop("h").withColumnRenamed("k", doc_id)
