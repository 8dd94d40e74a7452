"""N-gram Jaccard join by PartEnum signatures, and its classes.

A document's set is that of its distinct shingles of five words. Sets of Jaccard
similarity 0.8 or more differ in at most a quarter of the smaller one's size: h
shingles. In a size band the domain of shingles is dealt by hash into about h / 2
partitions, so some partition holds at most one of the differences; each
partition is cut into three, and every subset of two of the three parts gives a
signature, the hash of what the set holds there: the part with the difference is
left out by one of the subsets. A set lists the partitions that it holds in two
parts or more ("spread"), and those before them, until it has one more than h / 2
spread ones. Let p be the first partition with at most one difference that is
spread in either set: fewer partitions before it are spread than either set
lists, as each of them holds two differences, so both list p, and the subset
without the difference is not empty. Sets with too few spread partitions list
single shingles besides, as many of the least hashes as sets of that size can
differ in, and one more. Sets near a band's lower edge also list in the band below.

Candidates never become all pairs of a group, and no signature meets in one task:

1. Equal sets are one class. Within a batch of documents a signature's sets are
   combined before the shuffle: the least set stands for them, and the others
   are noted as its followers, so a signature that a third of all documents hold
   is one row for each batch. Signatures of one set only are dropped.
2. Each set is compared with two others at most: of the least sets of its
   signatures, within batches and over all, those with which it shares most.
   Links found, verified on texts, give components.
3. Sets of one signature that are still in different components are compared in
   tiles, in memory, by a bound: parity sketches (bits counted modulo 2) can
   not differ in more bits than the sets differ in shingles. Signatures with the
   same sets are compared once, and a pair of many signatures counts at the first
   of those that both sets' lists of their first FEW show. Tiles give out the sets
   that have such a partner, not the pairs; these come back to their tile with
   their shingles, and the tile gives out a spanning forest of the true links.

No pair of similar sets is lost at any step, and only verified pairs link.

Defined cases: texts of fewer than five words are one shingle; null and empty
texts have the empty set and link with nothing; repeated rows are linked (their
sets are equal); null ids are allowed and count as the greatest id of a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesfast import LOWER, U64, Words, byte_values, frugal, grams, mix, text_slices
from millrace.llm.components import components
from millrace.llm.keys import table, text_key
from millrace.sources.work import small_batches

SHINGLE = 5
PERCENT = 80
BAND = 2.0
TILE = 2048
TILE_SHINGLES = 2 << 20
FETCH_ROWS = 100_000
FEW = 8
DROP_ROWS = 400_000

IS_WORD = np.ones(256, bool)
IS_WORD[9:14] = IS_WORD[32] = False
VALUES = byte_values(21)[LOWER]


def _edges() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


EDGES = _edges()


def shingle_sets(words: Words) -> list[np.ndarray]:
    """For each row its distinct shingles, sorted."""
    g = grams(words.hash, SHINGLE)
    out = []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(g[a : b - SHINGLE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(grams(words.hash[a:b], b - a) if b > a else np.zeros(0, U64))
    return out


def listed(s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets that are not empty (sorted, one after the other; off: their n+1 bounds): set number, signature."""
    n = np.diff(off)
    sets, out = [], []

    def give(which: np.ndarray, value: np.ndarray) -> None:
        sets.append(which)
        out.append(mix(value))

    tiny = np.flatnonzero(n * (100 - PERCENT) < PERCENT)  # similar to equal sets only
    if len(tiny):
        give(tiny, np.add.reduceat(mix(s ^ U64(0x51ED270B)), off[:-1])[tiny])
    bands = [np.searchsorted(EDGES, x, side="right") - 1 for x in (n, -(-n * PERCENT // 100))]
    lacks = np.zeros(len(n), bool)
    for band, own in zip(bands, (np.ones(len(n), bool), bands[0] != bands[1]), strict=True):
        most = (EDGES[band + 1] - 1) * (100 - PERCENT) // PERCENT  # differences of a pair whose smaller set is in the band
        own = own & (n * (100 - PERCENT) >= PERCENT) & (most > 0)
        if not own.any():
            continue
        parts = most // 2 + 1
        parts += np.where(parts < 8, 0, parts // 20 + 1)
        need = np.minimum(n * (100 - PERCENT) // PERCENT, most) // 2 + 1
        salt = mix((band + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
        live = np.repeat(own, n)
        of, x = np.repeat(np.arange(len(n)), n)[live], s[live]
        cell = (((x >> U64(32)) * (parts[of] * 3).astype(U64)) >> U64(32)).astype(np.int64)  # grows with x: equal cells stand together
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])]))
        value = np.add.reduceat(mix(x ^ salt[of]), first)
        of, cell = of[first], cell[first]
        part = cell // 3
        begin = np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])])
        row = np.cumsum(begin) - 1
        sums, held = np.zeros((int(row[-1]) + 1, 3), U64), np.zeros((int(row[-1]) + 1, 3), bool)
        sums[row, cell % 3], held[row, cell % 3] = value, True
        of, part = of[begin], part[begin]
        spread = held.sum(1) >= 2
        before = np.cumsum(spread) - spread
        before -= before[np.searchsorted(of, of)]
        lacks |= own & (np.bincount(of, spread, len(n)) < need)
        on = before < need[of]
        place = salt[of] + part.astype(U64) * U64(0xBF58476D1CE4E5B9)
        for left_out in range(3):
            a, b = (left_out + 1) % 3, (left_out + 2) % 3
            some = on & (held[:, a] | held[:, b])
            give(of[some], (sums[:, a] + sums[:, b] + place + U64(left_out * 0x632BE59BD9B4E019 % (1 << 64)))[some])
    if lacks.any():
        least = n - (-(-n * PERCENT // 100)) + 1
        some = np.repeat(lacks, n) & (np.arange(len(s)) - np.repeat(off[:-1], n) < np.repeat(least, n))
        give(np.repeat(np.arange(len(n)), n)[some], s[some] ^ U64(0x2545F4914F6CDD1D))
    return np.concatenate([np.zeros(0, np.int64), *sets]), np.concatenate([np.zeros(0, U64), *out])


def signatures(s: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set that is not empty."""
    return np.unique(listed(s, np.array([0, len(s)]))[1])


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of m buckets, m a power of 2 near three halves of the size."""
    m = max(256, 1 << int(len(s) * 3 // 2 - 1).bit_length()) if len(s) else 256
    bits = np.bincount(((s >> U64(8)) & U64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) of fewer buckets."""
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def most_differences(a, b):
    """The most shingles in which sets of these sizes, similar enough, can differ."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lists(of: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """For each of n rows the list of its values."""
    order = np.argsort(of, kind="stable")
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int64())) for x in values]


@frugal
def _set_batches(it):
    """Sets out, with the signatures that the set stands for in its batch, and those that it shares there, with the least set of each."""
    seen: set[tuple] = set()
    for batch in it:
        n, one, two, sk, rows, sigs = [], [], [], [], [], []
        for _, _, data, off in text_slices(batch, "t"):
            new, at = [], []
            for s in shingle_sets(Words(data, off, IS_WORD, VALUES)):
                # the set's id; the second value guards it
                a = _signed(int(np.add.reduce(mix(s + U64(3))))) if len(s) else 0
                b = _signed(int(np.bitwise_xor.reduce(mix(s + U64(5))))) if len(s) else 0
                if len(s) and (a, b) not in seen:
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add((a, b))
                    new.append(s)
                    at.append(len(n))
                n.append(len(s))
                one.append(a)
                two.append(b)
                sk.append(sketch(s))
            if new:
                of, sig = listed(np.concatenate(new), np.concatenate([[0], np.cumsum([len(s) for s in new])]))
                rows.append(np.array(at)[of])
                sigs.append(sig.view(np.int64))
        of, sig = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, sigs))
        sid = np.array(one, np.int64)
        order = np.lexsort((sid[of], sig))
        of, sig = of[order], sig[order]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(sig)))
        hub, many = np.repeat(sid[of[first]], size), np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("h"), pa.array(n, pa.int64()), pa.array(sid), pa.array(two, pa.int64()), pa.array(sk, pa.binary()), *_lists(of[first], len(n), sig[first]), *_lists(of[many], len(n), sig[many], hub[many])],
            names=["k", "h", "n", "sid", "two", "sketch", "sigs", "near_sigs", "near_hubs"],
        )


@frugal
def _group_batches(it):
    """Rows sorted by sig, sid in; of signatures with two sets or more each set once, with the least, out. Holds a batch and a row."""
    last = (None, None)  # the signature that a batch ended with, and its least set
    waits = False  # is that set still to be given out?
    at = None
    for batch in it:
        sig, sid = np.asarray(batch.column("sig")), np.asarray(batch.column("sid"))
        if not len(sig):
            continue
        goes_on = last[0] == sig[0]
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = not goes_on
        first = np.flatnonzero(new)
        hubs = np.concatenate([np.array([last[1]] if goes_on else [], np.int64), sid[first]])
        hub = hubs[np.cumsum(new) - (0 if goes_on else 1)]
        fresh = np.ones(len(sig), bool)  # repeated rows
        fresh[1:] = new[1:] | (sid[1:] != sid[:-1])
        fresh[0] = not (goes_on and sid[0] == at)
        other = fresh & (sid != hub)
        out = [(sig[other], sid[other], hub[other])]
        group = np.cumsum(new) - (0 if goes_on else 1)
        full = np.bincount(group[other], minlength=len(hubs)) > 0
        own = full.copy()
        if goes_on:
            own[0] &= waits
        names = np.concatenate([np.array([last[0]] if goes_on else [], np.int64), sig[first]])
        out.append((names[own], hubs[own], hubs[own]))
        waits = not full[-1] and (waits if goes_on and len(hubs) == 1 else True)
        last, at = (sig[-1], hub[-1]), sid[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["sig", "sid", "hub"])


def _close(n1: np.ndarray, x: np.ndarray, n2: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Can the sets be similar, by sizes and sketches (of one width)?"""
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return apart <= most_differences(n1, n2)


def _matrix(sketches: list[bytes]) -> np.ndarray:
    size = min(map(len, sketches))
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sketches):
        groups.setdefault(len(s), []).append(i)
    out = np.zeros((len(sketches), size), np.uint8)
    for width, at in groups.items():
        out[at] = _fold(np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(-1, width), size)
    return out


def _sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


@frugal
def _filter_batches(it):
    """Candidate pairs with sizes and sketches in; those that may be similar out."""
    for batch in it:
        na, nb = np.asarray(batch.column("na")), np.asarray(batch.column("nb"))
        keep = _sized(na, nb)
        xs, ys = batch.column("xa").to_pylist(), batch.column("xb").to_pylist()
        for i in np.flatnonzero(keep).tolist():
            m = _matrix([xs[i], ys[i]])
            keep[i] = int(np.bitwise_count(m[0] ^ m[1]).sum()) <= most_differences(na[i], nb[i])
        rows = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])


def _tile_pairs(n: np.ndarray, comp: np.ndarray, m: np.ndarray, side: np.ndarray):
    """Pairs of rows of one cell (in order of n) that are in different components and may be similar."""
    two_sided = side.min() != side.max()
    for lo in range(0, len(n), 256):
        hi = min(lo + 256, len(n))
        end = int(np.searchsorted(n, n[hi - 1] * 100 // PERCENT, side="right"))
        i, j = np.nonzero(comp[lo:hi, None] != comp[None, lo:end])
        i, j = i + lo, j + lo
        ok = (j > i) & _sized(n[i], n[j])
        if two_sided:
            ok &= side[i] != side[j]
        i, j = i[ok], j[ok]
        for z in range(0, len(i), 1 << 16):
            a, b = i[z : z + (1 << 16)], j[z : z + (1 << 16)]
            good = _close(n[a], m[a], n[b], m[b])
            yield a[good], b[good]


def _by_cell(it, names: list[str]):
    """(cell, rows of it) of rows sorted by cell (sig, ci, cj). A cell has at most two tiles of sets."""
    held: list[tuple] = []
    key = None
    for batch in it:
        columns = [batch.column(c).to_pylist() for c in ("sig", "ci", "cj", *names)]
        for sig, ci, cj, *row in zip(*columns, strict=True):
            if (sig, ci, cj) != key:
                if len(held) > 1:
                    yield key, held
                held, key = [], (sig, ci, cj)
            held.append(tuple(row))
    if len(held) > 1:
        yield key, held


@frugal
def _cell_batches(it):
    """Rows of cells in; those with a partner in another component that may be similar, less pairs that another signature shows, out."""
    for (sig, ci, cj), rows in _by_cell(it, ["sid", "comp", "n", "sketch", "tile", "few"]):
        rows.sort(key=lambda r: (r[2], r[0]))
        sid, comp, n, side = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2, 4))
        if comp.min() == comp.max():
            continue
        lists = [frozenset(r[5]) for r in rows]
        some = np.zeros(len(rows), bool)
        for i, j in _tile_pairs(n, comp, _matrix([r[3] for r in rows]), side):
            new = ~(some[i] & some[j])
            for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
                both = lists[a] & lists[b]
                if not both or min(both) == sig:
                    some[a] = some[b] = True
        at = np.flatnonzero(some)
        if len(at):
            same = [pa.array(np.full(len(at), x, np.int64)) for x in (sig, ci, cj)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(sid[at]), pa.array(comp[at]), pa.array(side[at])], names=["sig", "ci", "cj", "sid", "comp", "tile"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


@frugal
def _forest_batches(it):
    """Rows of cells with their shingles in; of each cell a spanning forest of its links out."""
    for _, rows in _by_cell(it, ["sid", "comp", "tile", "shingles"]):
        sets = [np.frombuffer(r[3], U64) for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (len(sets[i]), rows[i][0]))
        sets = [sets[i] for i in order]
        sid, comp, side = (np.array([rows[i][c] for i in order], np.int64) for c in (0, 1, 2))
        up = {c: c for c in comp.tolist()}

        def root(x, up=up):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        n = np.array([len(s) for s in sets])
        for i, j in _tile_pairs(n, comp, _matrix([sketch(s) for s in sets]), side):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                x, y = root(int(comp[a])), root(int(comp[b]))
                if x != y and similar(sets[a], sets[b]):
                    up[max(x, y)] = min(x, y)
                    found.append((int(sid[a]), int(sid[b])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


@frugal
def _shingle_batches(it):
    """Texts in, their sorted shingles out."""
    for batch in it:
        for a, b, data, off in text_slices(batch, "t"):
            sets = [s.tobytes() for s in shingle_sets(Words(data, off, IS_WORD, VALUES))]
            yield pa.RecordBatch.from_arrays([batch.column("sid").slice(a, b - a), pa.array(sets, pa.binary())], names=["sid", "shingles"])


@frugal
def _verify_batches(it):
    for batch in (whole.slice(z, 256) for whole in it for z in range(0, whole.num_rows, 256)):
        found = []
        for c in ("ta", "tb"):
            sets = []
            for _, _, data, off in text_slices(batch, c):
                sets += shingle_sets(Words(data, off, IS_WORD, VALUES))
            found.append(sets)
        ok = [similar(x, y) for x, y in zip(*found, strict=True)]
        rows = pa.array(np.flatnonzero(np.array(ok, bool)))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])


class _Join:
    def __init__(self, src: DataFrame):
        self.src = src
        self.parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        kind = src.schema["k"].dataType.simpleString()
        columns = f"k {kind}, h long, n long, sid long, two long, sketch binary, sigs array<long>, near_sigs array<long>, near_hubs array<long>"
        self.sets = table(src.mapInArrow(_set_batches, columns), "sets")
        classes = self.sets.where("n > 0").groupBy("sid", "two", "n").agg(F.min(F.struct("k", "h")).alias("one"), F.first("sketch").alias("sketch"))
        self.classes = table(classes.select("sid", "two", "n", F.col("one.k").alias("k"), F.col("one.h").alias("h"), "sketch"), "classes")

    def shared(self) -> DataFrame:
        """sig, sid, hub (the least set of the signature, or of the set's batch), wide (which of the two): of signatures with two sets or more."""
        rows = self.sets.select("sid", F.explode("sigs").alias("sig"))
        wide = rows.repartition(self.parts, "sig").sortWithinPartitions("sig", "sid").mapInArrow(_group_batches, "sig long, sid long, hub long")
        near = self.sets.select("sid", F.explode(F.arrays_zip("near_sigs", "near_hubs")).alias("x")).select(F.col("x.near_sigs").alias("sig"), "sid", F.col("x.near_hubs").alias("hub"))
        return table(wide.withColumn("wide", F.lit(True)).unionByName(near.withColumn("wide", F.lit(False))), "shared")

    @staticmethod
    def stars(shared: DataFrame) -> DataFrame:
        """Pairs a, b: each set with the hub of its batch and with that of all sets with which it shares most signatures."""
        votes = shared.where("sid <> hub").groupBy("sid", "wide", "hub").agg(F.count("*").alias("n"))
        votes = votes.withColumn("order", F.col("n") * (1 << 20) + F.pmod(F.xxhash64("hub"), F.lit(1 << 20)))
        best = votes.groupBy("sid", "wide").agg(F.max_by("hub", "order").alias("hub"))
        return best.select(F.least("sid", "hub").alias("a"), F.greatest("sid", "hub").alias("b")).distinct()

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs a, b of sets: those that sizes and sketches allow."""
        c = self.classes
        a = c.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
        b = c.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_filter_batches, "a long, b long").distinct()

    def texts(self, ids: DataFrame) -> DataFrame:
        """sid, t: a text of each of these sets."""
        ids = table(ids.join(self.classes, "sid").select("sid", F.col("k").alias("k0"), F.col("h").alias("h0")), "wanted")
        wanted = F.broadcast(ids) if ids.limit(FETCH_ROWS + 1).count() <= FETCH_ROWS else ids  # checked; joined by shuffle beyond
        texts = self.src.join(wanted, self.src["k"].eqNullSafe(F.col("k0")) & (self.src["h"] == F.col("h0"))).select("sid", "t")
        return table(texts.dropDuplicates(["sid", "t"]), "texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs a, b of sets: those whose texts are similar."""
        pairs = table(pairs, "pairs")
        texts = self.texts(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
        a, b = texts.select(F.col("sid").alias("a"), F.col("t").alias("ta")), texts.select(F.col("sid").alias("b"), F.col("t").alias("tb"))
        return table(pairs.join(a, "a").join(b, "b").mapInArrow(_verify_batches, "a long, b long").distinct(), "links")

    def cells(self, shared: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between sets that share a signature and are in different components; enough of them to connect what is linked."""
        sets = self.classes.groupBy("sid").agg(F.min("n").alias("n"))
        rows = shared.select("sig", "sid").distinct().join(sets, "sid").join(comps.select(F.col("v").alias("sid"), "comp"), "sid", "left")
        rows = table(rows.withColumn("comp", F.coalesce("comp", "sid")), "members")
        tags = [F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"tag{i}") for i in range(2)]
        open_ = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.sum("n").alias("size"), *tags).where("lo <> hi")
        open_ = open_.groupBy("tag0", "tag1", "c", "size").agg(F.min("sig").alias("sig"))  # signatures with the same sets
        tiles = F.ceil(F.greatest(F.col("c") / TILE, F.col("size") / TILE_SHINGLES)).cast("int")
        rows = table(rows.join(table(open_.select("sig", tiles.alias("tiles")), "open"), "sig"), "cells")
        if not rows.limit(1).count():
            return rows.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
        first = rows.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FEW).alias("few"))
        rows = rows.withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("sig", F.least("tile", "other").alias("ci"), F.greatest("tile", "other").alias("cj"), "sid", "comp", "n", "tile")
        rows = rows.join(self.classes.groupBy("sid").agg(F.first("sketch").alias("sketch")), "sid").join(first, "sid")
        cell = ["sig", "ci", "cj"]
        active = rows.repartition(self.parts, *cell).sortWithinPartitions(*cell).mapInArrow(_cell_batches, "sig long, ci long, cj long, sid long, comp long, tile long")
        active = table(active, "active")
        if not active.limit(1).count():
            return active.select(F.col("sid").alias("a"), F.col("sid").alias("b"))
        shingles = self.texts(active.select("sid").distinct()).mapInArrow(_shingle_batches, "sid long, shingles binary")
        rows = active.join(shingles, "sid").repartition(self.parts, *cell).sortWithinPartitions(*cell)
        return table(rows.mapInArrow(_forest_batches, "a long, b long").distinct(), "links")


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """k, h, n, component_id of every document (h: hash of its text)."""
    small_batches(docs.sparkSession)
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    src = docs.select(docs[doc_id].alias("k"), text_key(t).alias("h"), t.alias("t"))
    job = _Join(src)
    shared = job.shared()
    links = job.links(job.near(job.stars(shared)))
    comps = components(links)
    more = job.cells(shared, comps)
    comps = components(links.unionByName(more))
    # classes of equal sets take their component; the least document of a component names it
    of = comps.select(F.col("v").alias("sid"), "comp")
    named = job.classes.join(of, "sid", "left").select("sid", "two", "n", "k", F.coalesce("comp", "sid").alias("comp"), F.when(F.col("comp").isNull(), F.col("two")).alias("alone"))
    least = named.groupBy("comp", "alone").agg(F.min("k").alias("component_id"))
    named = named.join(least, named["comp"].eqNullSafe(least["comp"]) & named["alone"].eqNullSafe(least["alone"])).select("sid", "two", "n", "component_id")
    out = job.sets.select("k", "h", "n", "sid", "two").join(named, ["sid", "two", "n"], "left")
    return out.select("k", "h", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("k")).alias("component_id"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, n_shingles, component_id (the least id reachable by links, its own included)."""
    return _classes(docs, doc_id, text).select(F.col("k").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their columns, less all but one of each class: the one of the least id stays (of rows of
    one id the least text hash, of equal rows any). Documents without words all stay."""
    got = _classes(docs, doc_id, text)
    first = got.where("n > 0 and k <=> component_id").groupBy("component_id").agg(F.min("h").alias("first"), F.count("*").alias("rows"))
    first = first.select(F.col("component_id").alias("c"), "first", "rows")
    out = got.where("n > 0").join(first, got["component_id"].eqNullSafe(first["c"]))
    out = table(out.where("not (k <=> component_id) or h <> first or rows > 1").select(F.col("k").alias("k0"), F.col("h").alias("h0"), (F.col("k").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first"))).alias("stays")).distinct(), "dropped")
    gone = F.broadcast(out) if out.limit(DROP_ROWS + 1).count() <= DROP_ROWS else out  # checked; joined by shuffle beyond
    names = docs.columns
    h = text_key(F.coalesce(docs[text].cast("string"), F.lit("")))
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[doc_id].alias("k"), h.alias("h"))
    both = src.join(gone, src["k"].eqNullSafe(gone["k0"]) & (src["h"] == gone["h0"]), "left")
    cols = [f"c{i}" for i in range(len(names))]
    whole = both.where("stays is null").select(*cols)
    one = both.where("stays").dropDuplicates(["k", "h"]).select(*cols)  # rows that stand more than once
    return whole.unionByName(one).toDF(*names)
