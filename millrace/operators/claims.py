"""Resolution of claims in order: a claim that an earlier one already makes joins it, and brings its evidence along."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ranking as R
from millrace.sources.work import batches_of, small_batches, table

#: Fixed value: an earlier claim is met if more than this share of its words stands in the later one.
MET = 0.85
#: So many keys are shared by pairs that are compared word by word.
SHARED = 4
#: So many words are a block, and so many shared words of two blocks are held at once.
BLOCK, AT_ONCE = 2_000_000, 4_000_000
#: So many numbers of classes are sent to all tasks; more are joined by a shuffle.
FEW = 500_000


def _classes(claims: DataFrame) -> DataFrame:
    """claims with key: a hash, equal for claims that meet the same ones (equal word sets; without words, equal texts) in a scope."""
    words = F.array_sort(T.tokens(F.col("claim")))
    c = claims.withColumn("words", F.coalesce(words, F.array().cast("array<string>")))
    return c.withColumn("key", F.sha2(F.when(F.size("words") > 0, F.concat(F.lit("w "), F.array_join("words", " "))).otherwise(F.concat(F.lit("t "), F.lower(F.coalesce("claim", F.lit(""))))), 256))


def _hashed(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first and h: the words of a claim as 64-bit numbers of scope and word; at, n: in how many claims each stands). No two
    words share a number: that is counted, and another start is taken if two did."""
    words = table(classes.select("scope", F.explode("words").alias("w")).groupBy("scope", "w").agg(F.count("*").alias("n")), "words")
    start = 0
    while True:
        at = lambda w: F.xxhash64(F.lit(start), "scope", w)  # noqa: B023, E731
        vocabulary = words.select(at(F.col("w")).alias("at"), "n")
        if not vocabulary.groupBy("at").count().where("count > 1").limit(1).count():
            return classes.where(F.size("words") > 0).select("first", F.transform("words", at).alias("h")), vocabulary
        start += 1


def _blocks(claims: DataFrame, vocabulary: DataFrame, met: float) -> DataFrame:
    """Claims (first, h) packed where they are read, about BLOCK words a row: first (of each claim, as longs), n (its words), h
    and d (words in order, with the number of their claim in the block), kh and kd (the same of keys), low and high (of first)."""
    often = vocabulary.orderBy(F.desc("n"), "at").limit(R.KNOWN).select("at").collect()  # bounded by KNOWN
    at = np.array([r["at"] for r in often], np.int64)
    by = np.argsort(at)
    ranks = claims.sparkSession.sparkContext.broadcast((at[by], R.KNOWN - by))
    block, docs = BLOCK, 60_000  # numbers of claims are of 16 bits

    def packed(first, n, h):
        known, rank = ranks.value
        d = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        order = np.lexsort((h, np.where(known[place] == h, rank[place], 0), d))
        need = np.floor(n * met + 1e-9).astype(np.int64) + 1
        keys = np.where(need <= n, np.minimum(n, n - need + np.minimum(SHARED, need)), 0)
        key = order[np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(keys, n)]
        key, every = key[np.argsort(h[key])], np.argsort(h)
        row = {"first": first, "n": n, "h": h[every], "d": d[every], "kh": h[key], "kd": d[key]}
        out = {k: [v.tobytes()] for k, v in row.items()} | {"low": [int(first.min())], "high": [int(first.max())]}
        return pa.RecordBatch.from_pydict(out, _BLOCK)

    def pack(batches):
        held, words, rows = [], 0, 0
        for b in batches:
            h = b.column("h")
            first, n, h = b.column("first").to_numpy(), h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), h.flatten().to_numpy()
            end = np.cumsum(n)
            while len(n):
                k = int(min(max(1, np.searchsorted(end, block - words, side="right")), docs - rows, len(n)))
                held.append((first[:k], n[:k], h[: end[k - 1]]))
                words, rows = words + int(end[k - 1]), rows + k
                first, n, h, end = first[k:], n[k:], h[end[k - 1] :], end[k:] - end[k - 1]
                if words >= block or rows >= docs or len(n):
                    yield packed(*map(np.concatenate, zip(*held, strict=True)))
                    held, words, rows = [], 0, 0
        if held:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    small_batches(claims.sparkSession)
    return claims.mapInArrow(pack, "first binary, n binary, h binary, d binary, kh binary, kd binary, low long, high long")


_BLOCK = pa.schema([(k, pa.binary()) for k in ("first", "n", "h", "d", "kh", "kd")] + [("low", pa.int64()), ("high", pa.int64())])


def _met_in(a: dict, b: dict, met: float) -> tuple[np.ndarray, np.ndarray]:
    """earlier, later: which claims of block b meet ones of block a that are before them."""
    need = np.floor(a["n"] * met + 1e-9).astype(np.int64) + 1
    least, wide = np.minimum(SHARED, need), len(b["n"])
    low = np.searchsorted(b["h"], a["kh"])
    times = np.searchsorted(b["h"], a["kh"], side="right") - low
    parts, upto, k = [], np.cumsum(times), 0
    while k < len(times):  # a word that many share is no large array
        m = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + AT_ONCE, side="right")))
        t = times[k:m]
        x = np.repeat(a["kd"][k:m], t).astype(np.int64)
        y = b["d"][np.arange(t.sum()) + np.repeat(low[k:m] - (np.cumsum(t) - t), t)].astype(np.int64)
        ok = (a["first"][x] < b["first"][y]) & (b["n"][y] >= need[x])
        parts.append(np.unique(x[ok] * wide + y[ok], return_counts=True))
        k = m
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    n = np.bincount(which, np.concatenate([c for _, c in parts]), len(pairs))
    x, y = pairs // wide, pairs % wide
    x, y = x[n >= least[x]], y[n >= least[x]]
    if not len(x):
        return x, y
    sets = []
    for s in (a, b):
        by = np.argsort(s["d"], kind="stable")  # the words of a claim, in order
        end = np.cumsum(s["n"])
        sets.append((s["h"][by], end - s["n"], end))
    (ha, la, ea), (hb, lb, eb) = sets
    ok = np.zeros(len(x), bool)
    for i, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        w, v = ha[la[p] : ea[p]], hb[lb[q] : eb[q]]
        ok[i] = np.count_nonzero(v[np.minimum(np.searchsorted(v, w), len(v) - 1)] == w) / len(w) > met
    return a["first"][x[ok]], b["first"][y[ok]]


def meeting_pairs(classes: DataFrame, met: float = MET) -> DataFrame:
    """classes: scope, first (a number, distinct), words. earlier, later: pairs of one scope of which the later holds more
    than `met` of the earlier one's words.

    Of an earlier claim's words, rarest first, so many are keys that a claim without SHARED of them cannot hold enough; a later
    claim, which must have as many words as that takes, is looked up by all its words. Common words are no keys of long claims.
    Pairs that share SHARED keys (all, where a claim must be held whole and has fewer) are compared word by word.

    Pairs that share a word grow with the square of the claims, so none of them is written: claims are packed into blocks, each
    two blocks are one row of a cross join of what is read, and a task finds the pairs of two blocks in memory. Only pairs that
    meet leave it. Disk follows the claims and the pairs that meet.
    """
    claims, vocabulary = _hashed(classes)
    blocks = table(_blocks(claims, vocabulary, met), "blocks")
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in of]) for s, of in (("a", ("first", "n", "h", "d", "kh", "kd", "low")), ("b", ("first", "n", "h", "d", "high"))))
    kind = {"d": np.uint16, "kd": np.uint16}

    def find(batches):
        for rows in batches:
            for r in range(rows.num_rows):
                side = lambda s: {c[:-2]: np.frombuffer(rows.column(c)[r].as_buffer(), kind.get(c[:-2], np.int64)) for c in rows.schema.names if c.endswith(s) and c not in ("low_a", "high_b")}  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _met_in(side("_a"), side("_b"), met)], ["earlier", "later"])

    both = a.join(b.hint("shuffle_replicate_nl"), F.col("low_a") < F.col("high_b"))
    with batches_of(blocks.sparkSession, 1):  # two blocks are a large row
        return table(both.mapInArrow(find, "earlier long, later long"), "near")


def resolve(pairs: DataFrame) -> DataFrame:
    """pairs: earlier, later (distinct). later, keeper: for each claim that an earlier kept one meets, the first of these.

    A claim is kept if no claim that meets it is kept, which depends on the order along chains. Each round decides all
    claims whose earlier ones tell: met by a kept one, or only by ones that are not kept. The first undecided claim is
    always decided, and there are as many rounds as the longest chain of claims that turn on each other.
    """
    pairs = table(pairs, "pairs")
    kept = pairs.select(F.col("earlier").alias("id")).distinct().join(pairs.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
    known = table(kept.select("id", F.lit(True).alias("kept")), "known")
    all_known, open_ = known, pairs.withColumn("told", F.lit(None).cast("boolean"))
    while open_.limit(1).count():
        told = open_.join(known.select(F.col("id").alias("earlier"), "kept"), "earlier", "left").select("earlier", "later", F.coalesce("told", "kept").alias("told"))
        told = table(told, "told")
        by = told.groupBy("later").agg(F.coalesce(F.max("told"), F.lit(False)).alias("met"), (F.count("told") == F.count("*")).alias("all"))
        known = table(by.where(F.col("met") | F.col("all")).select(F.col("later").alias("id"), (~F.col("met")).alias("kept")), "known")
        all_known = all_known.unionByName(known)
        open_ = told.join(known.select(F.col("id").alias("later")), "later", "left_anti")
    keepers = all_known.where("kept").select(F.col("id").alias("earlier"))
    return pairs.join(keepers, "earlier").groupBy("later").agg(F.min("earlier").alias("keeper"))


def merge(claims: DataFrame, met: float = MET) -> DataFrame:
    """claims: scope, ord (distinct numbers in order of arrival), claim, evidence, confidence. A row for each claim kept:
    scope, ord, claims (merged into it, itself included), evidence (distinct, not null), confidence (the most)."""
    c = table(_classes(claims.select(F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("scope"), F.col("ord").cast("long").alias("ord"), "claim", "evidence", "confidence")).drop("claim"), "claims")
    first = table(c.groupBy("scope", "key").agg(F.min("ord").alias("first")), "first")
    ords = first.select("first")
    ords = F.broadcast(ords) if ords.limit(FEW + 1).count() <= FEW else ords  # word lists stay where they are
    classes = c.select("scope", F.col("ord").alias("first"), "words").join(ords, "first", "left_semi")
    keeper = resolve(meeting_pairs(classes, met))
    to = first.join(keeper.withColumnRenamed("later", "first"), "first", "left").select("scope", "key", F.coalesce("keeper", "first").alias("keeper"))
    merged = c.join(to, ["scope", "key"])
    by = merged.groupBy("scope", "keeper", "evidence").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))  # pre-aggregates a hot keeper
    return by.groupBy("scope", F.col("keeper").alias("ord")).agg(F.sum("n").alias("claims"), F.count("evidence").alias("evidence"), F.max("confidence").alias("confidence"))
