"""Lexical scoring, rank fusion, de-duplication and ordering over DataFrames."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import all_tokens, tokens
from millrace.sources.work import small_batches, spread, table

K1, B = 1.5, 0.75
RRF_K = 60.0


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dlen: one row for each term of each document."""
    t = docs.select(F.col(key).alias("key"), all_tokens(F.col(text)).alias("t")).select("key", F.size("t").alias("dlen"), F.explode("t").alias("term"))
    return t.groupBy("key", "dlen", "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """term, df (documents that hold it), cf (times it stands). A document's terms are sorted within the row, so the first
    of each run counts the document: one shuffle, of partial sums."""
    t = spread(docs.select(F.col(text).alias("text"))).select(F.array_sort(all_tokens(F.col("text"))).alias("t"))
    each = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == x), 0).otherwise(1).alias("new")))
    return t.select(F.explode(each).alias("x")).groupBy("x.term").agg(F.sum("x.new").alias("df"), F.count("*").alias("cf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: doc_count, total_len, avg_len."""
    n = F.size(all_tokens(F.col(text)))
    return docs.select(n.alias("n")).agg(F.count("*").alias("doc_count"), F.sum("n").alias("total_len"), (F.sum("n") / F.count("*")).alias("avg_len"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _norm(b: float, dlen: Column, avg: Column) -> Column:
    return 1 - b + b * (dlen / avg)


def bm25(tf, dlen, avg, k1=K1, b=B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * _norm(b, dlen, avg))


def bm25_plus(tf, dlen, avg, k1=K1, b=B, delta=1.0) -> Column:
    return bm25(tf, dlen, avg, k1, b) + delta


def bm25_l(tf, dlen, avg, k1=K1, b=B, delta=0.5) -> Column:
    c = tf / _norm(b, dlen, avg) + F.when(dlen > avg, delta).otherwise(0.0)
    return c * (k1 + 1) / (c + k1)


def _is(term: str):
    return lambda x: x == term


def _counts(docs: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """key, dlen, n (array of the counts of the query's terms): texts are read and cut into tokens once, and this is
    written, a few numbers a document."""
    t = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", all_tokens(F.col("text")).alias("t"))
    t = t.select("key", F.size("t").alias("dlen"), F.filter("t", lambda x: x.isin(query)).alias("t"))
    return table(t.select("key", "dlen", F.array(*[F.size(F.filter("t", _is(q))) for q in query]).alias("n")), "counts")


def _stats(counts: DataFrame, query: list[str]) -> DataFrame:
    """One row: doc_count, avg_len, df (array by term of the query)."""
    df = F.array(*[F.count_if(F.col("n")[i] > 0) for i in range(len(query))])
    return counts.agg(F.count("*").alias("doc_count"), (F.sum("dlen") / F.count("*")).alias("avg_len"), df.alias("df"))


def term_hits(docs: DataFrame, key: str, text: str, query: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term, tf, dlen of the postings of the query's terms; one row of doc_count, avg_len; term, df)."""
    c = _counts(docs, key, text, query)
    s = _stats(c, query)
    names = F.array(*[F.lit(q) for q in query])
    hits = c.select("key", "dlen", F.explode(F.arrays_zip(names.alias("term"), F.col("n").alias("tf"))).alias("x")).select("key", "dlen", "x.term", "x.tf").where("tf > 0")
    df = s.select(F.explode(F.arrays_zip(names.alias("term"), F.col("df").alias("df"))).alias("x")).select("x.term", "x.df").where("df > 0")
    return hits, s.select("doc_count", "avg_len"), df


def lexical_scores(docs: DataFrame, key: str, text: str, query: list[str], formula=bm25) -> DataFrame:
    """key, score of the documents that hold a term of the query (its distinct tokens).

    A document's counts of the terms are one array, so scoring shuffles nothing: only one row of statistics goes round.
    """
    if not query:
        return docs.select(F.col(key).alias("key"), F.lit(0.0).alias("score")).limit(0)
    c = _counts(docs, key, text, query)
    rows = c.where(F.exists("n", lambda x: x > 0)).crossJoin(F.broadcast(_stats(c, query)))  # one row
    dlen, avg, score = F.col("dlen").cast("double"), F.col("avg_len"), F.lit(0.0)
    for i in range(len(query)):
        tf = F.col("n")[i].cast("double")
        score = score + F.when(tf > 0, idf(F.col("doc_count"), F.col("df")[i]) * formula(tf, dlen, avg)).otherwise(0.0)
    return rows.select("key", score.alias("score"))


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def ranks(df: DataFrame, tie: str, *scores: str, by: str | None = None) -> DataFrame:
    """A 1-based rank column <score>_rank for each score, ties by `tie`; with no `by`, over all rows."""
    if not by:
        df = table(df, "scores")  # read by each rank twice: for the ranges, and for the rows
    for s in scores:
        if by:
            df = df.withColumn(f"{s}_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(s), F.asc(tie))))
        else:
            df = global_rank(df, f"{s}_rank", F.desc(s), F.asc(tie))
    return df


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """A 1-based rank over all rows without a task that holds them all: ranges of the order go to tasks, rows are numbered
    in each, and the rows of the ranges before (a few numbers) are added."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    r = table(r.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranges")
    counts = r.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each range
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return r.join(F.broadcast(before), "_part").withColumn(name, (F.col("_n") + F.col("_before")).cast("int")).drop("_part", "_n", "_before")


def rrf(*rank_columns: Column, k: float = RRF_K) -> Column:
    out = F.lit(0.0)
    for r in rank_columns:
        out = out + 1 / (k + r)
    return out


def weighted_rrf(parts: list[tuple[Column, Column, float]], k: float = RRF_K) -> Column:
    """Parts are (score, rank, weight); only positive scores count; if no weight is positive all weigh 1."""
    if all(w <= 0 for _, _, w in parts):
        parts = [(s, r, 1.0) for s, r, _ in parts]
    out = F.lit(0.0)
    for s, r, w in parts:
        out = out + F.when(s > 0, F.lit(w) / (k + r)).otherwise(0.0)
    return out


def deduplicate(cands: DataFrame, keys: list[str], score: str, provenance: str) -> DataFrame:
    """One row per key: the largest score, merged provenance in order, number of duplicates."""
    return cands.groupBy(*keys).agg(F.max(score).alias(score), F.array_sort(F.collect_set(provenance)).alias(provenance), (F.count("*") - 1).alias("duplicates"))


def merge_tiers(cands: DataFrame, keys: list[str], tier: str, score: str) -> DataFrame:
    """One row per key: the best (lowest) tier, and the largest score in it."""
    return cands.groupBy(*keys).agg(F.min(F.struct(F.col(tier), (-F.col(score)).alias("neg"))).alias("best")).select(*keys, F.col(f"best.{tier}").alias(tier), (-F.col("best.neg")).alias(score))


def fuse_channels(cands: DataFrame, key: str, channel: str, score: str, weights: dict[str, float], bonus: tuple[str, ...] = (), add: float = 0.5) -> DataFrame:
    """key, score: largest score of each channel, weighted; `add` more if a channel of `bonus` has the key."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.max(F.when(F.col(channel) == name, F.col(score))), F.lit(0.0))
    if bonus:
        total = total + F.when(F.max(F.when(F.col(channel).isin(*bonus), 1).otherwise(0)) == 1, add).otherwise(0.0)
    return cands.groupBy(key).agg(total.alias("fused"))


def softmax_entropy(df: DataFrame, score: str, temperature: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """n, entropy of the scores of each group."""
    by = by or []
    peak = df.withColumn("_m", F.greatest(F.lit(0.0), F.max(score).over(Window.partitionBy(*by))))
    e = peak.withColumn("_e", F.exp((F.col(score) - F.col("_m")) / temperature))
    s = e.withColumn("_s", F.sum("_e").over(Window.partitionBy(*by)))
    p = F.col("_e") / F.col("_s")
    return s.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(p > 1e-12, -p * F.log(p)).otherwise(0.0)).alias("entropy"))


def adaptive_k(n: Column, entropy: Column, k_min: int, k_max: int) -> Column:
    h = F.when(n > 1, F.least(F.lit(1.0), entropy / F.log(n.cast("double")))).otherwise(F.lit(None))
    return F.when(h.isNull(), k_min).otherwise(k_min + F.round((k_max - k_min) * h)).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves of the scaled double away from zero. F.round goes by the shortest decimal digits of x, so
    a quotient that stands on a half may go the other way than in engines that scale."""
    return F.round(x * 10.0**digits) / 10.0**digits


#: So many of the most frequent terms have a rank of their own; the others count as equally rare.
KNOWN = 100_000
#: Sketches of sets: longs that go with each term of a prefix, and those of sets of WIDE_FROM terms or more.
SKETCH, WIDE, WIDE_FROM = 8, 64, 1000


def rarest_first(sets: DataFrame, terms: str) -> DataFrame:
    """sets (.., terms: array of distinct strings) with their terms in one order for all sets: first, by themselves, those that are
    not among the KNOWN most frequent, then these from the rarer to the more frequent. Only counts of terms are shuffled."""
    df = sets.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    often = df.orderBy(F.desc("n"), "term").limit(KNOWN).select("term").collect()  # bounded by KNOWN
    ranks = sets.sparkSession.sparkContext.broadcast({r["term"]: KNOWN - i for i, r in enumerate(often)})

    def order(batches):
        rank = ranks.value
        for b in batches:
            at = b.schema.get_field_index(terms)
            put = pa.array([sorted(t, key=lambda w: (rank.get(w, 0), w)) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), put)

    small_batches(sets.sparkSession)
    return sets.mapInArrow(order, sets.schema)


def _parity(terms: str, j: str, longs: int) -> str:
    """SQL of the j-th long of a parity sketch: bits of two sets differ in as many places at most as their terms do."""
    return f"aggregate({terms}, 0L, (x, h) -> x ^ if((shiftright(h, 6) & {longs - 1}) = {j}, shiftleft(1L, cast(h & 63 AS int)), 0L))"


def similar_sets(rows: DataFrame, group: str, key: str, terms: str, percent: int) -> DataFrame:
    """a, b, jaccard of pairs (a < b) of one group whose sets of terms have a Jaccard of `percent` or more.

    Prefix filter: of a set of n terms, rarest first, the first n - ceil(n * percent / 100) + 1 hold a term of every set similar
    to it, so only sets that share one of those are compared. The first term that a pair shares tells how many it can share at
    most, and parity sketches how much it differs at least: both are judged within the join, so of all pairs that share a term
    only those that are nearly similar become rows. Whole sets are read for these alone.
    """
    sets = rows.where((F.size(terms) > 0) & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(terms).alias("t"), F.size(terms).alias("n"))
    x = table(rarest_first(table(sets, "sets"), "t"), "ordered")
    hashed = x.withColumn("h", F.transform("t", lambda w: F.xxhash64(w)))
    first = F.posexplode(F.slice("t", 1, F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)).alias("i", "term")
    prefix = hashed.select("g", "k", "n", "t", *[F.expr(_parity("h", str(j), SKETCH)).alias(f"s{j}") for j in range(SKETCH)]).select("g", "k", "n", *[f"s{j}" for j in range(SKETCH)], first)
    prefix = prefix.select(F.xxhash64("g", "term").alias("at"), *[c for c in prefix.columns if c not in ("g", "term")])
    a, b = (prefix.select("at", *[F.col(c).alias(f"{c}_{s}") for c in prefix.columns if c != "at"]) for s in "ab")
    m = F.col("n_a") + F.col("n_b")
    differ = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"s{j}_a").bitwiseXOR(F.col(f"s{j}_b"))) for j in range(SKETCH)])
    near = a.join(b, "at").where((F.col("k_a") < F.col("k_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    near = near.where((100 + percent) * F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= percent * m).where((100 + percent) * differ <= (100 - percent) * m)
    near = table(near.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), (F.least("n_a", "n_b") >= WIDE_FROM).alias("wide")).distinct(), "near")
    # the sketch of a large set is full: a wider one is asked before its terms are read
    wide = table(hashed.where(F.col("n") >= WIDE_FROM).select("k", "n", F.expr(f"transform(sequence(0, {WIDE - 1}), j -> {_parity('h', 'j', WIDE)})").alias("w")), "wide")
    wa, wb = (wide.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("w").alias(f"w_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("w_a", "w_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    large = near.where("wide").select("a", "b").join(wa, "a").join(wb, "b").where((100 + percent) * apart <= (100 - percent) * m).select("a", "b")
    pairs = near.where("not wide").select("a", "b").unionByName(large)
    ta, tb = (x.select(F.col("k").alias(c), F.col("g").alias(f"g{c}"), F.col("t").alias(f"t{c}")) for c in "ab")
    both = pairs.join(ta, "a").join(tb, "b").where("ga = gb").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("i"), (F.size("ta") + F.size("tb")).alias("m"))
    return both.where(100 * F.col("i") >= percent * (F.col("m") - F.col("i"))).select("a", "b", (F.col("i") / (F.col("m") - F.col("i"))).alias("jaccard"))


def tiled(a: DataFrame, b: DataFrame, id_a: str, id_b: str, side: int = 8) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join with a column tile: each pair of rows meets in just one of side * side tiles of its key."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    a = a.withColumn("_o", each).withColumn("tile", part(id_a) * side + F.col("_o")).drop("_o")
    return a, b.withColumn("_o", each).withColumn("tile", F.col("_o") * side + part(id_b)).drop("_o")
