"""Retrieval metrics, calibration, intervals, tests and dominance as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import global_rank


def ir_metrics(ranked: DataFrame, by: str, k: int) -> DataFrame:
    """ranked: by, place (1-based), relevant (boolean), for whole rankings. recall@k, mrr, ndcg@k, map per group."""
    w = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = ranked.withColumn("rel", F.col("relevant").cast("int")).withColumn("hits", F.sum(F.col("relevant").cast("int")).over(w))
    gain = F.col("rel") / F.log2(F.col("place") + 1)
    a = r.groupBy(by).agg(
        F.sum("rel").alias("n"),
        F.sum(F.when(F.col("place") <= k, F.col("rel")).otherwise(0)).alias("at_k"),
        F.min(F.when(F.col("rel") == 1, F.col("place"))).alias("first"),
        F.sum(F.when(F.col("place") <= k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("place")).otherwise(0.0)).alias("precisions"),
        F.count("*").alias("listed"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k), F.col("listed")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = F.col("n") > 0
    return a.select(
        by,
        F.when(some, F.col("at_k") / F.col("n")).otherwise(1.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(some, F.col("dcg") / ideal).otherwise(1.0).alias("ndcg"),
        F.when(some, F.col("precisions") / F.col("n")).otherwise(1.0).alias("map"),
    )


def calibration(obs: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, ece, accuracy, confidence."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(confidence)))
    o = obs.select(c.alias("c"), F.col(correct).cast("double").alias("y"))
    b = o.groupBy(F.least(F.floor(F.col("c") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("c").alias("c"), F.sum(F.pow(F.col("c") - F.col("y"), 2)).alias("e"))
    return b.agg(F.sum("n").alias("n"), (F.sum("e") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("y") - F.col("c"))) / F.sum("n")).alias("ece"), (F.sum("y") / F.sum("n")).alias("accuracy"), (F.sum("c") / F.sum("n")).alias("confidence"))


def selective(obs: DataFrame, confidence: str, correct: str, thresholds: list[float]) -> DataFrame:
    """A row for each threshold: coverage, accuracy and risk of answering only above it; one pass over the observations."""
    each = obs.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    a = each.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col(confidence) >= F.col("threshold")).alias("answered"), F.count_if((F.col(confidence) >= F.col("threshold")) & F.col(correct)).alias("right"))
    acc = F.when(F.col("answered") > 0, F.col("right") / F.col("answered")).otherwise(1.0)
    return a.select("threshold", (F.col("answered") / F.col("n")).alias("coverage"), acc.alias("accuracy"), (1 - acc).alias("risk"), "answered", (F.col("n") - F.col("answered")).alias("abstained"))


def order_statistic(values: str, place: Column) -> Column:
    """The value at a 0-based place of the group's sorted values."""
    a = F.array_sort(F.collect_list(values))
    return F.element_at(a, place.cast("int") + 1)


def conformal_cutoff(df: DataFrame, score: str, alpha: float) -> DataFrame:
    """The value of rank ceil((n + 1) alpha), by ranks over ranges: no task holds all rows."""
    scores = df.select(F.col(score).alias("s"))
    n = scores.where("s is not null").count()
    at = min(n, max(1, math.ceil(round((n + 1) * alpha, 9))))
    return global_rank(scores.where("s is not null"), "r", F.col("s")).where(F.col("r") == at).select(F.col("s").alias("cutoff"))


def cliffs_delta(d: Column) -> Column:
    return (F.count_if(d > 1e-9) - F.count_if(d < -1e-9)) / F.count(d)


def effect_name(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def wilson(k: Column, n: Column, z: float = 1.95996) -> tuple[Column, Column]:
    p = k / n
    d = 1 + z * z / n
    c = (p + z * z / (2 * n)) / d
    m = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), c - m), F.least(F.lit(1.0), c + m)


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down: a test is significant while every smaller p has passed its threshold."""
    w = Window.orderBy(p, name)
    r = tests.withColumn("rank", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy()))
    r = r.withColumn("threshold", alpha / (F.col("m") - F.col("rank") + 1))
    ok = F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return r.select(name, p, F.col("rank").cast("long").alias("rank"), "threshold", (ok == 1).alias("significant"))


def power_size(least: float, sigma: float, alpha: float = 0.05, power: float = 0.80) -> int:
    if least <= 0 or sigma <= 0:
        return 1
    za = 2.576 if alpha <= 0.01 else 1.645 if alpha >= 0.10 else 1.96
    zb = 1.282 if power >= 0.90 else 0.84
    return math.ceil(2 * ((za + zb) * sigma / least) ** 2)


def power_sizes(least: Column, sigma: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """As power_size, for a column of deviations; null where the deviation is."""
    unit = math.sqrt(2) * ((2.576 if alpha <= 0.01 else 1.645 if alpha >= 0.10 else 1.96) + (1.282 if power >= 0.90 else 0.84))
    return F.when((least <= 0) | (sigma <= 0), F.lit(1).cast("long")).otherwise(F.ceil(F.round(F.pow(unit * sigma / least, 2), 6)))


def pareto(points: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """points with dominated. A point of which another is no worse in all and better in one is dominated.

    For the moderate numbers of configurations this is asked of, the other side is broadcast by Spark where its
    size allows; rows equal in all measures do not dominate each other.
    """
    m = points.select(*up, *down).distinct()
    o = m.select(*[F.col(c).alias(f"_{c}") for c in [*up, *down]])
    no_worse, better = F.lit(True), F.lit(False)
    for c in up:
        no_worse, better = no_worse & (F.col(f"_{c}") >= F.col(c)), better | (F.col(f"_{c}") > F.col(c))
    for c in down:
        no_worse, better = no_worse & (F.col(f"_{c}") <= F.col(c)), better | (F.col(f"_{c}") < F.col(c))
    free = m.join(o, no_worse & better, "left_anti").withColumn("_free", F.lit(True))
    return points.join(free, [*up, *down], "left").withColumn("dominated", F.col("_free").isNull()).drop("_free")


def _draws(values: DataFrame, value: str, key: str | None) -> DataFrame:
    """v, h: values that are not null, with a hash of the row's key; without a key, of the value and its number among equal ones. No hash depends on the layout."""
    v = values.where(F.col(value).isNotNull())
    if key is not None:
        return v.select(F.col(value).cast("double").alias("v"), F.xxhash64(key).alias("h"))
    equal = v.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    return equal.select("v", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("i")).select("v", F.xxhash64("v", "i").alias("h"))


def _repeats(draws: DataFrame, repeats: int, seed: int, weigh) -> DataFrame:
    """b, s, n: for each repeat the weighted sum of values and the sum of weights; a task gives a row for each repeat, however many rows it reads."""
    seeds = np.random.default_rng(seed).integers(0, 1 << 63, repeats, dtype=np.uint64)

    def run(batches):
        s, n, seen = np.zeros(repeats), np.zeros(repeats), False
        for batch in batches:
            v, h = batch.column("v").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            seen = seen or len(v) > 0
            for b, x in enumerate(seeds):
                z = h ^ x  # spread the bits: multiply and shift
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = weigh((z ^ (z >> np.uint64(31))) >> np.uint64(11))
                s[b] += w @ v
                n[b] += w.sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats, dtype=np.int32)), pa.array(s), pa.array(n)], names=["b", "s", "n"])

    return draws.mapInArrow(run, "b int, s double, n double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def bootstrap_interval(values: DataFrame, value: str, resamples: int = 200, confidence: float = 0.95, seed: int = 42, key: str | None = None) -> DataFrame:
    """lower, upper of the mean: each resample weighs every row by a hashed Poisson(1) number. Rows are read once; which
    tasks read them does not matter (sums of doubles may differ in their last digits)."""
    cdf = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(12)])
    means = _repeats(_draws(values, value, key), resamples, seed, lambda x: np.searchsorted(cdf, x / float(1 << 53)).astype(float)).select((F.col("s") / F.nullif("n", F.lit(0.0))).alias("m"))
    lo, hi = math.floor((1 - confidence) / 2 * resamples), min(resamples - 1, math.ceil((1 + confidence) / 2 * resamples))
    return means.agg(order_statistic("m", F.lit(lo)).alias("lower"), order_statistic("m", F.lit(hi)).alias("upper"))


def permutation_p(values: DataFrame, value: str, permutations: int = 200, seed: int = 42, key: str | None = None) -> DataFrame:
    """p of |mean| under random signs, signs by hash."""
    draws = _draws(values, value, key)
    null = _repeats(draws, permutations, seed, lambda x: np.where(x & np.uint64(1), 1.0, -1.0))
    seen = draws.agg(F.abs(F.sum("v")).alias("o"))
    return null.crossJoin(F.broadcast(seen)).agg((F.count_if(F.abs("s") >= F.col("o") - 1e-9) / F.count("*")).alias("p"))