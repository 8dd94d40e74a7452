"""Scoring, staleness, hazard, belief and economics of stored memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Authority of a source, boost of a kind.
AUTHORITY = {"user": 1.0, "explicit": 1.0, "test": 0.99, "source": 0.97, "commit": 0.94, "doc": 0.86, "inference": 0.55}
KIND_BOOST = {"decision": 1.0, "failure": 0.98, "constraint": 0.96, "state": 0.88, "observation": 0.76, "code": 0.74, "fact": 0.65}
AUTHORITY_FLOOR = 0.60
#: Weights of the linear utility.
WEIGHTS = {"semantic": 1.15, "lexical": 1.00, "affinity": 0.90, "authority": 0.75, "evidence": 0.60, "reuse": 0.45, "graph": 0.35, "stale": -1.50}
LENGTH_PENALTY = 0.15
#: Probability of an event if a belief holds, and if it does not.
LIKELIHOODS = {
    "user_decision": (0.95, 0.05),
    "test_pass": (0.92, 0.08),
    "test_fail": (0.10, 0.85),
    "git_diff_modified": (0.40, 0.70),
    "git_diff_clean": (0.88, 0.15),
    "agent_inference": (0.75, 0.30),
}
OTHER_LIKELIHOOD = (0.70, 0.30)
#: Hazard and value of one reuse by kind.
ECONOMICS = {"decision": (0.05, 0.0050), "constraint": (0.04, 0.0060), "failure": (0.12, 0.0040), "state": (0.35, 0.0015), "observation": (0.25, 0.0010), "code": (0.15, 0.0020), "handoff": (0.50, 0.0030)}
OTHER_ECONOMICS = (0.20, 0.0020)


def lookup(c: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.lower(c) == k, F.lit(v)) if out is None else out.when(F.lower(c) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def authority(c: Column) -> Column:
    return lookup(c, AUTHORITY, 0.45)


def confidence_weight(c: Column) -> Column:
    return F.when(c <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), c))


def utility(signals: dict[str, Column], tokens: Column) -> Column:
    score = F.lit(0.0)
    for name, w in WEIGHTS.items():
        score = score + w * signals[name]
    return score - LENGTH_PENALTY * F.least(F.lit(1.0), F.greatest(F.lit(1.0), tokens.cast("double")) / 4000.0)


def staleness(memories: DataFrame, changed: DataFrame, revision: int) -> DataFrame:
    """memories: id, location, scope, valid_from, invalidated_at, superseded_by. changed: path, status (a small list).

    Adds risk and hard. Path prefixes are found by equality: each location is exploded into its ancestors and each
    changed path too, so no pair of paths is compared that does not share one.
    """
    def ancestors(c):
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    m = memories.select("id", "location").where("location <> ''")
    up = m.select("id", "location", F.explode(ancestors(F.col("location"))).alias("p")).join(changed.select(F.col("path").alias("p"), "path", "status"), "p")
    down = m.select("id", "location").join(changed.select(F.explode(ancestors(F.col("path"))).alias("location"), "path", "status"), "location")
    hits = up.select("id", "path", "status").unionByName(down.select("id", "path", "status")).distinct()
    hits = hits.groupBy("id").agg(F.bool_or(F.col("status") == "D").alias("gone"), F.count("*").alias("n"))
    j = memories.join(hits, "id", "left")
    hard = F.col("invalidated_at").isNotNull() | (F.col("superseded_by").isNotNull()) | (F.col("valid_from") > revision)
    unscoped = (F.col("location") == "") | (F.col("scope") == "repository")
    risk = (
        F.when(hard, 1.0)
        .when(F.col("valid_from") == revision, 0.0)
        .when(unscoped, F.when(F.col("valid_from") != revision, 0.25).otherwise(0.0))
        .when(F.col("n").isNull(), 0.0)
        .when(F.col("gone"), 1.0)
        .otherwise(F.least(F.lit(0.90), 1 - F.pow(F.lit(0.2), F.col("n"))))
    )
    gone = ~hard & (F.col("valid_from") != revision) & ~unscoped & F.coalesce(F.col("gone"), F.lit(False))
    return j.withColumn("risk", risk).withColumn("hard", F.coalesce(hard, F.lit(False)) | F.coalesce(gone, F.lit(False))).drop("gone", "n")


def hazard(kind: Column, authority_: Column, scope: Column, churn: Column, commits: Column, symbols: Column) -> Column:
    base = lookup(kind, {"decision": 0.05, "architecture": 0.05, "constraint": 0.10, "failure": 0.15, "negative_knowledge": 0.15, "convention": 0.20}, 0.40)
    base = base * lookup(authority_, {"user": 0.5, "developer": 0.5, "test": 0.7, "verification": 0.7, "inference": 1.3, "agent": 1.3}, 1.0)
    moved = F.when((scope == "") | (scope == "*"), F.least(F.lit(0.3), churn * 0.5)).otherwise(F.least(F.lit(0.5), churn))
    raw = base + 0.35 * moved + 0.25 * (1 - F.exp(-0.05 * commits)) + 0.20 * F.least(F.lit(0.3), symbols * 0.08)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), raw))


def adaptive_ttl(h: Column) -> Column:
    """Seconds: seven days scaled by the hazard, between two hours and ninety days."""
    s = F.floor(7 * 86400 * (0.20 / (F.when(h <= 0, 1e-4).otherwise(h) + 1e-4)))
    return F.least(F.lit(90 * 86400), F.greatest(F.lit(7200), s)).cast("long")


def belief(prior: Column, events: Column) -> Column:
    """Posterior after the events of an array, in order, each step clamped."""

    def step(p, e):
        p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
        yes, no = lookup(e, {k: v[0] for k, v in LIKELIHOODS.items()}, OTHER_LIKELIHOOD[0]), lookup(e, {k: v[1] for k, v in LIKELIHOODS.items()}, OTHER_LIKELIHOOD[1])
        return F.greatest(F.lit(0.001), F.least(F.lit(0.999), yes * p / (yes * p + no * (1 - p))))

    return F.aggregate(events, prior, step)


def believe(events: DataFrame, key: str, event: str, prior: float) -> DataFrame:
    """key, evidence, posterior: `belief` after all events of each key. events lie in order, all of a key in one partition,
    and are read batch by batch, so a key with many of them is never held as an array."""
    e = F.col(event)
    yes, no = lookup(e, {k: v[0] for k, v in LIKELIHOODS.items()}, OTHER_LIKELIHOOD[0]), lookup(e, {k: v[1] for k, v in LIKELIHOODS.items()}, OTHER_LIKELIHOOD[1])
    rows = events.select(F.col(key), yes.cast("double").alias("yes"), no.cast("double").alias("no"))

    def run(batches):
        import pyarrow as pa

        at, n, p, started, kind = None, 0, prior, False, None
        for batch in batches:
            out: list[tuple] = []
            kind = batch.schema.field(0).type
            for k, y, x in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or k != at:
                    if started:
                        out.append((at, n, p))
                    at, n, p, started = k, 0, prior, True
                p = max(0.01, min(0.99, p))
                n, p = n + 1, max(0.001, min(0.999, y * p / (y * p + x * (1 - p))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], [key, "evidence", "posterior"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([n]), pa.array([p])], [key, "evidence", "posterior"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, evidence long, posterior double")


def economics(kind: Column, reuse: Column, tokens: Column, age: Column) -> dict[str, Column]:
    h = lookup(kind, {k: v[0] for k, v in ECONOMICS.items()}, OTHER_ECONOMICS[0])
    value = lookup(kind, {k: v[1] for k, v in ECONOMICS.items()}, OTHER_ECONOMICS[1])
    survival = F.exp(-h * age)
    # prices times counts are whole numbers divided once, as exact decimals are: persist turns on the last digit where gross meets cost
    gross = (reuse + 1) * 8 / 10.0 * survival * value
    cost = tokens * 5 / 1e6 + 0.000010 * age + (1 - survival) * 0.0050
    net = gross - cost
    return {"survival": survival, "net": net, "roi": F.when(cost > 0, gross / cost).otherwise(0.0), "persist": (net > 0) & (survival > 0.15)}
