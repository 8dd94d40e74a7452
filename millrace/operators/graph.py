"""Graph operators over edge tables (src, dst, weight): degrees, proximity, personalised PageRank, closures, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, so a lookup by either end is an equi-join."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    """id, fan_in and fan_out (distinct neighbours), degree (edges)."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("o"), F.lit(None).cast(edges.schema["src"].dataType).alias("i"))
    in_ = edges.select(F.col("dst").alias("id"), F.lit(None).cast(edges.schema["dst"].dataType).alias("o"), F.col("src").alias("i"))
    pairs = out.unionByName(in_).groupBy("id", "o", "i").agg(F.count("*").alias("n"))  # distinct first: a hub is many small rows
    return pairs.groupBy("id").agg(F.count("i").alias("fan_in"), F.count("o").alias("fan_out"), F.sum("n").alias("degree"))


def proximity(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, proximity: 1.0 for seeds, 0.7 one step away, 0.4 two steps away (either direction)."""
    both = undirected(edges).distinct()
    near = seeds.select("id")
    one = both.join(near, both["src"] == near["id"]).select(F.col("dst").alias("id")).distinct()
    two = both.join(one, both["src"] == one["id"]).select(F.col("dst").alias("id")).distinct()
    all_ = seeds.select("id", F.lit(1.0).alias("p")).unionByName(one.withColumn("p", F.lit(0.7))).unionByName(two.withColumn("p", F.lit(0.4)))
    return all_.groupBy("id").agg(F.max("p").alias("proximity"))


def personalised_pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, iterations: int = 10, cut=None, tolerance: float | None = None) -> DataFrame:
    """id, rank, scaled so that the largest is 1. nodes: id; edges: src, dst, weight; seeds: id, weight.

    Mass of nodes without out-edges goes back to the seeds. `cut`, a function of a DataFrame, may break the lineage
    between rounds (a checkpoint) when there are many. With a tolerance, which needs a cut, the rounds end once the ranks
    move by less than it in all; only that sum comes to the driver.
    """
    if tolerance is not None and cut is None:
        raise ValueError("a tolerance reads each round's ranks: give a cut")
    total = seeds.join(nodes, "id", "left_semi").agg(F.sum("weight").alias("t"))
    s = seeds.join(nodes, "id", "left_semi").crossJoin(F.broadcast(total)).select("id", (F.col("weight") / F.col("t")).alias("s"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    prob = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p"))
    base = nodes.join(s, "id", "left").join(out.select(F.col("src").alias("id"), F.lit(True).alias("linked")), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("linked", F.lit(False)).alias("linked"))
    r = base.select("id", "s", "linked", F.col("s").alias("r"))
    for _ in range(iterations):
        lost = r.agg(F.coalesce(F.sum(F.when(~F.col("linked"), F.col("r"))), F.lit(0.0)).alias("lost"))
        flow = r.join(prob, r["id"] == prob["src"]).groupBy("dst").agg(F.sum(F.col("r") * F.col("p")).alias("f"))
        r = r.join(flow, r["id"] == flow["dst"], "left").crossJoin(F.broadcast(lost))
        new = alpha * F.col("s") + (1 - alpha) * (F.coalesce("f", F.lit(0.0)) + F.col("lost") * F.col("s"))
        r = r.select("id", "s", "linked", new.alias("r"), *([F.abs(new - F.col("r")).alias("moved")] if tolerance is not None else []))
        if cut is not None:
            r = cut(r)
        if tolerance is not None:
            moved, r = r.agg(F.sum("moved").alias("m")).first()["m"], r.drop("moved")
            if (moved or 0.0) < tolerance:
                break
    top = r.agg(F.max("r").alias("m"))
    return r.crossJoin(F.broadcast(top)).select("id", F.when(F.col("m") > 0, F.col("r") / F.col("m")).otherwise(0.0).alias("rank"))


def composite(rank, degree_norm, flags, near):
    """A node's score: 0.50 of its rank, 0.20 of its degree, 0.15 each of its marked edges and its nearness, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.50 * rank + 0.20 * degree_norm + 0.15 * flags + 0.15 * near))


def closure(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, depth: nodes reached from seeds along edges in at most `depth` steps, with the least number of steps."""
    found = seeds.select("id", F.lit(0).alias("depth")).distinct()
    front = found
    for d in range(1, depth + 1):
        step = edges.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = step.join(found, "id", "left_anti").select("id", F.lit(d).alias("depth"))
        found = found.unionByName(front)
    return found


def simple_paths(edges: DataFrame, start, end, depth: int) -> DataFrame:
    """path: arrays of nodes without repeats, from start to end, of at most `depth` edges."""
    front = edges.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    done = front.where(F.col("at") == end).select("path")
    for _ in range(depth - 1):
        open_ = front.where(F.col("at") != end)
        front = open_.join(edges, open_["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        done = done.unionByName(front.where(F.col("at") == end).select("path"))
    return done.distinct()


def best_first(edges: DataFrame, seeds: DataFrame, decay: float = 0.75, depth: int = 2, limit: int = 30) -> DataFrame:
    """id, score: seeds' scores, decayed along weighted edges for `depth` steps, largest per node, top `limit`."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    front = all_ = seeds.select("id", "score")
    for _ in range(depth):
        front = front.join(both, front["id"] == both["src"]).groupBy("dst").agg(F.max(F.col("score") * F.col("weight") * decay).alias("score")).select(F.col("dst").alias("id"), "score")
        all_ = all_.unionByName(front)
    return all_.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def delta(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status: A (only new), D (only old), M (both, other value)."""
    added = new.join(old, keys, "left_anti").select(*keys, F.lit("A").alias("status"))
    gone = old.join(new, keys, "left_anti").select(*keys, F.lit("D").alias("status"))
    o = old.select(*keys, F.col(value).alias("_old"))
    changed = new.join(o, keys).where(~F.col(value).eqNullSafe(F.col("_old"))).select(*keys, F.lit("M").alias("status"))
    return added.unionByName(gone).unionByName(changed)
