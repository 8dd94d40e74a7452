"""What changed files bear upon: statuses against a manifest, dependents, contexts built on them, memories to look at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.work import table


def statuses(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status of two manifests (path, hash): A, D, M, or U for what is unchanged. One row a path on each side is meant;
    of several the largest hash counts. A null hash is a value of its own."""
    a, b = (d.groupBy("path").agg(F.max("hash").alias(n), F.lit(True).alias(f"in_{n}")) for d, n in ((old, "old"), (new, "new")))
    s = F.when(F.col("in_old").isNull(), "A").when(F.col("in_new").isNull(), "D").when(F.col("old").eqNullSafe(F.col("new")), "U").otherwise("M")
    return a.join(b, "path", "full").select("path", s.alias("status"))


def dependents(changes: DataFrame, deps: DataFrame) -> DataFrame:
    """path, distance: files that depend, over any number of steps, on a changed one (path, status; U does not count) and
    have not changed themselves. deps: path, needs. Each round joins the newest front only and is written, so a plan does not
    grow with the depth; only whether a round found any comes to the driver."""
    edges = table(deps.select("path", "needs").where("path <> needs").distinct(), "deps")
    seen = table(changes.where("status <> 'U'").select("path").distinct().withColumn("distance", F.lit(0)), "affected")
    front, distance = seen, 0
    while not front.isEmpty():
        distance += 1
        step = edges.join(front.select(F.col("path").alias("needs")), "needs").select("path").distinct()
        front = table(step.join(seen, "path", "left_anti").withColumn("distance", F.lit(distance)), "affected")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def _base(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def endings(paths: DataFrame, others: DataFrame) -> DataFrame:
    """p, f: pairs of a path (path) and another one (path) of which one ends with the other, each pair once.

    Every ending would be a row for each character of a path. Here the shorter one either has a slash, then both have the
    same last name, or it has none, then it is an ending of the other's last name; both are joins by equality. Empty and
    null paths match nothing."""
    c = paths.where("path <> ''").select(F.col("path").alias("p")).distinct()
    f = others.where("path <> ''").select(F.col("path").alias("f")).distinct()
    either = F.col("p").endswith(F.col("f")) | F.col("f").endswith(F.col("p"))
    same = c.withColumn("b", _base(F.col("p"))).join(f.withColumn("b", _base(F.col("f"))), "b").where(either).select("p", "f")
    ends = lambda d, x: d.withColumn("b", _base(F.col(x))).where("b <> ''").withColumn("i", F.explode(F.sequence(F.lit(1), F.length("b")))).withColumn("e", F.right("b", F.col("i")))
    bare = lambda d, x: d.where(~F.col(x).contains("/")).withColumn("e", F.col(x))
    longer = ends(c, "p").join(bare(f, "f"), "e").select("p", "f")
    shorter = bare(c, "p").join(ends(f, "f"), "e").select("p", "f")
    return same.unionByName(longer).unionByName(shorter).distinct()


def built_on(contexts: DataFrame, changed: DataFrame) -> DataFrame:
    """key: the contexts (key, path: what each was built on) of which a path ends with a changed one (path), or the other way."""
    hit = endings(contexts, changed).select(F.col("p").alias("path")).distinct()
    return contexts.join(hit, "path", "left_semi").select("key").distinct()


def touched(memories: DataFrame, changed: DataFrame) -> DataFrame:
    """id, files: memories (id, location) at, above or below a changed path (path), and the number of such paths. Locations
    and paths are exploded into the folders above them, so only what shares one is joined."""

    def above(c: Column) -> Column:
        parts = F.split(c, "/")
        return F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))

    m = memories.where("location <> ''").select("id", "location")
    p = changed.where("path <> ''").select("path").distinct()
    up = m.select("id", above(F.col("location")).alias("path")).join(p, "path")
    down = m.join(p.select("path", above(F.col("path")).alias("location")), "location").select("id", "path")
    return up.unionByName(down).distinct().groupBy("id").agg(F.count("*").alias("files"))
