"""Connected components by hooking to the least neighbour and contraction, as joins and aggregates.

Each round points every vertex at the least vertex among itself and its
neighbours, follows pointers once more, and replaces the edges by those between
what is pointed at. At least half of the vertices that still have edges vanish in
a round; a star takes one round. Minima are pre-aggregated by Spark, so a vertex
with a third of all edges is a few rows per task, and the joins on it are of the
kind that adaptive execution splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.keys import table


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (any order, repeats and loops allowed; no nulls). Returns v, comp: for every vertex of an edge
    between two vertices, the least vertex of its component."""
    e = table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while e.limit(1).count():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        p = table(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("p")), "pointers")
        up = p.select(F.col("v").alias("p"), F.col("p").alias("q"))
        p = table(p.join(up, "p").select("v", F.col("q").alias("comp")), "pointers")
        if labels is None:
            labels = p
        else:
            step = p.select(F.col("v").alias("comp"), F.col("comp").alias("next"))
            labels = table(labels.join(step, "comp", "left").select("v", F.coalesce("next", "comp").alias("comp")), "labels")
        a = p.select(F.col("v").alias("a"), F.col("comp").alias("x"))
        b = p.select(F.col("v").alias("b"), F.col("comp").alias("y"))
        e = e.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = table(e, "edges")
    if labels is None:
        labels = e.select(F.col("a").alias("v"), F.col("a").alias("comp"))
    return labels
