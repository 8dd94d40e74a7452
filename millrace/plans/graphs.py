"""Queries: the graph of parts and suppliers (edges of lineitem), and that of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.registry import Registry, Tables
from millrace.sources.work import table

registry = Registry()

_E = "WITH e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def _edges(t: Tables):
    return t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


_TREE = """
WITH e AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 0.8 FROM supplier
  UNION ALL SELECT 'n' || c_nationkey, 'r' || (c_nationkey % 5), 0.5 FROM customer),
ed AS (SELECT src, dst, sum(weight) AS weight FROM e GROUP BY ALL), nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)
"""


def _tree(t: Tables):
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.nation.select(k("r", "n_regionkey").alias("src"), k("n", "n_nationkey").alias("dst"), F.lit(1.0).alias("weight"))
    e = e.unionByName(t.supplier.select(k("n", "s_nationkey").alias("src"), k("s", "s_suppkey").alias("dst"), F.lit(0.8).alias("weight")))
    e = e.unionByName(t.customer.select(k("n", "c_nationkey").alias("src"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("dst"), F.lit(0.5).alias("weight")))
    return e.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _nodes(edges):
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


@registry.add(_E + ", d AS (SELECT id, count(DISTINCT i) AS fan_in, count(DISTINCT o) AS fan_out FROM (SELECT src AS id, dst AS o, NULL AS i FROM e UNION ALL SELECT dst, NULL, src FROM e) GROUP BY id) SELECT id, fan_in, fan_out, round((fan_in + fan_out)::DOUBLE / (SELECT max(fan_in) + 1 FROM d), 6) AS centrality FROM d")
def degree_centrality(t: Tables):
    d = G.degrees(_edges(t))
    top = d.agg((F.max("fan_in") + 1).alias("m"))
    return d.crossJoin(F.broadcast(top)).select("id", "fan_in", "fan_out", F.round((F.col("fan_in") + F.col("fan_out")) / F.col("m"), 6).alias("centrality"))


@registry.add(_E + ", d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT id, degree, round(ln(1 + degree) / ln(1 + (SELECT max(degree) FROM d)), 6) AS norm FROM d")
def degree_norm(t: Tables):
    d = G.degrees(_edges(t)).select("id", "degree")
    return d.crossJoin(F.broadcast(d.agg(F.max("degree").alias("m")))).select("id", "degree", F.round(F.log1p("degree") / F.log1p("m"), 6).alias("norm"))


@registry.add("SELECT l_suppkey AS id, round(least(1.0, 0.33 * count(*) FILTER (l_returnflag = 'R')), 6)::DOUBLE AS centrality FROM lineitem GROUP BY l_suppkey")
def flag_centrality(t: Tables):
    """min(1, 0.33 n) of the marked edges of each node."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.round(F.least(F.lit(1.0), 0.33 * F.count_if(F.col("l_returnflag") == "R")), 6).alias("centrality"))


@registry.add(_E + """, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT 's1' AS id), o AS (SELECT DISTINCT dst AS id FROM u JOIN s ON src = id), w AS (SELECT DISTINCT dst AS id FROM u JOIN o ON src = id)
SELECT id, max(p)::DOUBLE AS proximity FROM (SELECT id, 1.0 AS p FROM s UNION ALL SELECT id, 0.7 FROM o UNION ALL SELECT id, 0.4 FROM w) GROUP BY id""")
def two_hop_proximity(t: Tables):
    return G.proximity(_edges(t), t.literal([("s1",)], "id string"))


_STEP = """, r{n} AS (SELECT id, s, linked, 0.15 * s + 0.85 * (coalesce(f, 0) + s * (SELECT coalesce(sum(r) FILTER (NOT linked), 0) FROM r{m})) AS r
  FROM r{m} LEFT JOIN (SELECT dst, sum(r * weight / o) AS f FROM r{m} JOIN ed ON ed.src = r{m}.id JOIN ow ON ow.src = ed.src GROUP BY dst) ON dst = id)"""


_PPR = (
    _TREE
    + ", ow AS (SELECT src, sum(weight) AS o FROM ed GROUP BY src), sd AS (SELECT 'n1' AS id, 0.4::DOUBLE AS s UNION ALL SELECT 'n7', 0.6), r0 AS (SELECT nd.id, coalesce(s, 0) AS s, ow.src IS NOT NULL AS linked, coalesce(s, 0) AS r FROM nd LEFT JOIN sd USING (id) LEFT JOIN ow ON ow.src = nd.id)"
    + "".join(_STEP.format(n=i + 1, m=i) for i in range(5))
)


def _ppr(t: Tables, e):
    return G.personalised_pagerank(_nodes(e), e, t.literal([("n1", 2.0), ("n7", 3.0)], "id string, weight double"), iterations=5, cut=table)


@registry.add(_PPR + " SELECT id, round(r / (SELECT max(r) FROM r5), 6) AS rank FROM r5")
def ppr_5_iterations(t: Tables):
    return _ppr(t, _tree(t)).select("id", F.round("rank", 6).alias("rank"))


@registry.add(
    _PPR
    + """, dg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY id), fl AS (SELECT src AS id, least(1.0, 0.33 * count(*)) AS flags FROM ed WHERE starts_with(dst, 's') GROUP BY src),
u AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), s0 AS (SELECT id FROM sd), o1 AS (SELECT DISTINCT dst AS id FROM u JOIN s0 ON src = id), o2 AS (SELECT DISTINCT dst AS id FROM u JOIN o1 ON src = id), px AS (SELECT id, max(p) AS near FROM (SELECT id, 1.0 AS p FROM s0 UNION ALL SELECT id, 0.7 FROM o1 UNION ALL SELECT id, 0.4 FROM o2) GROUP BY id)
SELECT r5.id, round(greatest(0.0, least(1.0, 0.50 * r / (SELECT max(r) FROM r5) + 0.20 * ln(1 + degree) / ln(1 + (SELECT max(degree) FROM dg)) + 0.15 * coalesce(flags, 0) + 0.15 * coalesce(near, 0))), 6)::DOUBLE AS score FROM r5 JOIN dg USING (id) LEFT JOIN fl USING (id) LEFT JOIN px USING (id)"""
)
def composite_score(t: Tables):
    """Rank, degree, edges to suppliers and nearness to the seeds of each node of one graph, in one score."""
    e = _tree(t)
    d = G.degrees(e).select("id", "degree")
    flags = e.where(F.col("dst").startswith("s")).groupBy(F.col("src").alias("id")).agg(F.least(F.lit(1.0), 0.33 * F.count("*")).alias("flags"))
    near = G.proximity(e.select("src", "dst"), t.literal([("n1",), ("n7",)], "id string"))
    j = _ppr(t, e).join(d, "id").crossJoin(F.broadcast(d.agg(F.max("degree").alias("m")))).join(flags, "id", "left").join(near, "id", "left").fillna({"flags": 0.0, "proximity": 0.0})
    return j.select("id", F.round(G.composite(F.col("rank"), F.log1p("degree") / F.log1p("m"), F.col("flags"), F.col("proximity")), 6).alias("score"))


@registry.add(_TREE.replace("WITH e", "WITH RECURSIVE e") + ", b AS (SELECT 'r0' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM b JOIN ed ON src = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM b GROUP BY id")
def bfs_closure(t: Tables):
    return G.closure(_tree(t), t.literal([("r0",)], "id string"), 3)


@registry.add(_TREE.replace("WITH e", "WITH RECURSIVE e") + ", b AS (SELECT 's3' AS id, 0 AS depth UNION SELECT src, depth + 1 FROM b JOIN ed ON dst = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM b GROUP BY id")
def reverse_closure(t: Tables):
    e = _tree(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(e, t.literal([("s3",)], "id string"), 2)


@registry.add(_TREE.replace("WITH e", "WITH RECURSIVE e") + ", p AS (SELECT [src, dst] AS path, dst AS tip FROM ed WHERE src = 'r1' UNION ALL SELECT list_append(path, dst), dst FROM p JOIN ed ON src = tip WHERE tip <> 'n6' AND len(path) <= 4 AND NOT list_contains(path, dst)) SELECT DISTINCT array_to_string(path, '>') AS path FROM p WHERE tip = 'n6'")
def call_chains(t: Tables):
    return G.simple_paths(_tree(t), "r1", "n6", 4).select(F.array_join("path", ">").alias("path"))


@registry.add(_TREE + """, u AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed), s AS (SELECT 'n1' AS id, 1.0::DOUBLE AS score UNION ALL SELECT 'n2', 0.6),
o AS (SELECT dst AS id, max(score * weight * 0.75) AS score FROM s JOIN u ON src = id GROUP BY dst), w AS (SELECT dst AS id, max(score * weight * 0.75) AS score FROM o JOIN u ON src = id GROUP BY dst),
a AS (SELECT id, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM o UNION ALL SELECT * FROM w) GROUP BY id)
SELECT id, round(score, 6) AS score FROM a ORDER BY score DESC, id LIMIT 30""")
def best_first_expansion(t: Tables):
    return G.best_first(_tree(t), t.literal([("n1", 1.0), ("n2", 0.6)], "id string, score double")).select("id", F.round("score", 6).alias("score"))


@registry.add("""
WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'A' WHEN b.p_partkey IS NULL THEN 'D' ELSE 'M' END AS status
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size <> b.p_size
""")
def version_delta(t: Tables):
    old = t.part.where("p_partkey % 7 <> 0").select("p_partkey", "p_size")
    new = t.part.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    return G.delta(old, new, ["p_partkey"], "p_size")


@registry.add("""
WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0)
SELECT p_partkey, p_size FROM b
""")
def incremental_equals_full(t: Tables):
    """The old index with its delta applied; the oracle is the full new index."""
    old = t.part.where("p_partkey % 7 <> 0").select("p_partkey", "p_size")
    new = t.part.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    d = G.delta(old, new, ["p_partkey"], "p_size")
    kept = old.join(d, "p_partkey", "left_anti")
    return kept.unionByName(new.join(d.where("status <> 'D'"), "p_partkey", "left_semi"))


@registry.add(_E + " SELECT e.src, e.dst FROM e WHERE e.src IN ('p1','p2','p3') OR e.dst IN ('s1') UNION SELECT e.dst, e.src FROM e WHERE e.src IN ('p1','p2','p3') OR e.dst IN ('s1')")
def adjacent_edges(t: Tables):
    """Edges at given nodes, in both directions, by an equi-join over the undirected view."""
    ids = t.literal([("p1",), ("p2",), ("p3",), ("s1",)], "id string")
    both = G.undirected(_edges(t))
    hit = both.join(F.broadcast(ids), both["src"] == ids["id"]).select("src", "dst")
    return hit.unionByName(hit.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
