"""Queries: scans, lookups, joins, aggregates, windows and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.registry import Registry, Tables

registry = Registry()


def portable(name: str, sql: str, *tables: str) -> None:
    """A query whose text both engines read."""

    def run(t: Tables):
        return t.spark.sql(sql, **{x: getattr(t, x) for x in tables})

    registry.add(sql.format(**{x: x for x in tables}), name)(run)


portable("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM {lineitem} GROUP BY l_returnflag, l_linestatus", "lineitem")
portable("scan_filter", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 300000 AND o_orderstatus = 'O'", "orders")
portable("count_nodes", "SELECT count(*) AS n FROM {part}", "part")
portable("exact_lookup", "SELECT c_custkey, c_name FROM {customer} WHERE c_name = 'Customer#000000042' OR c_custkey = 42", "customer")
portable("nocase_lookup", "SELECT n_nationkey, n_name FROM {nation} WHERE lower(n_name) IN ('nation_1', 'nation_17')", "nation")
portable("prefix_lookup", "SELECT page_id, url FROM {pages} WHERE url LIKE 'https://blog.%' AND url LIKE '%/en/%'", "pages")
portable("in_list_lookup", "SELECT p_partkey, p_brand FROM {part} WHERE p_partkey IN (1, 2, 3, 5, 8, 13, 21)", "part")
portable("equi_join", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n_name", "customer", "nation")
portable("star_join", "SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY r_name, p_brand", "lineitem", "supplier", "nation", "region", "part")
portable("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c_custkey", "customer", "orders")
portable("full_join_versions", "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS added, b.k IS NULL AS removed FROM (SELECT p_partkey AS k FROM {part} WHERE p_partkey % 3 <> 0) a FULL OUTER JOIN (SELECT p_partkey AS k FROM {part} WHERE p_partkey % 4 <> 0) b ON a.k = b.k", "part")
portable("semi_join", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", "customer", "orders")
portable("anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)", "customer", "orders")
portable("union_distinct", "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 UNION SELECT p_partkey FROM {part} WHERE p_size > 45", "lineitem", "part")
portable("intersect_keys", "SELECT l_suppkey AS k FROM {lineitem} INTERSECT SELECT s_suppkey FROM {supplier} WHERE s_acctbal > 0", "lineitem", "supplier")
portable("except_keys", "SELECT s_suppkey AS k FROM {supplier} EXCEPT SELECT l_suppkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_quantity > 49", "supplier", "lineitem")
portable("cube_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
portable("rollup_months", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
portable("window_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS q FROM {part}", "part")
portable("window_distribution", "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM {supplier}", "supplier")
portable("moving_average", "SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM {orders}", "orders")
portable("top_n_sort", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
portable("scalar_subquery", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.5 FROM {part})", "part")
portable("case_histogram", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM {lineitem} GROUP BY 1", "lineitem")
portable("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag", "lineitem")
portable("label_join_quality", "SELECT lang, count(*) AS n, sum(quality) AS good, sum(toxic) AS toxic FROM {documents} d JOIN {labels} b ON d.doc_id = b.doc_id GROUP BY lang", "documents", "labels")


@registry.add("SELECT nk AS n_nationkey, list_sort(list(s_suppkey)) AS suppliers FROM (SELECT s_nationkey AS nk, s_suppkey FROM supplier) GROUP BY nk")
def adjacency_lists(t: Tables):
    return t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("suppliers"))


@registry.add("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
def pivot_status(t: Tables):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity")).withColumnsRenamed({"O": "o", "F": "f"})


@registry.add("SELECT p_partkey, measure, v FROM (SELECT p_partkey, unnest(['size', 'price']) AS measure, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part)")
def unpivot_part(t: Tables):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "measure", "v")


@registry.add("""
SELECT e.event_id, (SELECT arg_max(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'error'
""")
def as_of_join(t: Tables):
    """The latest purchase of the same user at or before each error: a window over both, no range join."""
    p = t.events.where("event_type in ('purchase', 'error')")
    w = Window.partitionBy("user_id").orderBy(F.col("ts"), F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return p.select("event_id", "event_type", last.alias("last_purchase")).where("event_type = 'error'").select("event_id", "last_purchase")


@registry.add("""
SELECT o_orderkey, b.lo AS band FROM orders JOIN (SELECT unnest([0, 50000, 150000, 300000]) AS lo, unnest([50000, 150000, 300000, 100000000]) AS hi) b ON o_totalprice >= b.lo AND o_totalprice < b.hi
""")
def range_join_bands(t: Tables):
    b = t.literal([(0, 50000), (50000, 150000), (150000, 300000), (300000, 100000000)], "lo int, hi int")  # four rows
    return t.orders.join(F.broadcast(b), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi"))).select("o_orderkey", F.col("lo").alias("band"))


@registry.add("""
WITH c AS (SELECT page_id, 1 AS tier, 1.0 AS s FROM pages WHERE url LIKE '%/en/1%' UNION ALL SELECT page_id, 2, 0.8 FROM pages WHERE url LIKE '%blog%' UNION ALL SELECT page_id, 3, 0.5 FROM pages WHERE url LIKE '%example%'),
b AS (SELECT page_id, min(tier) AS tier FROM c GROUP BY page_id) SELECT page_id, tier FROM b ORDER BY tier, page_id LIMIT 40
""")
def tiered_search(t: Tables):
    """Four ways to find a row, from exact to loose; each row in its best tier, tiers in order."""
    hit = lambda p, n: t.pages.where(F.col("url").like(p)).select("page_id", F.lit(n).alias("tier"))
    c = hit("%/en/1%", 1).unionByName(hit("%blog%", 2)).unionByName(hit("%example%", 3))
    return c.groupBy("page_id").agg(F.min("tier").alias("tier")).orderBy("tier", "page_id").limit(40)
