"""Queries: retrieval metrics, calibration, intervals, tests, dominance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import statistics as S
from millrace.registry import Registry, Tables

registry = Registry()

_OBS = "WITH o AS (SELECT d.doc_id, d.source, d.lang, (d.n_chars % 101) / 100::DOUBLE AS c, quality = 1 AS y FROM documents d JOIN labels USING (doc_id))"


def _obs(t: Tables):
    return t.documents.join(t.labels, "doc_id").select("doc_id", "source", "lang", ((F.col("n_chars") % 101) / F.lit(100.0)).alias("c"), (F.col("quality") == 1).alias("y"))


_IR = (
    _OBS
    + """, r AS (SELECT source, y, row_number() OVER (PARTITION BY source ORDER BY c DESC, doc_id) AS place FROM o), h AS (SELECT *, sum(y::INT) OVER (PARTITION BY source ORDER BY place) AS hits FROM r),
a AS (SELECT source, sum(y::INT) AS n, count(*) AS listed, sum(y::INT) FILTER (place <= 10) AS at_k, min(place) FILTER (y) AS first, sum(y::INT / log2(place + 1)) FILTER (place <= 10) AS dcg, sum(hits / place) FILTER (y) AS pr FROM h GROUP BY source)
SELECT source, round(CASE WHEN n > 0 THEN at_k::DOUBLE / n ELSE 1 END, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(CASE WHEN n > 0 THEN dcg / list_sum([1 / log2(i + 1) for i in generate_series(1, least(n, 10, listed)::BIGINT)]) ELSE 1 END, 6) AS ndcg, round(CASE WHEN n > 0 THEN pr / n ELSE 1 END, 6) AS map FROM a"""
)


@registry.add(_IR)
def ir_metrics(t: Tables):
    r = _obs(t).select("source", F.col("y").alias("relevant"), F.row_number().over(Window.partitionBy("source").orderBy(F.desc("c"), "doc_id")).alias("place"))
    return S.ir_metrics(r, "source", 10).select("source", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg", "map")])


@registry.add(_OBS + """, b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, sum(y::INT) AS y, sum(c) AS c, sum((c - y::INT) ** 2) AS e FROM o GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(e) / sum(n), 6) AS brier, round(sum(abs(y - c)) / sum(n), 6) AS ece, round(sum(y) / sum(n), 6) AS accuracy, round(sum(c) / sum(n), 6) AS confidence FROM b""")
def calibration_ece(t: Tables):
    c = S.calibration(_obs(t), "c", "y")
    return c.select("n", *[F.round(x, 6).alias(x) for x in ("brier", "ece", "accuracy", "confidence")])


@registry.add(_OBS + """, b AS (SELECT least(floor(c * 5), 4) AS bin, count(*) AS n, sum(y::INT) AS y, sum(c) AS c FROM o GROUP BY 1) SELECT round(sum(abs(y - c)) / sum(n), 6) AS ece FROM b""")
def belief_ece(t: Tables):
    return S.calibration(_obs(t), "c", "y", 5).select(F.round("ece", 6).alias("ece"))


@registry.add(_OBS + """ SELECT th::DOUBLE AS threshold, round(count(*) FILTER (c >= th)::DOUBLE / count(*), 6) AS coverage, round(coalesce((count(*) FILTER (c >= th AND y))::DOUBLE / nullif(count(*) FILTER (c >= th), 0), 1), 6) AS accuracy,
count(*) FILTER (c >= th) AS answered, count(*) FILTER (c < th) AS abstained FROM o, (VALUES (0.2), (0.5), (0.8), (1.5)) AS v(th) GROUP BY th""")
def selective_risk(t: Tables):
    return S.selective(_obs(t), "c", "y", [0.2, 0.5, 0.8, 1.5]).select("threshold", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"), "answered", "abstained")


@registry.add(_OBS + ", s AS (SELECT list_sort(list(c)) AS a, count(*) AS n FROM o) SELECT a[greatest(1, least(n, ceil((n + 1) * 0.1)))::BIGINT] AS cutoff FROM s")
def conformal_cutoff(t: Tables):
    return S.conformal_cutoff(_obs(t), "c", 0.1)


@registry.add("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(stddev_samp(c_acctbal), 4) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
def summary_statistics(t: Tables):
    x = "c_acctbal"
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.percentile(x, 0.5), 4).alias("median"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))


_Q = "WITH s AS (SELECT event_type, list_sort(list(value)) AS a, count(*) AS n FROM events GROUP BY 1) "


@registry.add(_Q + "SELECT event_type, a[n // 2 + 1] AS median, a[floor(n * 0.95)::BIGINT + 1] AS p95, a[floor(n * 0.99)::BIGINT + 1] AS p99 FROM s")
def index_quantiles(t: Tables):
    """sorted[n/2], sorted[int(.95 n)], sorted[int(.99 n)], by ranks in a window: no group is gathered."""
    w = Window.partitionBy("event_type")
    r = t.events.select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = {"median": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95), "p99": F.floor(F.col("n") * 0.99)}
    return r.groupBy("event_type").agg(*[F.max(F.when(F.col("i") == p, F.col("value"))).alias(k) for k, p in at.items()])


@registry.add(_Q + "SELECT event_type, a[round(0.5 * (n - 1))::BIGINT + 1] AS p50, a[round(0.95 * (n - 1))::BIGINT + 1] AS p95 FROM s")
def nearest_rank_percentiles(t: Tables):
    w = Window.partitionBy("event_type")
    r = t.events.select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return r.groupBy("event_type").agg(*[F.max(F.when(F.col("i") == F.round(q * (F.col("n") - 1)), F.col("value"))).alias(k) for k, q in (("p50", 0.5), ("p95", 0.95))])


_D = "WITH d AS (SELECT l_suppkey, l_extendedprice * l_discount - l_extendedprice * l_tax AS delta FROM lineitem)"


@registry.add(_D + ", s AS (SELECT l_suppkey, (count(*) FILTER (delta > 1e-9) - count(*) FILTER (delta < -1e-9))::DOUBLE / count(*) AS d, avg(delta) AS mean FROM d GROUP BY 1) SELECT l_suppkey, round(mean, 4) AS mean_delta, round(d, 6) AS cliffs_delta, CASE WHEN abs(d) < 0.147 THEN 'negligible' WHEN abs(d) < 0.33 THEN 'small' WHEN abs(d) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM s")
def paired_delta(t: Tables):
    d = t.lineitem.select("l_suppkey", (F.col("l_extendedprice") * F.col("l_discount") - F.col("l_extendedprice") * F.col("l_tax")).alias("delta"))
    s = d.groupBy("l_suppkey").agg(F.avg("delta").alias("mean"), S.cliffs_delta(F.col("delta")).alias("d"))
    return s.select("l_suppkey", F.round("mean", 4).alias("mean_delta"), F.round("d", 6).alias("cliffs_delta"), S.effect_name(F.col("d")).alias("effect"))


@registry.add()
def bootstrap_ci(t: Tables):
    """Rows only: resamples are hashed draws."""
    return S.bootstrap_interval(t.orders, "o_totalprice", 200, key="o_orderkey")


@registry.add()
def permutation_test(t: Tables):
    d = t.supplier.select("s_suppkey", (F.col("s_acctbal") - 4500.0).alias("d"))
    return S.permutation_p(d, "d", 200, key="s_suppkey")


@registry.add("""
WITH p AS (SELECT o_orderpriority AS name, (count(*) FILTER (o_orderstatus = 'F') % 97 + 1) / 1000::DOUBLE AS p FROM orders GROUP BY 1), r AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS rank, count(*) OVER () AS m FROM p),
t AS (SELECT *, 0.05 / (m - rank + 1) AS threshold FROM r) SELECT name, p, rank, round(threshold, 8) AS threshold, min((p <= threshold)::INT) OVER (ORDER BY rank) = 1 AS significant FROM t
""")
def holm_bonferroni(t: Tables):
    p = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(((F.count_if(F.col("o_orderstatus") == "F") % 97 + 1) / F.lit(1000.0)).alias("p"))
    return S.holm(p, "name", "p").withColumn("threshold", F.round("threshold", 8))


@registry.add("""
WITH s AS (SELECT source, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT *, k / n AS p, 1.95996 AS z FROM s),
c AS (SELECT *, (p + z*z/(2*n)) / (1 + z*z/n) AS c, z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n) AS m FROM w) SELECT source, round(greatest(0, c - m), 6) AS lower, round(least(1, c + m), 6) AS upper FROM c
""")
def wilson_interval(t: Tables):
    s = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return s.select("source", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@registry.add("WITH s AS (SELECT l_returnflag, round(stddev_samp(l_quantity / 50.0), 6) AS sigma FROM lineitem GROUP BY l_returnflag) SELECT l_returnflag, sigma::DOUBLE AS sigma, ceil(round(pow(sqrt(2) * 2.8 * sigma / 0.05, 2), 6))::BIGINT AS n FROM s")
def power_analysis(t: Tables):
    """How many rows of each kind a difference of 0.05 in the share of a full quantity needs, by the deviation measured."""
    s = t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp(F.col("l_quantity") / 50.0), 6).alias("sigma"))
    return s.select("l_returnflag", "sigma", S.power_sizes(F.lit(0.05), F.col("sigma")).alias("n"))


@registry.add("""
WITH s AS (SELECT l_suppkey, count(*) AS seen, round(stddev_samp(l_discount), 9) AS sigma FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, seen, sigma, CASE WHEN sigma <= 0 THEN 1 ELSE ceil(round(pow(sqrt(2) * 2.8 * sigma / 0.005, 2), 6)) END::BIGINT AS needed, seen >= CASE WHEN sigma <= 0 THEN 1 ELSE ceil(round(pow(sqrt(2) * 2.8 * sigma / 0.005, 2), 6)) END AS enough FROM s
""")
def power_by_supplier(t: Tables):
    """How many rows of each supplier a difference of half a per cent in discount needs, and whether they are there."""
    s = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("seen"), F.round(F.stddev_samp("l_discount"), 9).alias("sigma"))
    needed = S.power_sizes(F.lit(0.005), F.col("sigma"))
    return s.withColumn("needed", needed).withColumn("enough", F.col("seen") >= F.col("needed"))


@registry.add("""
WITH p AS (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R')::DOUBLE / count(*) AS success, round(avg(l_extendedprice), 2) AS cost, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1)
SELECT a.l_suppkey, EXISTS (SELECT 1 FROM p b WHERE b.success >= a.success AND b.cost <= a.cost AND b.tax <= a.tax AND (b.success > a.success OR b.cost < a.cost OR b.tax < a.tax)) AS dominated FROM p a
""")
def pareto_frontier(t: Tables):
    p = t.lineitem.groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") != "R") / F.count("*")).alias("success"), F.round(F.avg("l_extendedprice"), 2).alias("cost"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return S.pareto(p, ["success"], ["cost", "tax"]).select("l_suppkey", "dominated")


@registry.add(_OBS + """, c AS (SELECT lang, count(*) FILTER (c >= 0.5 AND y) AS tp, count(*) FILTER (c >= 0.5 AND NOT y) AS fp, count(*) FILTER (c < 0.5 AND NOT y) AS tn, count(*) FILTER (c < 0.5 AND y) AS fn FROM o GROUP BY lang)
SELECT lang, tp, fp, tn, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM c""")
def confusion_by_stratum(t: Tables):
    hit, y = F.col("c") >= 0.5, F.col("y")
    c = _obs(t).groupBy("lang").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return c.select("lang", "tp", "fp", "tn", "fn", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(tp + tn, tp + fp + tn + fn).alias("accuracy"), r(2 * tp, 2 * tp + fp + fn).alias("f1"))


@registry.add(_OBS + ", q AS (SELECT lang, c, y::INT AS r, 0.2 + 0.6 * c AS prop, 0.3 + 0.5 * c AS qhat, doc_id % 2 AS a FROM o) SELECT lang, round(avg(qhat), 6) AS direct, round(avg(CASE WHEN a = 1 THEN r / prop ELSE 0 END), 6) AS ips, round(avg(qhat + CASE WHEN a = 1 THEN (r - qhat) / prop ELSE 0 END), 6) AS doubly_robust FROM q GROUP BY lang")
def off_policy_value(t: Tables):
    q = _obs(t).select("lang", F.col("y").cast("int").alias("r"), (0.2 + 0.6 * F.col("c")).alias("prop"), (0.3 + 0.5 * F.col("c")).alias("qhat"), (F.col("doc_id") % 2 == 1).alias("a"))
    w = lambda x: F.when(F.col("a"), x / F.col("prop")).otherwise(0.0)
    return q.groupBy("lang").agg(F.round(F.avg("qhat"), 6).alias("direct"), F.round(F.avg(w(F.col("r"))), 6).alias("ips"), F.round(F.avg(F.col("qhat") + w(F.col("r") - F.col("qhat"))), 6).alias("doubly_robust"))


@registry.add("WITH t AS (SELECT sum(value) AS all_ FROM events), k AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1) SELECT event_type, round((all_ - v) / all_, 6) AS without, round(v / all_, 6) AS drop_ FROM k, t")
def leave_one_kind_out(t: Tables):
    k = t.events.groupBy("event_type").agg(F.sum("value").alias("v"))
    return k.crossJoin(F.broadcast(k.agg(F.sum("v").alias("all_")))).select("event_type", F.round((F.col("all_") - F.col("v")) / F.col("all_"), 6).alias("without"), F.round(F.col("v") / F.col("all_"), 6).alias("drop_"))


@registry.add("SELECT event_type, round(corr(value, user_id::DOUBLE), 6) AS r FROM events GROUP BY 1")
def pearson(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.corr("value", F.col("user_id").cast("double")), 6).alias("r"))


@registry.add("SELECT round(sum(o_totalprice), 2) AS reported, round(sum(cents) / 100, 2) AS recomputed, abs(sum(o_totalprice) - sum(cents) / 100) <= 0.01 * count(*) AS reconciled FROM (SELECT o_totalprice, round(o_totalprice * 100) AS cents FROM orders)")
def reconcile_costs(t: Tables):
    o = t.orders.select("o_totalprice", F.round(F.col("o_totalprice") * 100).alias("cents"))
    return o.agg(F.round(F.sum("o_totalprice"), 2).alias("reported"), F.round(F.sum("cents") / 100, 2).alias("recomputed"), (F.abs(F.sum("o_totalprice") - F.sum("cents") / 100) <= 0.01 * F.count("*")).alias("reconciled"))
