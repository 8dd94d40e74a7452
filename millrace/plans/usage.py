"""Queries: metering, invoices, cost, routing, rate limits and sessions. Usage events are orders by customer, streams are events by user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.registry import Registry, Tables
from millrace.streaming import sessions as session_operators

registry = Registry()

#: Base price, included requests and tokens, price of a request and of a million tokens beyond.
TIERS = [("free", 0.0, 1000, 5_000_000, 0.0, 0.0), ("pro", 29.0, 50_000, 250_000_000, 0.001, 0.50), ("team", 99.0, 250_000, 1_500_000_000, 0.0008, 0.40), ("enterprise", 499.0, 2_000_000, 10_000_000_000, 0.0005, 0.30)]
#: Requests a second and burst.
LIMITS = {"free": (5.0, 10.0), "pro": (30.0, 50.0), "team": (100.0, 150.0), "enterprise": (500.0, 1000.0)}
_TIER_SQL = "(VALUES " + ", ".join(f"('{n}', {b}::DOUBLE, {r}::BIGINT, {k}::BIGINT, {q}::DOUBLE, {m}::DOUBLE)" for n, b, r, k, q, m in TIERS) + ") AS tier(tier, base, requests, tokens, per_request, per_mtok)"

_USE = """
WITH u AS (SELECT o_custkey AS tenant, o_orderdate AS ts, o_orderpriority AS model, o_orderstatus AS endpoint, floor(o_totalprice * 10)::BIGINT AS input, floor(o_totalprice)::BIGINT AS output, floor(o_totalprice * 3)::BIGINT AS cached, o_orderstatus = 'F' AS hit, o_totalprice / 100000 AS cost FROM orders),
a AS (SELECT tenant, count(*) AS requests, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cached)::BIGINT AS cached, count(*) FILTER (hit) AS hits, sum(CASE WHEN hit THEN cached * 2.7 / 1e6 ELSE 0 END) AS saved, sum(cost) AS cost FROM u GROUP BY tenant)
"""


def _usage(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select(
        F.col("o_custkey").alias("tenant"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("endpoint"),
        F.floor(p * 10).cast("long").alias("input"),
        F.floor(p).cast("long").alias("output"),
        F.floor(p * 3).cast("long").alias("cached"),
        (F.col("o_orderstatus") == "F").alias("hit"),
        (p / 100000).alias("cost"),
    )


def _tenants(t: Tables):
    return _usage(t).groupBy("tenant").agg(
        F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cached").alias("cached"), F.count_if("hit").alias("hits"), F.sum(F.when(F.col("hit"), F.col("cached") * 2.7 / 1e6).otherwise(0.0)).alias("saved"), F.sum("cost").alias("cost")
    )


@registry.add(_USE + "SELECT tenant, requests, input, output, cached, hits, round(hits::DOUBLE / requests, 6) AS hit_rate, round(cost, 4) AS cost FROM a")
def tenant_usage(t: Tables):
    return _tenants(t).select("tenant", "requests", "input", "output", "cached", "hits", F.round(F.col("hits") / F.col("requests"), 6).alias("hit_rate"), F.round("cost", 4).alias("cost"))


@registry.add(_USE + "SELECT tenant, model, count(*) AS n, sum(input + output)::BIGINT AS tokens FROM u GROUP BY tenant, model")
def usage_by_model(t: Tables):
    return _usage(t).groupBy("tenant", "model").agg(F.count("*").alias("n"), F.sum(F.col("input") + F.col("output")).alias("tokens"))


@registry.add(_USE + "SELECT model, endpoint, count(*) AS n, round(sum(cost), 4) AS cost FROM u GROUP BY GROUPING SETS ((model), (endpoint), ())")
def usage_histograms(t: Tables):
    u = _usage(t).select("model", "endpoint", "cost")
    return u.groupingSets([["model"], ["endpoint"], []], "model", "endpoint").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@registry.add(
    _USE
    + f""", j AS (SELECT a.*, tier.* EXCLUDE (requests, tokens), tier.requests AS incl_r, tier.tokens AS incl_t, input + output AS toks FROM a JOIN {_TIER_SQL} ON tier.tier = CASE a.tenant % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'team' ELSE 'enterprise' END),
o AS (SELECT *, greatest(requests * 5000 - incl_r, 0) * per_request + greatest(toks * 397 - incl_t, 0) / 1e6 * per_mtok AS over FROM j)
SELECT tenant, tier, base, round(over, 2) AS overage, round(base + round(over, 2), 2) AS total FROM o"""
)
def usage_invoice(t: Tables):
    """Base price and what is beyond the tier, for usage scaled up to a month."""
    tiers = t.literal(TIERS, "tier string, base double, incl_r long, incl_t long, per_request double, per_mtok double")
    name = F.element_at(F.array(*[F.lit(x[0]) for x in TIERS]), (F.col("tenant") % 4 + 1).cast("int"))
    j = _tenants(t).withColumn("tier", name).join(F.broadcast(tiers), "tier")
    over = F.greatest(F.col("requests") * 5000 - F.col("incl_r"), F.lit(0)) * F.col("per_request") + F.greatest((F.col("input") + F.col("output")) * 397 - F.col("incl_t"), F.lit(0)) / 1e6 * F.col("per_mtok")
    return j.withColumn("overage", F.round(over, 2)).select("tenant", "tier", "base", "overage", F.round(F.col("base") + F.col("overage"), 2).alias("total"))


@registry.add(
    _USE
    + """, s AS (SELECT tenant, greatest(requests * 50000 - input, 0) AS i, greatest(requests * 32768 - output, 0) AS r, requests * 8500 AS p, cached, saved FROM a)
SELECT tenant, i AS input_saved, r AS reasoning_saved, p AS pruned, round(i * 3.0 / 1e6 + r * 2.0 / 1e6 + p * 3.0 / 1e6 + saved, 4) AS total_usd, i + r + p + cached AS total_tokens FROM s"""
)
def savings_breakdown(t: Tables):
    s = _tenants(t).select("tenant", F.greatest(F.col("requests") * 50000 - F.col("input"), F.lit(0)).alias("input_saved"), F.greatest(F.col("requests") * 32768 - F.col("output"), F.lit(0)).alias("reasoning_saved"), (F.col("requests") * 8500).alias("pruned"), "cached", "saved")
    usd = F.col("input_saved") * 3.0 / 1e6 + F.col("reasoning_saved") * 2.0 / 1e6 + F.col("pruned") * 3.0 / 1e6 + F.col("saved")
    return s.select("tenant", "input_saved", "reasoning_saved", "pruned", F.round(usd, 4).alias("total_usd"), (F.col("input_saved") + F.col("reasoning_saved") + F.col("pruned") + F.col("cached")).alias("total_tokens"))


@registry.add(_USE + ", m AS (SELECT tenant, date_trunc('month', ts)::DATE AS month, sum(input + output) AS tokens FROM u GROUP BY ALL) SELECT tenant, month, tokens::BIGINT AS tokens, round(tokens / 2000000.0, 7)::DOUBLE AS share FROM m WHERE tokens / 2000000.0 >= 0.8")
def quota_alerts(t: Tables):
    m = _usage(t).groupBy("tenant", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.sum(F.col("input") + F.col("output")).alias("tokens"))
    return m.withColumn("share", F.round(F.col("tokens") / 2000000.0, 7)).where(F.col("tokens") / 2000000.0 >= 0.8)


@registry.add("""
WITH u AS (SELECT l_returnflag AS provider, sum(l_quantity * 1000) AS input, sum(l_quantity * 300) AS cached, sum(l_quantity * 200) AS output, sum(l_quantity * 50) AS reasoning FROM lineitem GROUP BY 1),
p AS (SELECT * FROM (VALUES ('A', 15.0, 1.5, 75.0), ('N', 1.25, 0.3125, 5.0)) AS v(provider, pi, pc, po)), j AS (SELECT u.*, coalesce(pi, 3.0)::DOUBLE AS pi, coalesce(pc, 0.75)::DOUBLE AS pc, coalesce(po, 15.0)::DOUBLE AS po FROM u LEFT JOIN p USING (provider))
SELECT provider, round((input - cached) / 1e6 * pi, 4) AS input_usd, round(cached / 1e6 * pc, 4) AS cached_usd, round(greatest(output - reasoning, 0) / 1e6 * po, 4) AS output_usd, round(reasoning / 1e6 * po, 4) AS reasoning_usd FROM j
""")
def usage_cost(t: Tables):
    """Cost by bucket with prices by provider; a provider without a price takes the general one."""
    q = F.col("l_quantity")
    u = t.lineitem.groupBy(F.col("l_returnflag").alias("provider")).agg(F.sum(q * 1000).alias("input"), F.sum(q * 300).alias("cached"), F.sum(q * 200).alias("output"), F.sum(q * 50).alias("reasoning"))
    p = t.literal([("A", 15.0, 1.5, 75.0), ("N", 1.25, 0.3125, 5.0)], "provider string, pi double, pc double, po double")
    j = u.join(F.broadcast(p), "provider", "left").fillna({"pi": 3.0, "pc": 0.75, "po": 15.0})
    usd = lambda x, y: F.round(x / 1e6 * F.col(y), 4)
    return j.select("provider", usd(F.col("input") - F.col("cached"), "pi").alias("input_usd"), usd(F.col("cached"), "pc").alias("cached_usd"), usd(F.greatest(F.col("output") - F.col("reasoning"), F.lit(0.0)), "po").alias("output_usd"), usd(F.col("reasoning"), "po").alias("reasoning_usd"))


@registry.add("SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price, max(o_orderdate) AS effective_at FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1")
def latest_price_as_of(t: Tables):
    """The latest entry of each key at a given time."""
    o = t.orders.where(F.col("o_orderdate") <= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'"))
    return o.groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"), F.max("o_orderdate").alias("effective_at"))


_MODELS = [("local", 0.55, 0.0, 0.0, 8000, 0.1), ("small", 0.72, 0.25, 0.025, 32000, 0.5), ("large", 0.93, 3.0, 0.3, 200000, 0.8)]
_BUDGETS = [1000, 2500, 5000, 10000, 20000]
_JOINT = (
    "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {q}::DOUBLE, {i}::DOUBLE, {c}::DOUBLE, {k}, {b}::DOUBLE)" for n, q, i, c, k, b in _MODELS) + ") AS v(model, q, pi, pc, ctx, base)), "
    "b AS (SELECT unnest([1000, 2500, 5000, 10000, 20000]) AS budget), k AS (SELECT source, (sum(n_chars) // 40)::BIGINT AS total FROM documents GROUP BY 1), "
    "x AS (SELECT *, least(budget, total) AS tk FROM k, m, b WHERE least(budget, total) <= ctx), "
    "p AS (SELECT *, least(0.99, greatest(0.05, q * (0.4 + 0.6 * greatest(0.1, 1 - exp(-tk::DOUBLE / total))))) AS prob FROM x), "
    "e AS (SELECT *, round(prob * 10 - (0.7 * tk * pi + 0.3 * tk * pc) / 1e6 - 0.1 * (base + tk * 0.00005), 9) AS ev FROM p) "
)


@registry.add(_JOINT + "SELECT source, model, budget, round(ev, 6) AS ev FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY ev DESC, model, budget) = 1")
def joint_route(t: Tables):
    """The model and budget of the largest expected value for each source's candidates."""
    m = t.literal(_MODELS, "model string, q double, pi double, pc double, ctx int, base double").crossJoin(t.literal([(x,) for x in _BUDGETS], "budget int"))  # 15 rows
    k = t.documents.groupBy("source").agg(F.floor(F.sum("n_chars") / 40).cast("long").alias("total"))
    x = k.crossJoin(F.broadcast(m)).withColumn("tk", F.least("budget", "total")).where("tk <= ctx")
    tk = F.col("tk")
    prob = F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.col("q") * (0.4 + 0.6 * F.greatest(F.lit(0.1), 1 - F.exp(-tk.cast("double") / F.col("total"))))))
    ev = F.round(prob * 10 - (0.7 * tk * F.col("pi") + 0.3 * tk * F.col("pc")) / 1e6 - 0.1 * (F.col("base") + tk * 0.00005), 9)
    x = x.withColumn("ev", ev)
    w = Window.partitionBy("source").orderBy(F.desc("ev"), "model", "budget")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "model", "budget", F.round("ev", 6).alias("ev"))


_FRONT = """
WITH g AS (SELECT l_returnflag AS model, l_linenumber AS effort, avg(1 - l_discount) AS q, stddev_samp(1 - l_discount) AS sq, avg((l_tax < 0.05)::INT) AS s, stddev_samp((l_tax < 0.05)::INT) AS ss, avg(l_extendedprice) AS cost, count(*) AS n FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN n > 1 THEN greatest(q - 1.96 * sq / sqrt(n), 0.01) ELSE q END AS qlcb, CASE WHEN n > 1 THEN greatest(s - 1.96 * ss / sqrt(n), 0.01) ELSE s END AS slcb FROM g)
"""


def _frontier(t: Tables):
    q, s = 1 - F.col("l_discount"), (F.col("l_tax") < 0.05).cast("int")
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("effort")).agg(F.avg(q).alias("q"), F.stddev_samp(q).alias("sq"), F.avg(s).alias("s"), F.stddev_samp(s).alias("ss"), F.avg("l_extendedprice").alias("cost"), F.count("*").alias("n"))
    lcb = lambda m, d: F.when(F.col("n") > 1, F.greatest(F.col(m) - 1.96 * F.col(d) / F.sqrt("n"), F.lit(0.01))).otherwise(F.col(m))
    return g.withColumn("qlcb", lcb("q", "sq")).withColumn("slcb", lcb("s", "ss"))


@registry.add(_FRONT + "SELECT model, effort, n, round(q, 6) AS quality, round(qlcb, 6) AS quality_lcb, round(slcb, 6) AS success_lcb, round(cost, 4) AS cost FROM f")
def empirical_frontier(t: Tables):
    return _frontier(t).select("model", "effort", "n", F.round("q", 6).alias("quality"), F.round("qlcb", 6).alias("quality_lcb"), F.round("slcb", 6).alias("success_lcb"), F.round("cost", 4).alias("cost"))


@registry.add(_FRONT + "SELECT arg_min(model, (round(cost, 4), model, effort)) AS model, arg_min(effort, (round(cost, 4), model, effort)) AS effort, round(min(cost), 4) AS cost FROM f WHERE qlcb >= 0.9 AND slcb >= 0.3")
def minimum_sufficient(t: Tables):
    """The cheapest configuration whose lower bounds meet the floor."""
    f = _frontier(t).where("qlcb >= 0.9 and slcb >= 0.3")
    key = F.struct(F.round("cost", 4), "model", "effort")
    return f.agg(F.min_by("model", key).alias("model"), F.min_by("effort", key).alias("effort"), F.round(F.min("cost"), 4).alias("cost"))


@registry.add("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000 AS gain, lead(o_totalprice / 1000) OVER w AS nxt, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)), m AS (SELECT *, nxt - gain >= 20 AS worth FROM r)
SELECT o_custkey, coalesce(min(CASE WHEN NOT coalesce(worth, false) THEN n END), max(n)) AS knee FROM m GROUP BY 1
""")
def reasoning_knee(t: Tables):
    """The first step after which the next one is not worth its cost."""
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    r = t.orders.select("o_custkey", F.row_number().over(w).alias("n"), (F.lead("o_totalprice").over(w) / 1000 - F.col("o_totalprice") / 1000 >= 20).alias("worth"))
    return r.groupBy("o_custkey").agg(F.coalesce(F.min(F.when(~F.coalesce("worth", F.lit(False)), F.col("n"))), F.max("n")).cast("long").alias("knee"))


_BUCKET = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, 0::BIGINT AS n, 3.0::DOUBLE AS tokens, NULL::DOUBLE AS last, NULL::BOOLEAN AS ok, NULL::BIGINT AS event_id FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT b.user_id, b.n + 1, CASE WHEN least(3.0, tokens + coalesce(s - last, 0) * 0.0002) >= 1 THEN least(3.0, tokens + coalesce(s - last, 0) * 0.0002) - 1 ELSE least(3.0, tokens + coalesce(s - last, 0) * 0.0002) END, s, least(3.0, tokens + coalesce(s - last, 0) * 0.0002) >= 1, e.event_id
  FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused, round(arg_max(tokens, n), 4) AS tokens FROM b WHERE n > 0 GROUP BY user_id
"""


@registry.add(_BUCKET)
def token_bucket(t: Tables):
    """A token bucket for each key, as a fold over its events in order (the stream form is in millrace.streaming)."""
    from millrace.streaming.limits import bucket_fold

    e = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_id"))).alias("a"))
    return rows.select("user_id", bucket_fold(F.col("a"), 0.0002, 3.0).alias("b")).select("user_id", "b.allowed", "b.refused", F.round("b.tokens", 4).alias("tokens"))


@registry.add("""
WITH g AS (SELECT user_id, event_id, ts, event_type, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS started, max(ts) AS ended, count(*) FILTER (event_type = 'error') AS failures FROM s GROUP BY user_id, session
""")
def sessions(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    s = t.events.withColumn("new", F.when(gap <= 6 * 3600 * 1_000_000, 0).otherwise(1))
    s = s.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count_if(F.col("event_type") == "error").alias("failures"))


@registry.add("""
WITH s AS (SELECT user_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, count(*) AS steps, count(*) FILTER (before AND NOT bad) AS backtracks, round(1 - (count(*) FILTER (before AND NOT bad))::DOUBLE / count(*), 6) AS efficiency FROM s GROUP BY user_id
""")
def session_backtrack(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    s = t.events.select("user_id", bad.alias("bad"), F.lag(bad).over(w).alias("before"))
    n = F.count_if(F.coalesce("before", F.lit(False)) & ~F.col("bad"))
    return s.groupBy("user_id").agg(F.count("*").alias("steps"), n.alias("backtracks"), F.round(1 - n / F.count("*"), 6).alias("efficiency"))


@registry.add("""
WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k') AS model, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS clicks, count(DISTINCT model) FILTER (n <= 50) AS models FROM e GROUP BY user_id
""")
def session_event_stats(t: Tables):
    e = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("model"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.countDistinct(F.when(F.col("n") <= 50, F.col("model"))).alias("models"))


_AGENT_EVENTS = """a AS (SELECT user_id AS repo, event_id, ts, CASE WHEN json_extract_string(props, '$.k')::INT < 10 THEN 'reviewer' ELSE 'coder' END AS agent,
 CASE event_type WHEN 'signup' THEN 'userprompt' WHEN 'error' THEN 'toolfailure' WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'sessionend' ELSE 'stop' END ELSE 'tooluse' END AS event_type, event_type AS tool, 'fact: ' || json_extract_string(props, '$.k') AS text FROM events)"""


def _agent_events(t: Tables):
    """The events read as those of an agent: a user is a repository, signups are prompts, errors failed tools, purchases stops (dear ones end the session)."""
    kind = F.when(F.col("event_type") == "signup", "userprompt").when(F.col("event_type") == "error", "toolfailure").when((F.col("event_type") == "purchase") & (F.col("value") > 50), "sessionend").when(F.col("event_type") == "purchase", "stop").otherwise("tooluse")
    k = F.get_json_object("props", "$.k")
    return t.events.select(F.col("user_id").alias("repo"), "event_id", "ts", F.when(k.cast("int") < 10, "reviewer").otherwise("coder").alias("agent"), kind.alias("event_type"), F.col("event_type").alias("tool"), F.concat(F.lit("fact: "), k).alias("text"))


@registry.add("WITH " + _AGENT_EVENTS + """,
o AS (SELECT *, coalesce(lag(agent) OVER w <> agent OR lag(event_type) OVER w = 'sessionend', true) AS opened FROM a WINDOW w AS (PARTITION BY repo ORDER BY ts, event_id)),
s AS (SELECT *, sum(opened::INT) OVER w AS session, min(CASE WHEN event_type = 'userprompt' THEN (ts, event_id, text) END) OVER w AS asked FROM o WINDOW w AS (PARTITION BY repo ORDER BY ts, event_id)),
n AS (SELECT *, row_number() OVER w AS at, first_value(asked) OVER w AS work FROM s WINDOW w AS (PARTITION BY repo, session ORDER BY ts, event_id)),
c AS (SELECT n.repo, n.text, min((x.ts, x.event_id)) AS first FROM n JOIN n x ON x.repo = n.repo AND x.session = n.session AND x.at >= n.at AND x.at - n.at < 50 AND x.event_type IN ('stop', 'sessionend') GROUP BY n.repo, n.text),
k AS (SELECT repo, first[2] AS event_id, count(*) AS n FROM c GROUP BY ALL)
SELECT repo::VARCHAR AS repo, n.event_id, session::INT AS session, opened, work[3] AS work_item, CASE event_type WHEN 'toolfailure' THEN 'failure' WHEN 'userprompt' THEN 'observation' END AS kind,
 CASE event_type WHEN 'toolfailure' THEN tool || ' failed: ' || text WHEN 'userprompt' THEN 'User task: ' || text END AS content, coalesce(k.n, 0)::BIGINT AS consolidated FROM n LEFT JOIN k USING (repo, event_id)
""")
def session_ingest(t: Tables):
    """Sessions, work items, memories and consolidations of all events: the batch form of the stateful stream."""
    return session_operators.batch(_agent_events(t)).drop("ts")


@registry.add("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(t: Tables):
    e = t.events.withColumn("w", F.window("ts", "1 hour"))
    return e.groupBy(F.col("w.start").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@registry.add("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM o WHERE n <= 3")
def recent_n_per_key(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.orders.withColumn("n", F.row_number().over(w)).where("n <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@registry.add("""
SELECT round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 3) AS hit_rate, round(sum(o_totalprice) / 1000, 1) AS thousands, count(*) AS traces, count(DISTINCT o_custkey) AS tenants, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders
""")
def summary_report(t: Tables):
    return t.orders.agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 3).alias("hit_rate"), F.round(F.sum("o_totalprice") / 1000, 1).alias("thousands"), F.count("*").alias("traces"), F.countDistinct("o_custkey").alias("tenants"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@registry.add("""
WITH s AS (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS ok, count(*) AS n, sum(l_extendedprice) AS cost, sum(l_quantity) AS tok FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(ok::DOUBLE / n, 6) AS success, round(cost / nullif(ok, 0), 4) AS cost_per_success, round(ok / (cost / 1000), 6) AS efficiency, round(1 - tok / (n * 50), 6) AS compression FROM s
""")
def kpi_summary(t: Tables):
    s = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("ok"), F.count("*").alias("n"), F.sum("l_extendedprice").alias("cost"), F.sum("l_quantity").alias("tok"))
    return s.select("l_suppkey", F.round(F.col("ok") / F.col("n"), 6).alias("success"), F.round(F.try_divide("cost", "ok"), 4).alias("cost_per_success"), F.round(F.col("ok") / (F.col("cost") / 1000), 6).alias("efficiency"), F.round(1 - F.col("tok") / (F.col("n") * 50), 6).alias("compression"))


@registry.add("""
WITH s AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT o_custkey, m, n, round(sum(v) OVER (PARTITION BY o_custkey ORDER BY m), 2) AS running FROM s
""")
def running_usage(t: Tables):
    s = t.orders.groupBy("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    return s.select("o_custkey", "m", "n", F.round(F.sum("v").over(Window.partitionBy("o_custkey").orderBy("m")), 2).alias("running"))


_RISK = "CASE WHEN r < 0.15 THEN 0 WHEN r < 0.40 THEN 2 WHEN r < 0.70 THEN CASE WHEN b >= 0.005 THEN 3 ELSE 2 END WHEN b >= 0.05 THEN 4 WHEN b >= 0.005 THEN 3 ELSE 2 END"


@registry.add(f"WITH o AS (SELECT o_orderkey, least(1.0, greatest(0.0, (o_orderkey % 100) / 100::DOUBLE * ((o_orderkey % 7) / 5::DOUBLE))) AS r, (o_orderkey % 13) / 200::DOUBLE AS b FROM orders) SELECT o_orderkey, round(r, 6) AS risk, {_RISK} AS level, round(r - b, 6) AS voi FROM o")
def verification_level(t: Tables):
    k = F.col("o_orderkey")
    o = t.orders.select("o_orderkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k % 100) / F.lit(100.0) * ((k % 7) / F.lit(5.0)))).alias("r"), ((k % 13) / F.lit(200.0)).alias("b"))
    return o.select("o_orderkey", F.round("r", 6).alias("risk"), F.expr(_RISK).alias("level"), F.round(F.col("r") - F.col("b"), 6).alias("voi"))
