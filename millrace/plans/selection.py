"""Queries: further selection, sufficiency, policy and cache operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.embedding import bag_vector, embedding, positional_vector
from millrace.operators import asks as K
from millrace.operators import packing as P
from millrace.plans.memories import _RANKED, _ranked, _top
from millrace.registry import Registry, Tables

registry = Registry()


@registry.add()
def value_of_information_select(t: Tables):
    return P.select_by(_top(t), "source", 4000, "value_of_information", ("kind", "affinity", "conf"))


_NOISY = (
    _RANKED.replace("WITH mem", "WITH RECURSIVE mem")
    + """, o AS (SELECT source, id, greatest(1, tokens) AS tokens, semantic AS v, row_number() OVER (PARTITION BY source ORDER BY round(semantic * (1 + 0.2 * re) / greatest(1, tokens), 12) DESC, id) AS n FROM k),
g AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS spent, 0::BIGINT AS taken, 1.0::DOUBLE AS wrong, false AS done FROM (SELECT DISTINCT source FROM o)
 UNION ALL SELECT g.source, g.n + 1, CASE WHEN NOT done AND spent + tokens <= 2000 THEN spent + tokens ELSE spent END, CASE WHEN NOT done AND spent + tokens <= 2000 THEN taken + 1 ELSE taken END,
  CASE WHEN NOT done AND spent + tokens <= 2000 THEN wrong * (1 - v * 0.8) ELSE wrong END, done OR (spent + tokens <= 2000 AND 1 - wrong * (1 - v * 0.8) >= 0.85 AND spent + tokens >= 200) FROM g JOIN o ON o.source = g.source AND o.n = g.n + 1)
SELECT source, arg_max(spent, n) AS spent, arg_max(taken, n) AS taken, round(1 - arg_max(wrong, n), 6) AS correct FROM g GROUP BY source"""
)


@registry.add(_NOISY)
def noisy_or_pack(t: Tables):
    o = F.round(F.col("semantic") * (1 + 0.2 * F.col("re")) / F.greatest(F.lit(1), F.col("tokens")), 12)
    items = F.array_sort(F.collect_list(F.struct((-F.col("o")).alias("o"), "id", "tokens", F.col("semantic").alias("score"))))
    return P.fitting(_ranked(t).withColumn("o", o), ["source"], 2000, F.desc("o"), F.col("id")).groupBy("source").agg(P.noisy_or(items, 2000).alias("g")).select("source", "g.spent", F.size("g.chosen").cast("long").alias("taken"), F.round(1 - F.col("g.wrong"), 6).alias("correct"))


@registry.add("""
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, o_custkey % 4 AS a, (o_custkey + 1 + o_orderkey % 3) % 4 AS b, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 ELSE 0.5 END::DOUBLE AS s FROM orders),
e AS (SELECT 0::BIGINT AS n, [1200, 1200, 1200, 1200]::DOUBLE[] AS r UNION ALL SELECT e.n + 1, [CASE WHEN i = a THEN r[i + 1] + 32 * (s - 1 / (1 + pow(10, (r[b + 1] - r[a + 1]) / 400))) WHEN i = b THEN r[i + 1] - 32 * (s - 1 / (1 + pow(10, (r[b + 1] - r[a + 1]) / 400))) ELSE r[i + 1] END for i in [0, 1, 2, 3]] FROM e JOIN m ON m.n = e.n + 1)
SELECT i AS player, round(r[i + 1], 4) AS rating FROM (SELECT arg_max(r, n) AS r FROM e), (SELECT unnest([0, 1, 2, 3]) AS i)
""")
def elo_ratings(t: Tables):
    """Ratings after a sequence of matches: a fold in order over all of them.

    Each step needs the ratings before it, so one task reads the sorted matches batch by batch and holds four numbers."""
    score = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).otherwise(0.5)
    m = t.orders.select(F.col("o_orderkey").alias("n"), (F.col("o_custkey") % 4).cast("int").alias("a"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 3) % 4).cast("int").alias("b"), score.alias("s"))

    def play(batches):
        import pyarrow as pa

        r = [1200.0] * 4
        for batch in batches:
            for a, b, s in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "s"))):
                if a is not None and b is not None:
                    gain = 32 * (s - 1 / (1 + 10 ** ((r[b] - r[a]) / 400)))
                    r[a], r[b] = r[a] + gain, r[b] - gain
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(r)], ["player", "r"])

    rows = m.repartition(1).sortWithinPartitions("n", "a", "b", "s").mapInArrow(play, "player int, r double")
    return rows.select("player", F.round("r", 4).alias("rating"))


@registry.add("""
WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice / 1000 AS cost, o_orderpriority = '1-URGENT' AS reserved, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
g AS (SELECT o_custkey, 0::BIGINT AS n, 0::DOUBLE AS spent, 0::BIGINT AS admitted, 0::BIGINT AS refused FROM (SELECT DISTINCT o_custkey FROM o)
 UNION ALL SELECT g.o_custkey, g.n + 1, CASE WHEN spent + cost <= CASE WHEN reserved THEN 1000 ELSE 600 END THEN spent + cost ELSE spent END, admitted + (spent + cost <= CASE WHEN reserved THEN 1000 ELSE 600 END)::INT, refused + (spent + cost > CASE WHEN reserved THEN 1000 ELSE 600 END)::INT FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.n = g.n + 1)
SELECT o_custkey, round(arg_max(spent, n), 2) AS spent, arg_max(admitted, n) AS admitted, arg_max(refused, n) AS refused FROM g GROUP BY o_custkey
""")
def hierarchical_budget(t: Tables):
    items = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", (F.col("o_totalprice") / 1000).alias("cost"), (F.col("o_orderpriority") == "1-URGENT").alias("reserved"))))
    g = t.orders.groupBy("o_custkey").agg(P.spend(items, 1000.0).alias("g"))
    return g.select("o_custkey", F.round("g.spent", 2).alias("spent"), "g.admitted", "g.refused")


@registry.add("""
WITH s AS (SELECT l_linenumber * 512 AS budget, round(avg((l_returnflag <> 'R')::INT) + l_linenumber * 0.05, 6) AS success FROM lineitem GROUP BY l_linenumber), q AS (SELECT unnest([0.8, 0.9, 0.95, 0.99])::DOUBLE AS tau)
SELECT tau, coalesce(min(CASE WHEN success >= tau THEN budget END), 2 * max(budget))::BIGINT AS b_star FROM s, q GROUP BY tau
""")
def minimum_budget(t: Tables):
    """The least budget that meets each success rate, twice the largest where none does."""
    s = t.lineitem.groupBy("l_linenumber").agg(F.round(F.avg((F.col("l_returnflag") != "R").cast("int")) + F.col("l_linenumber") * 0.05, 6).alias("success")).withColumn("budget", F.col("l_linenumber") * 512)
    q = s.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in (0.8, 0.9, 0.95, 0.99)])))
    return q.groupBy("tau").agg(F.coalesce(F.min(F.when(F.col("success") >= F.col("tau"), F.col("budget"))), 2 * F.max("budget")).cast("long").alias("b_star"))


@registry.add("""
WITH d AS (SELECT doc_id, source AS path, doc_id % 100 < 3 AS hot, lang = 'en' AS warm, round((n_chars % 83) / 83::DOUBLE, 6) AS score FROM documents), t AS (SELECT *, CASE WHEN hot THEN 1 WHEN warm THEN 2 ELSE 3 END AS tier FROM d),
c AS (SELECT tier, sum(count(*)) OVER (ORDER BY tier) AS n, max(max(score)) OVER (ORDER BY tier) AS best FROM t GROUP BY tier), s AS (SELECT coalesce(min(CASE WHEN n >= 20 AND best >= 0.6 THEN tier END), 3) AS stop FROM c)
SELECT doc_id, tier FROM t, s WHERE tier <= stop
""")
def locality_cascade(t: Tables):
    """Tiers are searched until enough is found of enough confidence."""
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 100 < 3, 1).when(F.col("lang") == "en", 2).otherwise(3).alias("tier"), F.round((F.col("n_chars") % 83) / F.lit(83.0), 6).alias("score"))
    per = d.groupBy("tier").agg(F.count("*").alias("n"), F.max("score").alias("best"))  # three rows
    w = Window.orderBy("tier")
    per = per.select("tier", F.sum("n").over(w).alias("n"), F.max("best").over(w).alias("best"))
    stop = per.agg(F.coalesce(F.min(F.when((F.col("n") >= 20) & (F.col("best") >= 0.6), F.col("tier"))), F.lit(3)).alias("stop"))
    return d.crossJoin(F.broadcast(stop)).where("tier <= stop").select("doc_id", "tier")


@registry.add("""
WITH d AS (SELECT doc_id, source, lang, n_chars, CASE WHEN doc_id % 3 = 0 THEN 'code' ELSE 'note' END AS kind FROM documents)
SELECT doc_id, 'sig' AS unit, 1 AS type, ((length(kind || ' ' || source) + 3) // 4)::BIGINT AS tokens, round(0.6 * ((n_chars % 50) / 50.0), 6)::DOUBLE AS value FROM d
UNION ALL SELECT doc_id, 'def', 2, ((n_chars + 3) // 4)::BIGINT, round((n_chars % 50) / 50.0, 6)::DOUBLE FROM d
""")
def context_units(t: Tables):
    """A signature and a definition of each candidate."""
    d = t.documents.select("doc_id", F.length(F.concat_ws(" ", F.when(F.col("doc_id") % 3 == 0, "code").otherwise("note"), "source")).alias("s"), "n_chars", ((F.col("n_chars") % 50) / F.lit(50.0)).alias("v"))
    unit = lambda name, kind, n, v: F.struct(F.lit(name).alias("unit"), F.lit(kind).alias("type"), F.floor((n + 3) / 4).alias("tokens"), F.round(v, 6).alias("value"))
    u = F.array(unit("sig", 1, F.col("s"), 0.6 * F.col("v")), unit("def", 2, F.col("n_chars"), F.col("v")))
    return d.select("doc_id", F.explode(u).alias("u")).select("doc_id", "u.*")


@registry.add("WITH c AS (SELECT o_custkey AS key, o_orderkey AS id, o_orderdate AS created, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT key, id FROM c WHERE n <= 256 AND created >= (SELECT max(created) FROM c) - INTERVAL 60 DAYS")
def cache_eviction(t: Tables):
    """The newest 256 entries that have not outlived their time."""
    newest = t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(256)
    last = t.orders.agg(F.max("o_orderdate").alias("last"))
    return newest.crossJoin(F.broadcast(last)).where(F.expr("o_orderdate >= last - INTERVAL 60 DAYS")).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))


@registry.add("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM (VALUES ('/en/1'), ('fr/10'), ('.html')) AS c(f) WHERE p.url = f OR ends_with(p.url, f) OR ends_with(f, p.url))")
def cache_invalidation(t: Tables):
    c = t.literal([("/en/1",), ("fr/10",), (".html",)], "f string")  # the list of changed files
    p = t.pages.select("page_id", "url")
    return p.join(F.broadcast(c), (F.col("url") == F.col("f")) | F.col("url").endswith(F.col("f")) | F.col("f").endswith(F.col("url")), "left_semi").select("page_id")


_CE = """
WITH a AS (SELECT source, sum(n_chars) AS total, sum(n_chars) FILTER (doc_id % 8 IN (0, 2, 5, 6)) AS stable FROM documents GROUP BY source), r AS (SELECT *, least(1.0, (total % 10) / 10.0 * 0.5)::DOUBLE AS risk FROM a)
SELECT source, round((1 - risk) * stable / total, 6) AS hit_probability, round(total * 3e-6 - (stable * 3e-7 + (total - stable) * 3e-6), 6) AS saved, round((total * 3e-6 - (stable * 3e-7 + (total - stable) * 3e-6)) / (stable * 3e-7 + risk * total * 3e-6 * 0.1), 4) AS croi FROM r
"""


@registry.add(_CE)
def cache_economics(t: Tables):
    a = t.documents.groupBy("source").agg(F.sum("n_chars").alias("total"), F.sum(F.when((F.col("doc_id") % 8).isin(0, 2, 5, 6), F.col("n_chars"))).alias("stable"))
    total, stable = F.col("total"), F.col("stable")
    risk = F.least(F.lit(1.0), (total % 10) / 10.0 * 0.5)
    saved = total * 3e-6 - (stable * 3e-7 + (total - stable) * 3e-6)
    return a.select("source", F.round((1 - risk) * stable / total, 6).alias("hit_probability"), F.round(saved, 6).alias("saved"), F.round(saved / (stable * 3e-7 + risk * total * 3e-6 * 0.1), 4).alias("croi"))


@registry.add("SELECT conv_id, turn, round((0.5 * least(1, length(text) / 500.0) + 0.3 * (role = 'assistant')::INT + 0.2) / 1.0, 6)::DOUBLE AS quality, role = 'assistant' AND length(text) > 0 AS success FROM conversations")
def rubric_score(t: Tables):
    """A weighted mean of components; success if the required ones are whole."""
    parts = F.create_map(F.lit("depth"), F.least(F.lit(1.0), F.length("text") / 500.0), F.lit("role"), (F.col("role") == "assistant").cast("double"), F.lit("shape"), F.lit(1.0))
    weights = {"depth": 0.5, "role": 0.3, "shape": 0.2}
    q = sum((F.element_at("p", F.lit(k)) * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return t.conversations.withColumn("p", parts).select("conv_id", "turn", F.round(q, 6).alias("quality"), ((F.element_at("p", F.lit("role")) >= 1) & (F.length("text") > 0)).alias("success"))


@registry.add()
def hash_embeddings(t: Tables):
    """Both hash embeddings of each item; vectors of 64-bit hashes are not for SQL. Tested against a plain reading."""
    return t.benchmark.select("item_id", embedding(bag_vector, 128)("text").alias("bag"), embedding(positional_vector, 256)("text").alias("positional"))


@registry.add("""
WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))) AS w FROM documents), n AS (SELECT item_id, list_extract(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 6), 1) AS name FROM benchmark)
SELECT DISTINCT doc_id AS src, item_id AS dst FROM t JOIN n ON w = name
""")
def reference_edges(t: Tables):
    """Edges from a text to what it names, by an equi-join of tokens and names."""
    tok = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "), " "), lambda x: F.length(x) >= 2)
    d = t.documents.select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(tok("text"))).alias("w"))
    n = t.benchmark.select(F.col("item_id").alias("dst"), F.get(F.filter(tok("text"), lambda x: F.length(x) >= 6), F.lit(0)).alias("w"))
    return d.join(n, "w").select("src", "dst").distinct()


# ---- queries of a text, budgets and policies


_TOKEN_SQL = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)"


@registry.add(rf"""
SELECT page_id, len(regexp_extract_all(url, '[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+')) AS paths, len(regexp_extract_all(url, '[a-z0-9]+(?:-[a-z0-9]+)+')) AS identifiers, len(regexp_extract_all(url, '[0-9]+')) AS numbers,
CASE WHEN regexp_matches(url, 'casino|bets|pills') THEN 'debug' WHEN regexp_matches(url, '/en/') THEN 'trace' WHEN regexp_matches(url, 'blog') THEN 'policy' ELSE 'lookup' END AS intent FROM pages
""")
def query_decomposition(t: Tables):
    """Counts of paths, identifiers and numbers of a query, and its intent by the first rule that fits."""
    u = F.col("url")
    n = lambda p: F.regexp_count(u, F.lit(p)).cast("long")
    intent = F.when(u.rlike("casino|bets|pills"), "debug").when(u.rlike("/en/"), "trace").when(u.rlike("blog"), "policy").otherwise("lookup")
    return t.pages.select("page_id", n("[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+").alias("paths"), n("[a-z0-9]+(?:-[a-z0-9]+)+").alias("identifiers"), n("[0-9]+").alias("numbers"), intent.alias("intent"))


_PROFILES = [("trace", 0.10, 0.15, 0.25, 3), ("policy", 0.15, 0.25, 0.15, 2), ("debug", 0.20, 0.25, 0.20, 2)]


@registry.add(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d})" for n, a, b, c, d in _PROFILES) + ") AS v(intent, lexical, semantic, symbol, depth)), "
    "q AS (SELECT page_id, CASE WHEN regexp_matches(url, 'casino|bets|pills') THEN 'debug' WHEN regexp_matches(url, '/en/') THEN 'trace' WHEN regexp_matches(url, 'blog') THEN 'policy' ELSE 'lookup' END AS intent FROM pages) "
    "SELECT page_id, q.intent, coalesce(lexical, 0.2) AS lexical, coalesce(semantic, 0.2) AS semantic, coalesce(symbol, 0.2) AS symbol, coalesce(depth, 1) AS depth FROM q LEFT JOIN p ON p.intent = q.intent"
)
def routing_profile(t: Tables):
    p = t.literal(_PROFILES, "intent string, lexical double, semantic double, symbol double, depth int")
    return query_decomposition(t).select("page_id", "intent").join(F.broadcast(p), "intent", "left").fillna({"lexical": 0.2, "semantic": 0.2, "symbol": 0.2, "depth": 1})


@registry.add(f"""
WITH w AS (SELECT item_id, unnest(list_distinct({_TOKEN_SQL})) AS term FROM benchmark), f AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term) AS n FROM w),
x AS (SELECT item_id, term AS v, 1.0::DOUBLE AS weight FROM f WHERE n <= 25 UNION ALL SELECT item_id, upper(term[1:1]) || term[2:], 0.9 FROM f WHERE n <= 10 UNION ALL SELECT item_id, term || 's', 0.65 FROM f WHERE n <= 10)
SELECT item_id, v AS term, max(weight) AS weight FROM x GROUP BY ALL
""")
def query_expansion(t: Tables):
    """At most 25 terms of a query, with casings and word forms of the first ten at less weight."""
    from millrace.functions.text import tokens

    w = t.benchmark.select("item_id", F.explode(tokens(F.col("text"))).alias("term"))
    f = w.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(F.length("term")), "term")))
    few = F.col("n") <= 10
    v = F.array(F.struct(F.col("term").alias("v"), F.lit(1.0).alias("weight")), F.when(few, F.struct(F.concat(F.upper(F.substring("term", 1, 1)), F.expr("substring(term, 2)")).alias("v"), F.lit(0.9).alias("weight"))), F.when(few, F.struct(F.concat("term", F.lit("s")).alias("v"), F.lit(0.65).alias("weight"))))
    x = f.where("n <= 25").select("item_id", F.explode(v).alias("x")).where("x is not null").select("item_id", "x.*")
    return x.groupBy("item_id", F.col("v").alias("term")).agg(F.max("weight").alias("weight"))


_CONCEPTS = [("the", "article"), ("that", "article"), ("and", "link"), ("with", "link"), ("licensed", "law")]


@registry.add(f"WITH w AS (SELECT DISTINCT item_id, unnest({_TOKEN_SQL}) AS term FROM benchmark), c AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _CONCEPTS) + ") AS v(term, concept)) SELECT item_id, concept, max(0.65)::DOUBLE AS weight FROM w JOIN c USING (term) GROUP BY ALL")
def sparse_expansion(t: Tables):
    """Concepts of a query's terms, at 0.65."""
    from millrace.functions.text import tokens

    c = t.literal(_CONCEPTS, "term string, concept string")
    w = t.benchmark.select("item_id", F.explode(tokens(F.col("text"))).alias("term"))
    return w.join(F.broadcast(c), "term").groupBy("item_id", "concept").agg(F.max(F.lit(0.65)).alias("weight"))


@registry.add("""
SELECT s_suppkey, CASE WHEN lower(s_name) = 'supplier#000000001' THEN 1.0 WHEN contains(lower(s_name), '00001') THEN 0.5 ELSE 0 END + CASE WHEN s_nationkey = 3 THEN 1.2 ELSE 0 END + CASE WHEN s_acctbal < 0 THEN 1.5 ELSE 0 END AS seed FROM supplier
""".replace("END AS seed", "END::DOUBLE AS seed"))
def seed_extraction(t: Tables):
    """Seeds of a walk: a name met whole or in part, a changed place, a failure."""
    n = F.lower("s_name")
    s = F.when(n == "supplier#000000001", 1.0).when(n.contains("00001"), 0.5).otherwise(0.0) + F.when(F.col("s_nationkey") == 3, 1.2).otherwise(0.0) + F.when(F.col("s_acctbal") < 0, 1.5).otherwise(0.0)
    return t.supplier.select("s_suppkey", s.alias("seed"))


@registry.add(f"""
WITH w AS (SELECT source, lang, doc_id, unnest(list_distinct({_TOKEN_SQL})) AS term FROM documents), q AS (SELECT * FROM w WHERE list_contains(['the','and','licensed','under','version','that','die','les'], term)),
f AS (SELECT source, term, min(doc_id) AS first FROM q GROUP BY ALL), r AS (SELECT source, first, row_number() OVER (PARTITION BY source ORDER BY first, term) AS n FROM f)
SELECT source, min(CASE WHEN n >= 4 THEN first END) AS rung, max(n) AS covered FROM r GROUP BY source
""")
def context_ladder(t: Tables):
    """The first rung, documents in order of id, at which half of eight claims are covered."""
    from millrace.functions.text import tokens

    claims = ["the", "and", "licensed", "under", "version", "that", "die", "les"]
    q = t.documents.select("source", "doc_id", F.explode(F.filter(tokens(F.col("text")), lambda x: x.isin(claims))).alias("term"))
    f = q.groupBy("source", "term").agg(F.min("doc_id").alias("first"))
    r = f.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("first", "term")))
    return r.groupBy("source").agg(F.min(F.when(F.col("n") >= 4, F.col("first"))).alias("rung"), F.max("n").cast("long").alias("covered"))


@registry.add("SELECT lower(trim(text)) = '' AS blank, count(*) AS n, count(DISTINCT lower(trim(text))) AS claims, count(*) - count(DISTINCT lower(trim(text))) AS duplicates FROM conversations GROUP BY 1")
def duplicate_claims(t: Tables):
    c = t.conversations.groupBy(F.lower(F.trim("text")).alias("claim")).agg(F.count("*").alias("n"))
    return c.groupBy((F.col("claim") == "").alias("blank")).agg(F.sum("n").alias("n"), F.count("*").alias("claims"), (F.sum("n") - F.count("*")).alias("duplicates"))


@registry.add("""
WITH d AS (SELECT DISTINCT round(l_discount * 10, 1)::DOUBLE AS difficulty FROM lineitem), c AS (SELECT unnest([1000, 2500, 5000, 10000, 16000, 24000, 32000]) AS ctx),
x AS (SELECT difficulty, ctx, ctx / 1e6 * 3.0 + floor(3000 * (0.5 + difficulty) * (0.8 + 8000 / (ctx + 500.0::DOUBLE))) / 1e6 * 15.0 AS cost, least(1.0, difficulty * 0.4 * (2000 / (ctx + 1000.0::DOUBLE))) AS risk FROM d, c)
SELECT difficulty, coalesce(arg_min(ctx, round(cost, 9)) FILTER (risk <= 0.10), arg_min(ctx, round(cost, 9))) AS ctx FROM x GROUP BY difficulty
""")
def joint_context_compute(t: Tables):
    """The context size of the least cost of context and reasoning that meets the risk."""
    sizes = F.explode(F.array(*[F.lit(c) for c in (1000, 2500, 5000, 10000, 16000, 24000, 32000)]))
    x = t.lineitem.select(F.round(F.col("l_discount") * 10, 1).alias("difficulty")).distinct().select("difficulty", sizes.alias("ctx"))
    d, c = F.col("difficulty"), F.col("ctx")
    cost = F.round(c / 1e6 * 3.0 + F.floor(3000 * (0.5 + d) * (0.8 + 8000 / (c + 500.0))) / 1e6 * 15.0, 9)
    risk = F.least(F.lit(1.0), d * 0.4 * (2000 / (c + 1000.0)))
    return x.select("difficulty", "ctx", cost.alias("cost"), risk.alias("risk")).groupBy("difficulty").agg(F.coalesce(F.min_by("ctx", F.when(F.col("risk") <= 0.10, F.col("cost"))), F.min_by("ctx", "cost")).alias("ctx"))


def _policy_rows(t: Tables):
    return _ranked(t).select("semantic", "lexical", "affinity", "auth", "re", "risk", (F.col("id") % 5 == 0).alias("relevant"))


@registry.add()
def policy_fitness(t: Tables):
    """Fitness of a generation of mutants; tested against a plain reading."""
    from millrace.operators.policy import Policy, evaluate, mutate

    pool = [Policy()] + [mutate(Policy(), i) for i in range(1, 7)]
    return evaluate(_policy_rows(t), pool).select("policy", F.round("fitness", 6).alias("fitness"))


@registry.add()
def minimum_evidence_select(t: Tables):
    from millrace.operators.policy import minimum_evidence
    from millrace.plans.text import TERMS

    needed = frozenset(TERMS[:4])
    return P.select_by(_top(t), "source", 4000, lambda rows, budget: minimum_evidence(rows, needed, budget, 0.5))


@registry.add()
def approximate_distinct(t: Tables):
    """Distinct parts of each flag by a sketch (HyperLogLog, 2 % standard error); a test holds it to the exact counts."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("distinct_parts"))


@registry.add("WITH n AS (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS kind FROM part), q AS (SELECT p_partkey FROM n WHERE ends_with(name, 'bolt') AND contains(kind, 'econ')), f AS (SELECT p_partkey FROM n WHERE ends_with(name, 'bolt')) SELECT p_partkey FROM q UNION ALL SELECT p_partkey FROM f WHERE NOT EXISTS (SELECT 1 FROM q)")
def qualified_lookup(t: Tables):
    """The last part of a name with its qualifier; without any such row, the last part alone."""
    n = t.part.where(F.lower("p_name").endswith("bolt")).select("p_partkey", F.lower("p_type").contains("econ").alias("q"))
    any_ = n.agg(F.coalesce(F.bool_or("q"), F.lit(False)).alias("some"))
    return n.crossJoin(F.broadcast(any_)).where(F.col("q") | ~F.col("some")).select("p_partkey")


@registry.add(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_TOKEN_SQL}) AS term FROM documents) WHERE starts_with(term, 'licen') OR starts_with(term, 'vers') OR starts_with(term, 'onedas')")
def prefix_token_search(t: Tables):
    from millrace.functions.text import tokens

    hit = F.exists(tokens(F.col("text")), lambda x: x.startswith("licen") | x.startswith("vers") | x.startswith("onedas"))
    return t.documents.where(hit).select("doc_id")


def _said(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STEM = "CASE WHEN ends_with(low, 'ies') THEN low[:-4] || 'y' WHEN ends_with(low, 's') AND length(low) > 3 THEN low[:-2] ELSE low END"
_ASKS = f"""WITH q AS (SELECT 'page ' || page_id AS query, regexp_replace(url, '^[a-z]+://', '') AS text FROM pages UNION ALL SELECT 'item ' || item_id, text FROM benchmark UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, text FROM conversations WHERE role = 'user'),
tk AS (SELECT query, regexp_extract_all(coalesce(text, ''), '{K.TOKEN}') AS w FROM q), ps AS (SELECT query, w, unnest(range(len(w))) AS spot FROM tk),
lo AS (SELECT query, spot, w[spot + 1] AS token, lower(w[spot + 1]) AS low, coalesce(spot > 0 AND (lower(w[spot]) IN ({_said(K.EXCLUDING)}) OR (lower(w[spot]) IN ({_said(K.ARTICLES)}) AND spot > 1 AND lower(w[spot - 1]) IN ({_said(K.EXCLUDING)}))), false) AS negated FROM ps),
kd AS (SELECT *, CASE WHEN low IN ({_said(K.NEGATIONS)}) THEN 'negation' WHEN regexp_matches(token, '{K.PATH}') THEN 'path' WHEN regexp_matches(token, '{K.ACRONYM}') THEN 'entity' WHEN regexp_matches(token, '{K.SYMBOL}') THEN 'symbol'
 WHEN {_STEM} IN ({_said(K.ACTIONS)}) THEN 'action' WHEN {_STEM} IN ({_said(K.ARTIFACTS)}) THEN 'artifact' WHEN regexp_matches(token, '[_-]') THEN 'identifier' WHEN length(token) >= 4 THEN 'concept' END AS kind FROM lo),
sp AS (SELECT query, spot, token, kind, round(CASE WHEN negated THEN 0 WHEN kind = 'concept' THEN 0.4 * least(1.0, length(token) / 8) {" ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in K.SALIENCE.items() if k != "concept")} END, 6)::DOUBLE AS salience, negated FROM kd WHERE kind IS NOT NULL)"""


def _asks(t: Tables):
    """Addresses of pages, items and what users say in conversations, read as queries."""
    q = lambda df, name, text: df.select(name.alias("query"), text.alias("text"))
    pages = q(t.pages, F.concat(F.lit("page "), F.col("page_id").cast("string")), F.regexp_replace("url", "^[a-z]+://", ""))
    items = q(t.benchmark, F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"))
    turns = q(t.conversations.where("role = 'user'"), F.concat_ws(" ", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.col("text"))
    return pages.unionByName(items).unionByName(turns)


@registry.add(_ASKS + " SELECT query, spot::INT AS \"at\", token, kind, salience, negated FROM sp")
def query_spans(t: Tables):
    """Typed spans of every query with their salience and negation."""
    return K.spans(_asks(t))


_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + f" THEN '{name}'" for name, words in K.INTENTS[:-1]) + " ELSE 'lookup' END"
_OF = "coalesce(list(token ORDER BY spot) FILTER (kind = '{k}' AND NOT negated), [])"


@registry.add(_ASKS + f""", f AS (SELECT query, token, kind, negated, min(spot) AS spot, max(salience) AS salience FROM sp GROUP BY ALL),
a AS (SELECT query, {", ".join(f"{_OF.format(k=k)} AS {k}s" for k in ("path", "symbol", "identifier", "action"))}, coalesce(list(token ORDER BY spot) FILTER (negated), []) AS exclusions, coalesce(list(token ORDER BY salience DESC, spot) FILTER (kind IN ('entity', 'symbol', 'identifier', 'concept') AND NOT negated), [])[1:10] AS entities, round(sum(salience), 6) AS salience FROM f GROUP BY query)
SELECT query, {_INTENT} AS intent, {", ".join(f"array_to_string(coalesce({c}, []), ',') AS {c}" for c in ("paths", "symbols", "identifiers", "actions", "exclusions", "entities"))}, coalesce(salience, 0) AS salience FROM q LEFT JOIN a USING (query)""")
def query_contracts(t: Tables):
    """Intent and contract of every query, from its spans."""
    c = K.contracts(_asks(t))
    return c.select("query", "intent", *[F.array_join(x, ",").alias(x) for x in ("paths", "symbols", "identifiers", "actions", "exclusions", "entities")], "salience")


@registry.add(_ASKS + f""", i AS (SELECT query, {_INTENT} AS intent FROM q), p AS (SELECT * FROM (VALUES {", ".join(f"('{k}', " + ", ".join(f"{x}::DOUBLE" for x in v[:7]) + f", {v[7]}, {v[8]}::DOUBLE)" for k, v in K.PROFILES.items())}) AS v(intent, {", ".join(K.CHANNELS)}, authority, depth, floor)) SELECT * FROM i JOIN p USING (intent)""")
def intent_routing(t: Tables):
    """The channel weights, authority, depth and floor that each query's intent asks for: all seven profiles."""
    return K.route(K.contracts(_asks(t)).select("query", "intent"))
