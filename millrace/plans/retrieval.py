"""Queries: retrieval over a code base of parts. Nodes are the parts, in files of packages, odd ones the tests of even
ones; edges join the parts of neighbouring lines of an order; tasks are the names of parts, and one that nothing has."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import expansion as X
from millrace.operators import graph as G
from millrace.operators import mentions as M
from millrace.operators import packing as P
from millrace.operators import ranking as R
from millrace.operators import retrieval as V
from millrace.operators import search as Q
from millrace.plans.memories import _PACK, _RANKED, _pack_input, _top
from millrace.plans.text import _BM25, _LIST, _TF, _TOK, TERMS
from millrace.registry import Registry, Tables
from millrace.sources.work import dealt, shuffled, spread, table

registry = Registry()
NOTHING = "zzz unknown thing"

_N = "n AS (SELECT p_partkey AS id, p_name AS name, lower(p_brand) AS content, 'pkg' || ((p_partkey // 2) % 37) || '/f' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '_test.go' ELSE '.go' END AS path, p_size AS revision FROM part)"
_E = """e AS (SELECT DISTINCT src, dst, kind FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS dst,
  CASE l_returnflag WHEN 'R' THEN 'call' WHEN 'A' THEN 'import' ELSE 'uses' END AS kind FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
_T = f"t AS (SELECT DISTINCT p_name AS task FROM part UNION ALL SELECT '{NOTHING}')"


def _nodes(t: Tables):
    stem = F.floor(F.col("p_partkey") / 2).cast("string")
    path = F.concat(F.lit("pkg"), (F.floor(F.col("p_partkey") / 2) % 37).cast("string"), F.lit("/f"), stem, F.when(F.col("p_partkey") % 2 == 1, "_test.go").otherwise(".go"))
    return shuffled(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_brand").alias("content"), path.alias("path"), F.col("p_size").alias("revision")))


def _links(t: Tables):
    """src, dst, kind of edges, which may repeat."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "R", "call").when(F.col("l_returnflag") == "A", "import").otherwise("uses")
    lines = dealt(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), kind.alias("kind")).where("dst is not null and src <> dst")


def _edges(t: Tables):
    return _links(t).distinct()


def _tasks(t: Tables):
    return t.part.select(F.col("p_name").alias("task")).distinct().unionByName(t.literal([(NOTHING,)], "task string"))


@registry.add(f"WITH {_E} SELECT src, dst, max(CASE kind WHEN 'call' THEN 1.0 WHEN 'import' THEN 0.8 ELSE 0.5 END)::DOUBLE AS weight FROM e GROUP BY src, dst")
def edge_weights(t: Tables):
    return _edges(t).groupBy("src", "dst").agg(F.max(V.edge_weight(F.col("kind"))).alias("weight"))


def _expanded(seeds: str, nodes: str = "n") -> str:
    """CTEs up to x (task, id, depth, reason, score): expansion of the CTE `seeds` (task, id, place) over two hops."""
    calls = "SELECT task, dst AS id, min(place) AS place FROM {f} f JOIN u ON u.src = f.id JOIN " + nodes + " ok ON ok.id = f.id JOIN ok2 ON ok2.id = dst WHERE NOT EXISTS (SELECT 1 FROM {s} s WHERE s.task = f.task AND s.id = dst) GROUP BY task, dst"
    cap = "SELECT task, id, place FROM (SELECT *, row_number() OVER (PARTITION BY task, place ORDER BY id) AS r FROM ({q})) WHERE r <= 8"
    tests = "SELECT f.task, b.id, min(place) AS place FROM {f} f JOIN pa a ON a.id = f.id JOIN pa b ON b.path = regexp_replace(a.path, '\\.go$', '') || '_test.go' WHERE a.path LIKE '%.go' AND a.path NOT LIKE '%\\_test.go' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM {s} s WHERE s.task = f.task AND s.id = b.id) GROUP BY f.task, b.id"
    return f"""u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), ok2 AS (SELECT id FROM {nodes}), pa AS (SELECT id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {nodes}),
c1 AS ({cap.format(q=calls.format(f=seeds, s=seeds))}),
d1 AS (SELECT task, dir, min(place) AS place FROM {seeds} JOIN pa USING (id) WHERE dir <> '' GROUP BY task, dir),
k1 AS (SELECT task, id, place FROM (SELECT d1.task, pa.id, d1.place, row_number() OVER (PARTITION BY d1.task, d1.dir ORDER BY pa.path, pa.id) AS r FROM d1 JOIN pa USING (dir) WHERE NOT EXISTS (SELECT 1 FROM {seeds} s WHERE s.task = d1.task AND s.id = pa.id)) WHERE r <= 8),
t1 AS ({tests.format(f=seeds, s=seeds)}),
h1 AS (SELECT task, id, place, 1 AS depth, 'call' AS reason, 0.85::DOUBLE AS score FROM c1 UNION ALL SELECT task, id, place, 1, 'sibling', 0.7 FROM k1 UNION ALL SELECT task, id, place, 1, 'test', 0.6 FROM t1),
full1 AS (SELECT task FROM h1 GROUP BY task HAVING count(DISTINCT id) >= 15),
f2 AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY place, id) AS place FROM (SELECT task, id, min(place) AS place FROM h1 WHERE reason <> 'test' AND task NOT IN (SELECT task FROM full1) GROUP BY task, id)),
s2 AS (SELECT task, id FROM {seeds} UNION SELECT task, id FROM h1),
c2 AS ({cap.format(q=calls.format(f="f2", s="s2"))}),
t2 AS ({tests.format(f="f2", s="s2")}),
h2 AS (SELECT task, id, depth, reason, score FROM h1 UNION ALL SELECT task, id, 2, 'call', 0.425 FROM c2 UNION ALL SELECT task, id, 2, 'test', 0.3 FROM t2),
x AS (SELECT task, id, arg_max(depth, (score, reason)) AS depth, arg_max(reason, (score, reason)) AS reason, max(score) AS score FROM h2 GROUP BY task, id)"""


@registry.add(f"WITH {_N}, {_E}, {_T}, sd AS (SELECT task, id, place FROM (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY id) AS place FROM t JOIN n ON name = task) WHERE place <= 3), {_expanded('sd')} SELECT * FROM x")
def candidate_expansion(t: Tables):
    """Siblings, callers and callees, and tests around the first three nodes of each name."""
    n = _nodes(t)
    w = Window.partitionBy("task").orderBy("id")
    seeds = n.join(_tasks(t), F.col("name") == F.col("task")).select("task", "id", F.row_number().over(w).alias("place")).where("place <= 3")
    return V.expand(seeds, n, table(_links(t), "edges"))


_TRI = "CASE WHEN length(trim({0})) < 3 THEN [] ELSE list_distinct([substr(lower(trim({0})), i::INTEGER, 3) for i in generate_series(1, length(trim({0})) - 2)]) END"
_BAG = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))"


def _channels(nodes: str = "n", limit: int = 25) -> str:
    """CTEs up to ch (task, id, channel, score)."""
    return f"""qt AS (SELECT task, {_BAG.format("task")} AS t, {_TRI.format("task")} AS g FROM t), nt AS (SELECT id, {_BAG.format("name || ' ' || content")} AS t, {_TRI.format("name")} AS g FROM {nodes}),
raw AS (SELECT task, id, 'exact' AS channel, 1.0::DOUBLE AS score FROM t JOIN {nodes} ON lower(trim(name)) = lower(trim(task))
 UNION ALL SELECT task, id, 'lexical', round(len(list_intersect(nt.t, qt.t))::DOUBLE / len(qt.t), 6) FROM qt, nt WHERE len(list_intersect(nt.t, qt.t)) > 0
 UNION ALL SELECT task, id, 'semantic', round(len(list_intersect(nt.g, qt.g))::DOUBLE / (len(nt.g) + len(qt.g) - len(list_intersect(nt.g, qt.g))), 6) FROM qt, nt WHERE len(list_intersect(nt.g, qt.g)) > 0),
ch AS (SELECT task, id, channel, score FROM (SELECT *, row_number() OVER (PARTITION BY task, channel ORDER BY score DESC, id) AS r FROM raw) WHERE r <= {limit})"""


_STATUS = """st AS (SELECT t.task, CASE WHEN coalesce(e, 0) > 0 AND length(t.task) <= 10 THEN 'EXACT_FOUND' WHEN coalesce(e, 0) > 0 THEN 'LEXICAL_FOUND' WHEN coalesce(l, 0) > 0 AND top >= 0.1 THEN 'LEXICAL_FOUND' WHEN coalesce(l, 0) > 0 THEN 'INSUFFICIENT' ELSE 'NONE' END AS status
 FROM t LEFT JOIN (SELECT task, count(*) FILTER (channel = 'exact') AS e, count(*) FILTER (channel = 'lexical') AS l, max(score) FILTER (channel = 'lexical') AS top FROM ch GROUP BY task) USING (task))"""


@registry.add(f"WITH {_N}, {_T}, {_channels()}, {_STATUS} SELECT task, status FROM st")
def evidence_status(t: Tables):
    tasks = _tasks(t)
    return V.status_of(tasks, V.channels(tasks, _nodes(t)), F.length("task") <= 10)


_FUSED = "SELECT task, id, round(0.2 * coalesce(max(score) FILTER (channel = 'exact'), 0) + 0.2 * coalesce(max(score) FILTER (channel = 'lexical'), 0) + 0.2 * coalesce(max(score) FILTER (channel = 'semantic'), 0) + 0.1 * coalesce(max(score) FILTER (channel = 'recent'), 0) + 0.05 * coalesce(max(score) FILTER (channel = 'graph'), 0) + 0.5 * max((channel = 'exact')::INT), 6) AS score FROM {0} GROUP BY task, id"
_HYBRID = f"""
WITH {_N}, {_E}, {_T}, a AS (SELECT * FROM n WHERE revision > 3), {_channels("a")},
rc AS (SELECT task, id FROM (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY revision DESC, id) AS r FROM (SELECT DISTINCT task, id FROM ch) JOIN a USING (id)) WHERE r <= 25),
cd AS (SELECT * FROM ch UNION ALL SELECT task, id, 'recent', 1.0 FROM rc), f1 AS ({_FUSED.format("cd")}),
sd AS (SELECT task, id, place FROM (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS place FROM f1) WHERE place <= 10), {_expanded("sd", "a")},
ev AS (SELECT * FROM cd UNION ALL SELECT task, id, 'graph', score FROM x), fx AS ({_FUSED.format("ev")}),
so AS (SELECT task, id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources FROM ev GROUP BY task, id),
hy AS (SELECT task, id, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS place, sources FROM fx JOIN so USING (task, id))
"""


def _hybrid(t: Tables, keep: int = 20, links=None):
    """links: those of _links, written, where the caller needs them too."""
    links = table(_links(t).select("src", "dst"), "edges") if links is None else links
    return V.hybrid(_tasks(t), _nodes(t), links, F.col("revision") > 3, keep=keep)


@registry.add(_HYBRID + "SELECT task, id, score, place, sources FROM hy WHERE place <= 20")
def hybrid_retrieval(t: Tables):
    """Five channels, admission, fusion, expansion of the best, order."""
    return _hybrid(t)


@registry.add(_HYBRID + f""", {_STATUS}, sn AS (SELECT task, id, score, place FROM hy WHERE place <= 40 AND task IN (SELECT task FROM st WHERE status <> 'NONE')),
ex AS (SELECT task, exp(score - greatest(0, max(score) OVER (PARTITION BY task))) AS e FROM sn), pr AS (SELECT task, e / sum(e) OVER (PARTITION BY task) AS p FROM ex), en AS (SELECT task, count(*) AS n, sum(CASE WHEN p > 1e-12 THEN -p * ln(p) ELSE 0 END) AS h FROM pr GROUP BY task),
kk AS (SELECT task, CASE WHEN n > 1 THEN 5 + round(20 * least(1.0, h / ln(n))) ELSE 5 END AS k FROM en),
pl AS (SELECT sn.*, lead(score) OVER (PARTITION BY task ORDER BY score DESC, id) AS nxt, count(*) OVER (PARTITION BY task) AS m FROM sn JOIN kk USING (task) WHERE place <= k),
sp AS (SELECT task, min(place) AS stop FROM pl WHERE place > 3 AND place < m AND least(score, 1.0) >= 0.7 AND score - nxt < 0.05 GROUP BY task)
SELECT pl.task, id, score, place FROM pl LEFT JOIN sp USING (task) WHERE stop IS NULL OR place <= stop""")
def subsystem_plan(t: Tables):
    """Evidence status, the rule that no evidence plans nothing, entropy-scaled k and the adaptive stop, on hybrid retrieval."""
    tasks = _tasks(t)
    status = V.status_of(tasks, V.channels(tasks, _nodes(t).where("revision > 3")), F.length("task") <= 10)
    return V.plan(_hybrid(t, 40).select("task", "id", "score"), status)


@registry.add(f"""WITH {_N}, {_T}, {_channels(limit=1 << 30)}, sc AS (SELECT task, id, round(sum(CASE channel WHEN 'semantic' THEN 0.6 * score ELSE 0.4 * score END), 6) AS score FROM ch WHERE channel <> 'exact' GROUP BY task, id)
SELECT task, id, score FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, id) AS r FROM sc WHERE score >= 0.05) WHERE r <= 100""")
def exhaustive_retrieval(t: Tables):
    return V.exhaustive(_tasks(t), _nodes(t))


@registry.add(_HYBRID + ", tg AS (SELECT task, max(id) AS id FROM t JOIN n ON name = task GROUP BY task) SELECT tg.task, place, CASE WHEN place IS NULL THEN 'candidate_generation_failure' WHEN place > 10 THEN 'ranking_failure' ELSE 'success' END AS diagnosis, round(c::DOUBLE / (SELECT count(*) FROM n), 6) AS touched FROM tg LEFT JOIN (SELECT * FROM hy WHERE place <= 20) h USING (task, id) LEFT JOIN (SELECT task, count(*) AS c FROM hy WHERE place <= 20 GROUP BY task) c ON c.task = tg.task")
def failure_diagnosis(t: Tables):
    """Where the newest node of each name ended, and the share of the nodes that its task touched."""
    got, n = _hybrid(t), _nodes(t)
    targets = n.join(_tasks(t), F.col("name") == F.col("task")).groupBy("task").agg(F.max("id").alias("id"))
    touched = got.groupBy("task").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n.agg(F.count("*").alias("m")))).select("task", F.round(F.col("c") / F.col("m"), 6).alias("touched"))
    return V.diagnose(got, targets).join(touched, "task", "left").select("task", "place", "diagnosis", "touched")


NEEDED = ("red", "small", "widget", "ring", "blue", "large", "bolt", "gear")


def _grown(r: int) -> str:
    return f"""c{r} AS (SELECT count(DISTINCT w) >= 0.75 * {len(NEEDED)} AS enough FROM p{r - 1} JOIN hd USING (id)),
a{r} AS (SELECT DISTINCT dst AS id FROM p{r - 1} JOIN e ON src = id), b{r} AS (SELECT id FROM a{r} UNION SELECT dst FROM a{r} JOIN e ON src = id),
p{r} AS (SELECT id, round FROM p{r - 1} UNION ALL SELECT id, {r} FROM b{r}, c{r} WHERE NOT enough AND id NOT IN (SELECT id FROM p{r - 1}))"""


@registry.add(f"WITH {_N}, {_E}, hd AS (SELECT id, w FROM (SELECT id, unnest({_BAG.format('name')}) AS w FROM n) WHERE w IN {NEEDED}), p0 AS (SELECT id, 0 AS round FROM n WHERE id = 0), {', '.join(_grown(r) for r in (1, 2, 3))} SELECT id, round FROM p3")
def frontier_expansion(t: Tables):
    """Evidence grown along edges from one node until it covers three quarters of eight terms, three rounds at most."""
    n = _nodes(t)
    holds = n.select("id", F.explode(T.tokens(F.col("name"))).alias("term"))
    return V.expand_until_sufficient(n.where("id = 0").select("id"), _edges(t).select("src", "dst"), holds, list(NEEDED), 0.75)


@registry.add(f"""WITH rq AS (SELECT item_id, unnest(list_filter(list_distinct({_TOK}), lambda x: length(x) > 3)) AS need FROM benchmark),
d AS (SELECT DISTINCT unnest(list_distinct({_TOK})) AS need, contains(lower(text), 'licensed') AS conflict FROM documents),
aq AS (SELECT item_id, need, conflict FROM rq JOIN d USING (need)), ok AS (SELECT DISTINCT item_id, need FROM aq WHERE NOT conflict),
c AS (SELECT rq.item_id, sum(length(rq.need))::DOUBLE AS w, coalesce(sum(length(rq.need)) FILTER (ok.need IS NOT NULL), 0)::DOUBLE AS s, count(*) FILTER (ok.need IS NULL) AS missing FROM rq LEFT JOIN ok ON ok.item_id = rq.item_id AND ok.need = rq.need GROUP BY rq.item_id)
SELECT c.item_id AS key, round(s / w, 6) AS coverage, missing, round(coalesce(f, 0), 6)::DOUBLE AS conflict FROM c LEFT JOIN (SELECT item_id, avg(conflict::INT) AS f FROM aq GROUP BY item_id) USING (item_id)""")
def weighted_coverage(t: Tables):
    """What the documents meet of the terms of each item, weighed by length; licensed ones are in conflict."""
    need = t.benchmark.select(F.col("item_id").alias("key"), F.explode(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 3)).alias("need")).withColumn("weight", F.length("need"))
    # a text's conflict is told once, before its tokens are rows, and only needed tokens become rows
    d = spread(t.documents.select("text")).select(T.tokens(F.col("text")).alias("w"), F.lower("text").contains("licensed").alias("conflict"))
    d = d.select(F.explode("w").alias("need"), "conflict").join(need.select("need").distinct(), "need", "left_semi").distinct()
    got = V.weighted_coverage(need, need.join(d, "need").select("key", "need", "weight", "conflict"))
    return got.select("key", F.round("coverage", 6).alias("coverage"), "missing", F.round("conflict", 6).alias("conflict"))


@registry.add("""WITH v AS (SELECT conv_id, turn, contains(lower(text), 'whe') AS p, contains(lower(text), 'tha') AS q, role FROM conversations), j AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, a.p AND b.q AS f, a.role <> b.role AS r FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.turn < b.turn)
SELECT conv_id AS bundle, a, b, 'feature_flag' AS kind FROM j WHERE f UNION ALL SELECT conv_id, a, b, 'superseded_revision' FROM j WHERE r""")
def evidence_conflicts(t: Tables):
    return V.conflicts(t.conversations.select(F.col("conv_id").alias("bundle"), F.col("turn").alias("ord"), F.col("text").alias("content"), F.col("role").alias("revision")), "whe", "tha")


_POST = f"WITH w AS (SELECT doc_id AS id, lang, unnest(list_filter({_TOK}, lambda x: list_contains({_LIST}, x))) AS term FROM documents), po AS (SELECT id, lang, term, count(*) AS tf FROM w GROUP BY ALL)"


def _postings(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "lang", F.explode(F.filter(T.all_tokens(F.col("text")), lambda x: x.isin(TERMS))).alias("term")).groupBy("id", "lang", "term").agg(F.count("*").alias("tf"))


@registry.add(_POST + """, sg AS (SELECT id % 3 AS segment, id, term, tf FROM po UNION ALL SELECT 3, id, term, tf + 1 FROM po WHERE id % 10 = 0), ts AS (SELECT DISTINCT segment, id FROM sg WHERE id % 11 = 0 AND segment < 3),
lv AS (SELECT * FROM sg WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.segment = sg.segment AND ts.id = sg.id)), nw AS (SELECT id, max(segment) AS segment FROM lv GROUP BY id)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM lv JOIN nw USING (id, segment) GROUP BY term""")
def segment_compaction(t: Tables):
    """Three segments and one of new versions, with tombstones, in one."""
    p = _postings(t).drop("lang")
    old = p.select((F.col("id") % 3).cast("int").alias("segment"), "id", "term", "tf")
    seg = old.unionByName(p.where("id % 10 = 0").select(F.lit(3).alias("segment"), "id", "term", (F.col("tf") + 1).alias("tf")))
    gone = seg.where("id % 11 = 0 and segment < 3").select("segment", "id").distinct()
    return V.compact(seg, gone).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@registry.add(_POST + f""", h AS (SELECT * FROM po WHERE term IN ('licensed', 'under', 'version', 'the')), rt AS (SELECT lang FROM h GROUP BY lang ORDER BY count(DISTINCT term) DESC, sum(tf) DESC, lang LIMIT 2)
SELECT lang AS shard, id, sum(tf)::BIGINT AS score FROM h WHERE lang IN (SELECT lang FROM rt) GROUP BY lang, id ORDER BY score DESC, shard, id LIMIT 20""")
def sharded_search(t: Tables):
    return V.search_shards(_postings(t).withColumnRenamed("lang", "shard"), ["licensed", "under", "version", "the"], 20)


DENY, ALLOW = ["pkg1", "**/f7?.go"], ["pkg1?/**"]


@registry.add(f"WITH {_N} SELECT id, path, CASE WHEN regexp_matches(path, '" + "|".join(V.glob(p) for p in DENY) + "') THEN false WHEN regexp_matches(path, '" + "|".join(V.glob(p) for p in ALLOW) + "') THEN true ELSE revision > 25 END AS eligible FROM n")
def glob_admission(t: Tables):
    return _nodes(t).select("id", "path", V.by_globs(F.col("path"), DENY, ALLOW, F.col("revision") > 25).alias("eligible"))


@registry.add("""WITH l AS (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS age, date_trunc('day', ts) = date_trunc('day', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) AS same FROM events)
SELECT event_type, CASE WHEN age IS NULL OR NOT same THEN 'miss' WHEN age <= 300 THEN 'memory' WHEN age <= 3600 THEN 'disk' ELSE 'miss' END AS tier, count(*) AS n FROM l GROUP BY ALL""")
def cache_tiers(t: Tables):
    """Each event asks for the entry that the last one of its user and type left; a day is a revision."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    age = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / F.lit(1e6)
    same = F.coalesce(F.date_trunc("day", "ts") == F.date_trunc("day", F.lag("ts").over(w)), F.lit(False))
    l = t.events.select("event_type", age.alias("age"), same.alias("same"))  # noqa: E741
    return l.select("event_type", V.cache_tier(F.col("age"), F.col("same")).alias("tier")).groupBy("event_type", "tier").agg(F.count("*").alias("n"))


_SHORT = _RANKED + f", o AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY density DESC, id) AS n FROM k WHERE density IS NOT NULL), tp AS (SELECT o.source, o.id, list_distinct({_TOK}) AS w FROM o JOIN documents d ON d.doc_id = o.id WHERE n <= 12)"


@registry.add(_SHORT + " SELECT a.source, a.id AS a, b.id AS b, -len(list_intersect(a.w, b.w)) AS synergy FROM tp a JOIN tp b ON a.source = b.source AND a.id < b.id")
def pair_synergy(t: Tables):
    return V.synergy(_top(t), "source")


@registry.add(_SHORT + ", x AS (SELECT source, id, len(w) AS n, unnest(w) AS w FROM tp), al AS (SELECT source, w, min(id) AS id FROM x GROUP BY source, w HAVING count(*) = 1), ow AS (SELECT source, id, count(*) AS own FROM al GROUP BY ALL) SELECT tp.source, round(1 - min(coalesce(own, 0)::DOUBLE / len(w)), 6) AS curvature FROM tp LEFT JOIN ow ON ow.source = tp.source AND ow.id = tp.id WHERE len(w) > 0 GROUP BY tp.source")
def selection_curvature(t: Tables):
    return V.curvature(_top(t), "source").select("source", F.round("curvature", 6).alias("curvature"))


def _cover(rows: list[tuple]) -> float:
    return float(len(frozenset().union(*(r[3] for r in rows)))) if rows else 0.0


@registry.add()
def hybrid_select(t: Tables):
    """Selection by the caller's utility, here the distinct words covered; tested against a plain greedy."""
    return P.select_by(_top(t), "source", 4000, lambda rows, budget: P.by_utility(rows, budget, _cover))


_ARMS = """WITH RECURSIVE m AS MATERIALIZED (SELECT source, lang, doc_id AS id, CASE WHEN len(WORDS) = 0 THEN 1 ELSE floor(len(WORDS) * 1.3 + 0.999) END::BIGINT AS tokens, len(list_intersect(list_distinct(TOK), LIST)) AS hit FROM documents),
o AS MATERIALIZED (SELECT source, arm, id, tokens, row_number() OVER (PARTITION BY source, arm ORDER BY key, id) AS n FROM (SELECT source, 'B0' AS arm, id, tokens, id AS key FROM m UNION ALL SELECT source, 'B1', id, tokens, -id FROM m UNION ALL SELECT source, 'B2', id, tokens, -hit FROM m)),
g AS (SELECT source, arm, 0::BIGINT AS n, 0::BIGINT AS spent, 0::BIGINT AS taken FROM (SELECT DISTINCT source, arm FROM o)
 UNION ALL SELECT g.source, g.arm, g.n + 1, CASE WHEN spent + tokens <= 2048 THEN spent + tokens ELSE spent END, taken + (spent + tokens <= 2048)::INT FROM g JOIN o ON o.source = g.source AND o.arm = g.arm AND o.n = g.n + 1)
SELECT source, arm, arg_max(spent, n) AS spent, arg_max(taken, n) AS taken FROM g GROUP BY source, arm"""


@registry.add(_ARMS.replace("WORDS", "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')").replace("TOK", _TOK).replace("LIST", _LIST))
def baseline_packs(t: Tables):
    """What a budget of 2048 takes of each source in order of arrival, in the reverse, and by words shared with the task."""
    hit = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*[F.lit(x) for x in TERMS])))
    m = t.documents.select("source", F.col("doc_id").alias("id"), T.estimate_tokens(F.col("text")).alias("tokens"), hit.alias("hit"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), k.cast("long").alias("o")) for a, k in (("B0", F.col("id")), ("B1", -F.col("id")), ("B2", -F.col("hit")))])
    items = F.array_sort(F.collect_list(F.struct("o", "id", "tokens", F.lit(0.0).alias("score"))))
    x = m.select("source", "id", "tokens", F.explode(arms).alias("x")).select("source", "id", "tokens", "x.*")
    g = P.fitting(x, ["source", "arm"], 2048, F.col("o"), F.col("id")).groupBy("source", "arm").agg(P.greedy(items, 2048).alias("g"))
    return g.select("source", "arm", "g.spent", F.size("g.chosen").cast("long").alias("taken"))


@registry.add(_PACK + "SELECT source, to_json({'source': source, 'spent': spent, 'chosen': chosen})::VARCHAR AS package FROM e")
def plan_json(t: Tables):
    return P.greedy_pack(_pack_input(t), "source", 2000).select("source", F.to_json(F.struct("source", "spent", "chosen")).alias("package"))


@registry.add(f"SELECT doc_id, len({_TOK}) AS tokens, round(CASE WHEN len({_TOK}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_TOK}), {_LIST}))::DOUBLE / len(list_distinct({_TOK})) END, 6) AS overlap FROM documents")
def sql_functions(t: Tables):
    """Functions registered for SQL, called from an expression."""
    from millrace.functions.sql import register

    register(t.spark)
    terms = ", ".join(f"'{x}'" for x in TERMS)
    return t.documents.selectExpr("doc_id", "CAST(size(mill_tokens(text)) AS BIGINT) AS tokens", f"round(mill_overlap(mill_tokens(text), array({terms})), 6) AS overlap")


@registry.add("""WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 11 <> 0),
c AS (SELECT count(*) FILTER (a.p_partkey IS NULL) AS added, count(*) FILTER (b.p_partkey IS NULL) AS deleted, count(*) FILTER (a.p_size <> b.p_size) AS modified, count(b.p_partkey) AS total FROM a FULL JOIN b ON a.p_partkey = b.p_partkey)
SELECT *, round(1 - (added + modified)::DOUBLE / total, 6) AS work_reduction FROM c""")
def index_run_stats(t: Tables):
    """What an incremental run of the index handles of the files, and what it saves."""
    old = t.part.where("p_partkey % 7 <> 0").select("p_partkey", "p_size")
    new = t.part.where("p_partkey % 11 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))
    n = lambda s: F.count_if(F.col("status") == s)
    d = G.delta(old, new, ["p_partkey"], "p_size").agg(n("A").alias("added"), n("D").alias("deleted"), n("M").alias("modified"))
    return d.crossJoin(F.broadcast(new.agg(F.count("*").alias("total")))).withColumn("work_reduction", F.round(1 - (F.col("added") + F.col("modified")) / F.col("total"), 6))


@registry.add("SELECT role, count(*) AS n FROM conversations WHERE text IS NOT NULL AND NOT starts_with(text, 'User task: ') GROUP BY role")
def without_echoes(t: Tables):
    return t.conversations.where(~F.col("text").startswith("User task: ")).groupBy("role").agg(F.count("*").alias("n"))


@registry.add(_BM25.replace("FORMULA", _TF))
def max_score_topk(t: Tables):
    """bm25_topk, with documents pruned that the bounds of the terms rule out."""
    hits, stats, df = R.term_hits(t.documents, "doc_id", "text", TERMS)
    idf = R.idf(F.col("doc_count"), F.col("df"))
    rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    rows = rows.select("key", "term", (idf * R.bm25(F.col("tf").cast("double"), F.col("dlen").cast("double"), F.col("avg_len"))).alias("weight"))
    bounds = df.crossJoin(F.broadcast(stats)).select("term", (idf * (R.K1 + 1)).alias("most"))
    s = V.max_score_topk(rows, bounds, 20)
    return R.top_k(s.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), "score", "doc_id", 20)


@registry.add(f"WITH {_N}, b AS (SELECT *, CASE WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 1 ELSE 0 END AS c FROM n WHERE lower(regexp_extract(path, '([^/]*)$', 1)) = 'f7.go') SELECT id, path FROM b WHERE c = (SELECT min(c) FROM b)")
def basename_lookup(t: Tables):
    return V.by_basename(_nodes(t), "F7.go").select("id", "path")


@registry.add(f"WITH {_N}, b AS (SELECT 'pkg3' AS q, id, path, CASE WHEN path = 'pkg3' OR starts_with(path, 'pkg3/') THEN 0 WHEN contains(path, 'pkg3') THEN 1 END AS c FROM n UNION ALL SELECT '/f1', id, path, CASE WHEN path = '/f1' OR starts_with(path, '/f1/') THEN 0 WHEN contains(path, '/f1') THEN 1 END FROM n) SELECT q, id, path FROM b WHERE c = (SELECT min(c) FROM b o WHERE o.q = b.q)")
def path_lookup(t: Tables):
    """A folder, and a part of a path that is none."""
    n = _nodes(t)
    one = lambda q: V.by_path(n, q).select(F.lit(q).alias("q"), "id", "path")
    return one("pkg3").unionByName(one("/f1"))


@registry.add(f"WITH {_N} SELECT id, path FROM n WHERE contains(lower(path), 'kg12/') OR contains(lower(path), '/kg12.')")
def package_lookup(t: Tables):
    return V.by_package(_nodes(t), "kg12").select("id", "path")


@registry.add("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_trace(t: Tables):
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")
    return t.events.groupBy("user_id").agg(last, F.max("ts").alias("ts")).select("user_id", "x.event_id", "x.event_type", "ts")


@registry.add("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, round(sum(-p * log2(p)), 6) AS entropy FROM p GROUP BY user_id")
def shannon_entropy(t: Tables):
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.collect_list(F.col("n").cast("double")).alias("n")).select("user_id", F.round(T.entropy(F.col("n")), 6).alias("entropy"))  # a few types a user


@registry.add("SELECT event_id, ts + INTERVAL 36 HOUR AS due, date_trunc('week', ts)::DATE AS week, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, floor(epoch(ts) / 3600)::BIGINT AS hour FROM events")
def interval_arithmetic(t: Tables):
    ts = F.col("ts")
    return t.events.select("event_id", (ts + F.expr("INTERVAL 36 HOURS")).alias("due"), F.date_trunc("week", ts).cast("date").alias("week"), F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.floor(F.unix_micros(ts.cast("timestamp")) / 3600000000).cast("long").alias("hour"))


@registry.add(f"WITH {_E}, k AS (SELECT DISTINCT src, dst FROM e WHERE kind IN ('call', 'import')), a AS (SELECT DISTINCT dst AS id FROM k WHERE src = 0), b AS (SELECT DISTINCT dst AS id FROM a JOIN k ON src = id) SELECT 0::BIGINT AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a WHERE id <> 0 UNION ALL SELECT id, 2 FROM b WHERE id <> 0 AND id NOT IN (SELECT id FROM a)")
def dependency_closure(t: Tables):
    """What a node depends on, along edges of given kinds only."""
    e = _edges(t).where(F.col("kind").isin("call", "import")).select("src", "dst").distinct()
    return G.closure(e, t.literal([(0,)], "id long"), 2)


@registry.add()
def bounded_expansion(t: Tables):
    """Best-first expansion of every task from the three best of its retrieval, 30 nodes and 50 edges at most; held against a plain heap in tests."""
    links = table(_links(t), "edges")
    seeds = table(_hybrid(t, links=links).where("place <= 3").select("task", "id", "score"), "seeds")
    ids, ends = seeds.select("id").distinct(), F.explode(F.array("src", "dst")).alias("id")
    first = table(V.touching(links, ids).distinct(), "first")
    degree = first.select(ends).groupBy("id").agg(F.least(F.lit(1.0), F.count("*") / 100).alias("centrality"))
    # two steps at most: only the edges of seeds and of their neighbours are walked
    edges = V.touching(links, ids.union(first.select(ends)).distinct()).distinct().select("src", "dst", V.edge_weight(F.col("kind")).alias("weight"), "kind")
    got = X.best_first(seeds.join(degree, "id", "left"), edges, max_depth=2, cost=0.05)
    return got.select("task", "id", F.round("score", 9).alias("score"), "place", "ended")


_SAID = "' ' || array_to_string(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2), ' ') || ' '"


@registry.add(_HYBRID + f""", cq AS (SELECT hy.task, hy.id, path, CASE WHEN revision > 40 THEN 'decision' WHEN revision < 5 THEN 'failure' ELSE 'code' END AS kind, ends_with(path, '_test.go') AS test, {_SAID.format(c='name')} AS called, {_SAID.format(c="name || ' ' || content")} AS said FROM hy JOIN n USING (id) WHERE place <= 10),
tq AS (SELECT a.task, a.id AS a, b.id AS b, CASE WHEN (a.kind = 'decision' AND b.kind = 'code') OR (b.kind = 'decision' AND a.kind = 'code') THEN 'decision+source' WHEN (a.kind = 'decision' AND b.kind = 'failure') OR (b.kind = 'decision' AND a.kind = 'failure') THEN 'failure+fix'
 WHEN a.test <> b.test THEN 'source+test' WHEN (trim(b.called) <> '' AND contains(a.said, b.called)) OR (trim(a.called) <> '' AND contains(b.said, a.called)) THEN 'caller+callee' END AS type FROM cq a JOIN cq b ON a.task = b.task AND a.id < b.id)
SELECT * FROM tq WHERE type IS NOT NULL""")
def typed_pairs(t: Tables):
    """What the first ten results of each task are to each other: sources and tests, and those whose text names another."""
    n = _nodes(t)
    first = _hybrid(t).where("place <= 10").select("task", "id").join(n, "id")
    kind = F.when(F.col("revision") > 40, "decision").when(F.col("revision") < 5, "failure").otherwise("code")
    cands = first.select("task", "id", kind.alias("kind"), "path", "name", F.concat_ws(" ", "name", "content").alias("text"))
    return M.typed_pairs(cands, "task")


_LOOKUPS = f"""WITH {_N}, {_E}, g AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
nd AS (SELECT n.id, replace(name, ' ', '_') AS name, path, name || ' ' || content AS text, coalesce(degree, 0) AS weight FROM n LEFT JOIN g ON g.id = n.id),
qs AS (SELECT DISTINCT 'w ' || p_name AS query, p_name AS text FROM part UNION SELECT DISTINCT 's ' || p_type, replace(p_name, ' ', '_') || ' of ' || p_type FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_type)
 UNION SELECT 'p ' || p_brand, 'see ' || min(path) || ' please' FROM part JOIN n ON n.id = p_partkey GROUP BY p_brand UNION SELECT 'e ' || r_name, '?! .' FROM region)"""


def _lookups(t: Tables):
    n, p = _nodes(t), t.part
    name = F.regexp_replace("p_name", " ", "_")
    least = p.groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey")).join(p.select("p_partkey", "p_name"), "p_partkey")
    q = p.select(F.concat(F.lit("w "), "p_name").alias("query"), F.col("p_name").alias("text"))
    q = q.unionByName(least.select(F.concat(F.lit("s "), "p_type").alias("query"), F.concat(name, F.lit(" of "), "p_type").alias("text")))
    brands = p.join(n, F.col("id") == F.col("p_partkey")).groupBy("p_brand").agg(F.min("path").alias("path"))
    q = q.unionByName(brands.select(F.concat(F.lit("p "), "p_brand").alias("query"), F.concat(F.lit("see "), "path", F.lit(" please")).alias("text")))
    q = q.unionByName(t.region.select(F.concat(F.lit("e "), "r_name").alias("query"), F.lit("?! .").alias("text")))
    degree = _edges(t).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("weight"))
    nodes = n.join(degree, "id", "left").select("id", F.regexp_replace("name", " ", "_").alias("name"), "path", F.concat_ws(" ", "name", "content").alias("text"), F.coalesce("weight", F.lit(0)).alias("weight"))
    return q.distinct(), nodes


_TIER = "t{k} AS MATERIALIZED (SELECT query, id, {k} AS tier FROM (SELECT x.query, x.id, x.weight, row_number() OVER (PARTITION BY x.query ORDER BY x.weight DESC, x.id) AS n, coalesce(c, 0) AS has FROM ({find}) x LEFT JOIN (SELECT query, count(*) AS c FROM h{k} GROUP BY query) c ON c.query = x.query WHERE coalesce(c, 0) < {full} AND NOT EXISTS (SELECT 1 FROM h{k} h WHERE h.query = x.query AND h.id = x.id)) WHERE n + has <= 12 AND n <= {most})"


@registry.add(_LOOKUPS + """, tk AS (SELECT query, token, CASE WHEN contains(token, '/') THEN 'path' WHEN regexp_matches(token, '_|[0-9]|[a-z][A-Z]') THEN 'symbol' ELSE 'word' END AS class FROM (SELECT DISTINCT query, regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$', '', 'g') AS token FROM qs) WHERE length(token) >= 2),
ex AS (SELECT query, token, row_number() OVER (PARTITION BY query ORDER BY class <> 'symbol', length(token) DESC, token) AS spot FROM tk WHERE class <> 'path'),
px AS (SELECT query, lower(token) AS token, row_number() OVER (PARTITION BY query ORDER BY class <> 'symbol', length(token) DESC, token) AS spot FROM tk WHERE class <> 'path' AND length(token) >= 3),
wx AS (SELECT query, lower(token) AS token, row_number() OVER (PARTITION BY query ORDER BY length(token) DESC, token) AS spot FROM tk WHERE class = 'word' AND length(token) >= 3),
h0 AS (SELECT '' AS query, -1 AS id WHERE false), """
+ _TIER.format(k=0, full=12, most=12, find="SELECT DISTINCT query, id, weight FROM tk JOIN nd ON nd.path = token OR lower(nd.name) = lower(string_split(token, '/')[-1]) WHERE class = 'path'") + ", h1 AS (SELECT query, id FROM t0), "
+ _TIER.format(k=1, full=12, most=12, find="SELECT DISTINCT query, id, weight FROM ex JOIN nd ON nd.name = token WHERE spot <= 16") + ", h2 AS (SELECT query, id FROM t0 UNION ALL SELECT query, id FROM t1), "
+ _TIER.format(k=2, full=12, most=12, find="SELECT DISTINCT query, id, weight FROM px JOIN nd ON starts_with(lower(nd.name), token) OR contains(lower(nd.path), '/' || token) WHERE spot <= 6") + ", h3 AS (SELECT query, id FROM h2 UNION ALL SELECT query, id FROM t2), "
+ _TIER.format(k=3, full=10, most=10, find="SELECT DISTINCT query, id, weight FROM wx JOIN nd ON contains(lower(nd.text), token) OR contains(lower(nd.path), token) WHERE spot <= 2")
+ """ SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3
UNION ALL SELECT query, id, 4 FROM (SELECT DISTINCT query FROM qs WHERE query NOT IN (SELECT query FROM tk)), (SELECT id FROM nd ORDER BY weight DESC, id LIMIT 12)""")
def cascaded_search(t: Tables):
    """Names, kinds and files looked up among the nodes, twelve for each query, tier by tier while it is open."""
    q, nodes = _lookups(t)
    return Q.cascade(q, nodes, 12)


@registry.add("""WITH q AS (SELECT item_id AS query, unnest(list_filter(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)), lambda x: length(x) >= 4)) AS word FROM benchmark),
w AS MATERIALIZED (SELECT doc_id AS id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))) AS term FROM documents),
v AS (SELECT word, term FROM (SELECT DISTINCT word FROM q) JOIN (SELECT DISTINCT term FROM w) ON starts_with(term, word)), p AS (SELECT DISTINCT word, id FROM v JOIN w USING (term)),
r AS (SELECT word, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS rarity FROM p GROUP BY word), s AS (SELECT query, id, round(sum(rarity), 6) AS score FROM q JOIN p USING (word) JOIN r USING (word) GROUP BY ALL),
b AS (SELECT query, id, score, true AS found FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id DESC) AS n FROM s) WHERE n <= 10)
SELECT * FROM b UNION ALL SELECT item_id, d.doc_id, 0, false FROM benchmark, (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10) d WHERE item_id NOT IN (SELECT query FROM b)""")
def ranked_prefix_search(t: Tables):
    """The ten best documents for each item by the words that its words begin; the latest ones where there is none."""
    return Q.prefix_search(t.benchmark.select(F.col("item_id").alias("query"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"))
