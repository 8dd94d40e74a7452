"""Queries: task profiles and budgets, contracts over retrieved evidence, gates, actions, order and stability.

Tasks and evidence are those of plans/retrieval: names of parts, and what hybrid retrieval finds for them. A task's
contract is what the newest part of its name calls: the files are its required evidence, the names its claims."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.text import estimate_tokens
from millrace.operators import assess as A
from millrace.operators import evidence as E
from millrace.operators import packing as P
from millrace.operators import policy
from millrace.plans.memories import _PACK, _RANKED, _pack_input, _ranked
from millrace.plans.retrieval import _BAG, _E, _HYBRID, _N, _edges, _hybrid, _links, _nodes, _tasks
from millrace.plans.text import _WORDS
from millrace.registry import Registry, Tables
from millrace.sources.work import sent, table

registry = Registry()
CONFLICT, STALE = "#25", 5  # what marks evidence as in conflict, and the least revision that is not stale


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


def _sum(groups) -> str:
    return " + ".join(f"CASE WHEN {_has(ws)} THEN {v} ELSE 0 END" for ws, v in groups)


def _profile_sql(source: str) -> str:
    """CTE pf of the profiles of `source` (key, text)."""
    w = A.DIFFICULTY
    lookups = " OR ".join(f"starts_with(low, '{x}')" for x in A.LOOKUPS)
    return f"""pa0 AS (SELECT key, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM {source}),
pb0 AS (SELECT *, len(regexp_extract_all(text, '{A.FILE}')) AS files, len(regexp_extract_all(text, '{A.SYMBOL}')) AS symbols, CASE WHEN len({_WORDS}) = 0 THEN 1 ELSE floor(len({_WORDS}) * 1.3 + 0.999) END::BIGINT AS tok FROM pa0),
pc0 AS (SELECT *, least(1.0, 0.2 + CASE WHEN tok < 10 THEN 0.3 ELSE 0 END + {_sum(A.AMBIGUITY)})::DOUBLE AS ambiguity, least(1.0, 0.1 + {_sum(A.RISK)})::DOUBLE AS risk, greatest(1, files * 5 + symbols * 3 + tok // 50 + {_sum(A.SCOPE)})::BIGINT AS scope,
 CASE WHEN {_has(A.DEEP)} THEN 4 WHEN files > 2 OR symbols > 2 THEN 3 ELSE 1 END AS depth, ({lookups}) AND files <= 2 AS bypass FROM pb0),
pd0 AS (SELECT *, round({w['scope']} * least(1.0, scope / 50.0) + {w['depth']} * depth / 5.0 + {w['ambiguity']} * ambiguity + {w['novelty']} * 0.3 + {w['risk']} * risk, 9)::DOUBLE AS difficulty FROM pc0),
pf AS (SELECT key, files, symbols, scope, depth, risk, ambiguity, difficulty, CASE WHEN bypass THEN 'T0' WHEN difficulty < 0.25 THEN 'T1' WHEN difficulty < 0.5 THEN 'T2' WHEN difficulty < 0.75 THEN 'T3' ELSE 'T4' END AS class, CASE WHEN bypass THEN 0 WHEN difficulty < 0.25 THEN 1 WHEN difficulty < 0.5 THEN 3 WHEN difficulty < 0.75 THEN 6 ELSE 12 END AS calls FROM pd0)"""


@registry.add(f"WITH x AS (SELECT conv_id, turn, row_number() OVER () AS key, text FROM conversations), {_profile_sql('x')} SELECT conv_id, turn, files, symbols, scope, depth, round(risk, 6) AS risk, round(ambiguity, 6) AS ambiguity, difficulty, class, calls FROM pf JOIN x USING (key)")
def task_profile(t: Tables):
    """Features, difficulty and class of every turn, read as a task."""
    return t.conversations.select("conv_id", "turn", A.task_profile(F.col("text")).alias("p")).select("conv_id", "turn", "p.*")


#: Models of a request: name, difficulty they are trusted with, dollars for a million tokens in and out.
MODELS = [policy.Model("large", 0.9, 3.0, 15.0), policy.Model("small", 0.3, 0.25, 1.25), policy.Model("local", 0.24, 0.0, 0.0)]
_BY_PRICE = sorted(MODELS, key=lambda m: m.dollars_in + m.dollars_out)
_MODEL_SQL = "CASE WHEN class = 'T0' THEN NULL " + " ".join(f"WHEN difficulty <= {m.capability} THEN {{{i}}}" for i, m in enumerate(_BY_PRICE)) + f" ELSE {{{len(_BY_PRICE)}}} END"
_COSTLY = max(_BY_PRICE, key=lambda m: m.capability)
_DOLLARS = [f"round((toks * {m.dollars_in} + 500 * {m.dollars_out}) / 1e6, 9)" for m in [*_BY_PRICE, _COSTLY]]


@registry.add(f"""WITH x AS (SELECT conv_id, turn, row_number() OVER () AS key, text, CASE WHEN len({_WORDS}) = 0 THEN 1 ELSE floor(len({_WORDS}) * 1.3 + 0.999) END::BIGINT AS toks FROM conversations), {_profile_sql('x')},
j AS (SELECT x.conv_id, x.turn, class, round(pf.risk, 6) AS risk, {_MODEL_SQL.format(*[f"'{m.name}'" for m in [*_BY_PRICE, _COSTLY]])} AS model, coalesce({_MODEL_SQL.format(*_DOLLARS)}, 0)::DOUBLE AS dollars, CASE WHEN class = 'T0' THEN 0 ELSE calls + {policy.SPARE_CALLS} END AS calls FROM pf JOIN x USING (key)),
b AS (SELECT *, round(greatest(0, least({policy.MOST_DOLLARS * policy.RESERVE}, {policy.MOST_DOLLARS} - dollars)), 9)::DOUBLE AS spare FROM j)
SELECT conv_id, turn, class, risk, model, dollars, calls, CASE WHEN class = 'T0' OR risk < 0.15 THEN 0 WHEN risk < 0.40 THEN 2 WHEN risk < 0.70 THEN CASE WHEN spare >= 0.005 THEN 3 ELSE 2 END WHEN spare >= 0.05 THEN 4 WHEN spare >= 0.005 THEN 3 ELSE 2 END AS level FROM b""")
def compute_plans(t: Tables):
    """Every turn as a task: model, dollars, calls and level of verification, by its assessed difficulty and risk."""
    c = t.conversations.withColumn("p", A.task_profile(F.col("text"))).withColumn("c", policy.compute_plan(F.col("p"), estimate_tokens(F.col("text")), MODELS))
    return c.select("conv_id", "turn", "p.class", "p.risk", "c.model", "c.dollars", "c.calls", "c.level")


@registry.add("""
WITH m AS (SELECT conv_id, min(turn) AS turn, count(*) AS turns, avg((role = 'user')::INT) AS u FROM conversations GROUP BY conv_id), x AS (SELECT m.*, lower(coalesce(text, '')) AS low FROM m JOIN conversations USING (conv_id, turn)),
k AS (SELECT *, CASE """ + " ".join(
    f"WHEN {' OR '.join(p for p in (_has(ws) if ws else '', f'turns > {d}' if d is not None else '') if p) or 'true'} THEN {i}" for i, (_, ws, d, *_) in enumerate(A.KINDS)
) + " END AS i FROM x), v AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {b}::DOUBLE, {lo}, {hi})" for i, (k, _, _, b, _, lo, hi) in enumerate(A.KINDS)) + """) AS v(i, kind, base, least, most))
SELECT conv_id, turn, kind, greatest(least, least(most, round((least + (most - least) * (0.6 * base + 0.4 * u)) / 256) * 256))::BIGINT AS budget FROM k JOIN v USING (i)
""".replace("greatest(least, least(most,", "greatest(v.least, least(v.most,").replace("(least + (most - least)", "(v.least + (v.most - v.least)"))
def adaptive_budget(t: Tables):
    """The budget of each conversation: its first turn is the task, its turns the edges, the user's share the uncertainty."""
    m = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.count("*").alias("turns"), F.avg((F.col("role") == "user").cast("int")).alias("u"))
    x = m.join(t.conversations.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return x.select("conv_id", "turn", A.task_budget(F.col("text"), F.col("turns"), F.col("u")).alias("b")).select("conv_id", "turn", "b.kind", "b.budget")


_UNSURE = 0.4


@registry.add(
    _RANKED.replace("WITH mem", "WITH RECURSIVE mem")
    + f""", o AS (SELECT source, id, greatest(1, tokens) AS tokens, conf, row_number() OVER (PARTITION BY source ORDER BY density DESC, id) AS n FROM k WHERE density IS NOT NULL),
g AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS spent, 0::BIGINT AS taken, false AS done FROM (SELECT DISTINCT source FROM o)
 UNION ALL SELECT g.source, g.n + 1, CASE WHEN fits AND NOT stop THEN spent + tokens ELSE spent END, taken + (fits AND NOT stop)::INT, done OR (fits AND stop)
 FROM g JOIN (SELECT * FROM o) o ON o.source = g.source AND o.n = g.n + 1, LATERAL (SELECT NOT done AND spent + tokens <= 1024 AS fits, spent >= 512 AND conf * (1 - {_UNSURE} * 0.5) * 3.0 * 0.001 < 0.000003 * tokens AS stop) l)
SELECT source, arg_max(spent, n) AS spent, arg_max(taken, n) AS taken, bool_or(done) AS stopped FROM g GROUP BY source"""
)
def early_stop_pack(t: Tables):
    """What the budget of a small edit takes of each source before an item is worth less than its tokens."""
    plan = A.task_budget(F.lit("fix a test"), F.lit(0), F.lit(_UNSURE))  # 1024 tokens
    c = _ranked(t).where("density is not null").withColumn("tokens", F.greatest(F.lit(1), "tokens").cast("long"))
    c = P.fitting(c, ["source"], 2048, F.desc("density"), F.col("id"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("density")).alias("o"), "id", "tokens", F.col("conf").alias("confidence"))))
    g = c.groupBy("source").agg(items.alias("items")).select("source", A.early_stop_pack(F.col("items"), plan, F.lit(_UNSURE)).alias("g"))
    return g.select("source", "g.spent", "g.taken", F.col("g.done").alias("stopped"))


@registry.add(
    _PACK
    + """, b AS (SELECT source, max((fused, -id)) AS best FROM o WHERE tokens <= 2000 GROUP BY source), j AS (SELECT e.source, spent, chosen, score, best[1] AS bs, -best[2] AS bid FROM e LEFT JOIN b USING (source)),
q AS (SELECT j.*, o.tokens AS bt, coalesce(bs > score, false) AS rescued FROM j LEFT JOIN o ON o.source = j.source AND o.id = bid),
h AS (SELECT source, 0::BIGINT AS n, bt AS spent, [bid] AS chosen, bs AS score, bid FROM q WHERE rescued
 UNION ALL SELECT h.source, h.n + 1, CASE WHEN o.id <> bid AND spent + tokens <= 2000 THEN spent + tokens ELSE spent END, CASE WHEN o.id <> bid AND spent + tokens <= 2000 THEN list_append(chosen, o.id) ELSE chosen END,
  CASE WHEN o.id <> bid AND spent + tokens <= 2000 THEN score + fused ELSE score END, bid FROM h JOIN o ON o.source = h.source AND o.n = h.n + 1),
hf AS (SELECT source, arg_max(spent, n) AS spent, arg_max(chosen, n) AS chosen, arg_max(score, n) AS score FROM h GROUP BY source)
SELECT q.source, coalesce(hf.spent, q.spent) AS spent, array_to_string(coalesce(hf.chosen, q.chosen), ',') AS chosen, round(coalesce(hf.score, q.score), 8) AS score, rescued FROM q LEFT JOIN hf USING (source)"""
)
def plan_passes(t: Tables):
    """Greedy, rescue by the best single item, and the fill of what it leaves."""
    return P.singleton_rescue(_pack_input(t), "source", 2000, fill=True).select("source", "spent", F.array_join(F.col("chosen").cast("array<string>"), ",").alias("chosen"), F.round("score", 8).alias("score"), "rescued")


# ---- contracts over retrieved evidence

_CONTRACT = _HYBRID + f""", tg AS (SELECT task, max(id) AS id FROM t JOIN n ON name = task GROUP BY task),
vi AS (SELECT hy.task, hy.id, hy.score, n.path, n.name || ' ' || n.content AS text, contains(n.content, '{CONFLICT}') AS conflict, n.revision < {STALE} AS stale FROM hy JOIN n USING (id) WHERE hy.place <= 20),
rq AS (SELECT DISTINCT tg.task, n.path, n.name AS claim FROM tg JOIN e ON e.src = tg.id AND e.kind = 'call' JOIN n ON n.id = e.dst),
pe AS (SELECT task, count(*) AS evidence, bool_or(conflict) AS conflict, bool_or(stale) AS stale, max(score) AS top FROM vi GROUP BY task),
rr AS (SELECT w.task, count(*) AS required, count(v.path) AS matched FROM (SELECT DISTINCT task, path FROM rq) w LEFT JOIN (SELECT DISTINCT task, path FROM vi) v ON v.task = w.task AND v.path = w.path GROUP BY w.task),
cs AS (SELECT DISTINCT task, claim FROM rq), cw AS (SELECT task, claim, len({_BAG.format('claim')}) AS n, unnest({_BAG.format('claim')}) AS term FROM cs), vw AS (SELECT task, id, conflict, unnest({_BAG.format('text')}) AS term FROM vi),
ov AS (SELECT task, claim, id, conflict, count(*)::DOUBLE / max(n) AS o FROM cw JOIN vw USING (task, term) GROUP BY ALL), bc AS (SELECT task, claim, max(o) AS best, bool_or(conflict AND o >= 0.5) AS bad FROM ov GROUP BY ALL),
cl AS (SELECT cs.task, coalesce(best, 0) AS best, coalesce(bad, false) AS bad FROM cs LEFT JOIN bc USING (task, claim)),
qq AS (SELECT task, count(*) AS claims, count(*) FILTER (best < 0.5) AS missing, avg((best >= 0.5)::INT) AS coverage, avg((best >= 0.6 AND NOT bad)::INT) AS precision, avg((best < 0.6 AND NOT bad)::INT) AS unsupported, avg(bad::INT) AS contradicted FROM cl GROUP BY task),
ct AS (SELECT t.task, coalesce(evidence, 0) AS evidence, coalesce(conflict, false) AS conflict, coalesce(stale, false) AS stale, coalesce(top, 0) AS top, coalesce(required, 0) AS required, coalesce(matched, 0) AS matched, coalesce(claims, 0) AS claims, coalesce(missing, 0) AS missing,
 coalesce(coverage, 1) AS coverage, coalesce(precision, 1) AS precision, coalesce(unsupported, 0) AS unsupported, coalesce(contradicted, 0) AS contradicted FROM t LEFT JOIN pe USING (task) LEFT JOIN rr USING (task) LEFT JOIN qq USING (task)),
ly AS (SELECT *, CASE WHEN evidence = 0 OR (required > 0 AND matched = 0) THEN 'existence' WHEN stale THEN 'provenance' WHEN conflict THEN 'contradiction' WHEN coverage < 0.8 THEN 'semantic' WHEN required > 0 AND matched < 0.8 * required THEN 'dependency' WHEN missing > 0 THEN 'readiness' END AS failure,
 CASE WHEN evidence = 0 OR (required > 0 AND matched = 0) THEN 0 ELSE 0.15 + 0.25 * coverage + 0.20 * CASE WHEN required > 0 THEN matched::DOUBLE / required ELSE 1 END + 0.15 * (NOT conflict)::INT + 0.10 * (NOT stale)::INT + 0.15 * (missing = 0 AND coverage >= 0.8)::INT END::DOUBLE AS composite FROM ct)
"""


def _required(t: Tables, n, links):
    """task, path, claim: what the newest node of each task's name calls."""
    # one node for each name, so all nodes are grouped by name before any is shuffled, and edges stay where they are read
    newest = n.groupBy(F.col("name").alias("task")).agg(F.max("id").alias("src")).join(_tasks(t), "task", "left_semi")
    calls = links.where("kind = 'call'").select("src", F.col("dst").alias("id")).join(sent(table(newest, "newest")), "src")
    return table(calls, "calls").join(n.select("id", "path", F.col("name").alias("claim")), "id").select("task", "path", "claim")


def _contract(t: Tables):
    n, links = _nodes(t), table(_links(t), "edges")
    got = _hybrid(t, links=links).select("task", "id", "score").join(n, "id")
    ev = got.select("task", "id", "path", F.concat_ws(" ", "name", "content").alias("text"), F.col("content").contains(CONFLICT).alias("conflict"), (F.col("revision") < STALE).alias("stale"))
    tasks, rq = _tasks(t), _required(t, n, links)
    top = got.groupBy("task").agg(F.max("score").alias("top"))
    return A.contract(tasks, ev, rq.select("task", "path"), rq.select("task", "claim")).join(top, "task", "left").fillna({"top": 0.0})


@registry.add(_CONTRACT + "SELECT task, round(composite, 6) AS composite, failure IS NULL AS sufficient, failure FROM ly")
def layered_sufficiency(t: Tables):
    """Six layers of sufficiency of what retrieval finds for each task's contract."""
    return _contract(t).select("task", A.layers().alias("l")).select("task", "l.*")


@registry.add(_CONTRACT + """SELECT task, CASE WHEN contradicted > 0.5 THEN 'INVESTIGATE_CONFLICT' WHEN failure IS NOT NULL THEN CASE WHEN missing > 2 OR coverage = 0 THEN 'ABSTAIN' ELSE 'RETRIEVE_MORE' END WHEN contradicted > 0 THEN 'INVESTIGATE_CONFLICT' WHEN unsupported > 0.4 THEN 'ABSTAIN' WHEN precision < 0.6 AND claims > 0 THEN 'RETRIEVE_MORE' ELSE 'ANSWER' END AS action,
CASE WHEN contradicted > 0.5 THEN 'R5' WHEN failure IS NOT NULL THEN 'R4' WHEN contradicted > 0 THEN 'R5' WHEN unsupported > 0.4 OR (precision < 0.6 AND claims > 0) THEN 'R7' ELSE '' END AS code FROM ly""")
def answer_gate(t: Tables):
    """Whether to answer each task from what was found for it."""
    c = F.col
    gate = E.answer_gate(c("contradicted") > 0.5, c("l.sufficient"), c("missing"), c("coverage"), c("contradicted"), c("unsupported"), c("precision"), c("claims"))
    return _contract(t).withColumn("l", A.layers()).select("task", gate.alias("g")).select("task", "g.action", "g.code")


_DOLLARS, _TOKENS, _HIT, _PENALTY = 0.5, 4096, 0.8, 0.02  # of a request: what is left to spend, and the state of its cache


@registry.add(_CONTRACT + ", ks AS (SELECT task AS key, task AS text FROM t), " + _profile_sql("ks") + f""",
st1 AS (SELECT ly.task, coverage, difficulty, risk AS impact, round(greatest(0.05, least(0.99, 0.75 * (least(1.0, top) - 0.40 * (1 - coverage) - 0.35 * contradicted - 0.20 * difficulty) + 0.125)), 9) AS conf FROM ly JOIN pf ON key = task),
st2 AS (SELECT *, round(least(1.0, (1 - conf) * (0.5 + 0.5 * impact)), 9) AS risk FROM st1),
av AS (SELECT task, 'stop' AS action, 0 AS f, 0::DOUBLE AS voi FROM st2
 UNION ALL SELECT task, 'retrieve', -1, round(least(0.99, conf + 0.35 * (1 - coverage)) - conf - 0.015 - 0.05 * 0.2 + 2 * risk * 0.6 * (1 - coverage), 9) FROM st2 WHERE coverage < 0.9
 UNION ALL SELECT task, 'think', -2, round(least(0.99, conf + coverage * (0.10 + 0.30 * difficulty)) - conf - 0.08 - 0.05 * 2.5 + 2 * risk * 0.3 - {1 - _HIT} * {_PENALTY}, 9) FROM st2
 UNION ALL SELECT task, 'verify', -3, round(least(0.99, conf + 0.05) - conf - 0.035 - 0.05 * 0.8 + 2 * risk * 0.75, 9) FROM st2 WHERE coverage >= 0.65 AND risk > 0.10
 UNION ALL SELECT task, 'escalate', -4, round(least(0.99, conf + 0.30 * difficulty) - conf - 0.25 - 0.05 * 4.0 + 2 * risk * 0.6, 9) FROM st2 WHERE difficulty > 0.60),
bs AS (SELECT task, max(voi) AS voi, arg_max(action, (voi, f)) AS action FROM av GROUP BY task)
SELECT task, floor(conf * 1e6 + 0.5) / 1e6 AS confidence, floor(risk * 1e6 + 0.5) / 1e6 AS risk, action, floor(voi * 1e6 + 0.5) / 1e6 AS voi, CASE WHEN risk <= 0.05 AND coverage >= 0.85 AND voi <= 0 THEN 'target' WHEN voi <= 0 AND conf >= 0.7 THEN 'returns' END AS stop FROM st2 JOIN bs USING (task)""")
def best_action(t: Tables):
    """Calibrated confidence and risk of each task, the action worth most, and why a loop would stop."""
    c = F.col
    s = _contract(t).withColumn("p", A.task_profile(c("task")))
    s = s.withColumn("confidence", A.calibrated(F.least(F.lit(1.0), c("top")), c("p.difficulty"), c("coverage"), c("contradicted")))
    s = s.withColumn("risk", A.residual_risk(c("confidence"), c("p.risk")))
    s = s.withColumn("a", A.best_action(c("confidence"), c("risk"), c("coverage"), c("p.difficulty"), F.lit(_DOLLARS), F.lit(_TOKENS), F.lit(_HIT), F.lit(_PENALTY)))
    stop = A.stop_reason(F.lit(0), F.lit(_DOLLARS), c("risk"), c("coverage"), c("confidence"), c("a.voi"))
    # halves go up by arithmetic, the same in any engine: round() of a number already rounded may go either way
    six = lambda x: F.floor(c(x) * 1e6 + 0.5) / 1e6
    return s.select("task", six("confidence").alias("confidence"), six("risk").alias("risk"), "a.action", six("a.voi").alias("voi"), stop.alias("stop"))


def _asked(task):
    return F.concat(task, F.when(task.startswith("b"), " test").otherwise(""), F.lit(" without pkg1"))


_NEG = "|".join(A.NEGATIONS)


@registry.add(_HYBRID + f""", ak AS (SELECT task, lower(task || CASE WHEN starts_with(task, 'b') THEN ' test' ELSE '' END || ' without pkg1') AS low FROM t),
aw AS (SELECT task, {_BAG.format('low')} AS words, list_distinct(regexp_extract_all(low, '(?:^|\\s)(?:{_NEG})\\s+([a-z0-9_]+)', 1)) AS neg FROM ak),
kp AS (SELECT task, words, neg, list_filter(words, lambda w: NOT list_contains({list(A.NEGATIONS)}, w) AND length(w) >= 3 AND len(list_filter(neg, lambda m: contains(w, m))) = 0) AS kept FROM aw),
cd2 AS (SELECT task, hy.id, lower(path) AS path, lower(name) AS name, lower(name || ' ' || content) AS body, hy.score, words, neg, kept, regexp_matches(lower(path), '_test\\.go$|/test/') AS test FROM hy JOIN n USING (id) JOIN kp USING (task) WHERE hy.place <= 20),
sc AS (SELECT task, id, path, len(list_filter(neg, lambda m: length(m) >= 3 AND (contains(path, m) OR contains(name, m)))) > 0 AS hit,
 score + coalesce(list_sum(list_transform(list_filter(kept, lambda w: NOT regexp_matches(w, '^[a-z][a-z]*[0-9_]')), lambda w: least(1.0, length(w) / 8.0) * CASE WHEN contains(path, w) THEN 0.35 WHEN contains(body, w) THEN 0.20 ELSE 0 END)), 0)
 + coalesce(list_sum(list_transform(list_filter(kept, lambda w: regexp_matches(w, '^[a-z][a-z]*[0-9_]')), lambda w: CASE WHEN contains(path, w) THEN 0.30 WHEN contains(body, w) THEN 0.15 ELSE 0 END)), 0)
 + 0.25 * len(list_filter({list(A.ARTIFACTS)}, lambda a: list_contains(words, a) AND contains(path, a))) + CASE WHEN test AND list_contains(words, 'test') THEN 0.20 WHEN test THEN -0.15 ELSE 0 END + 0.10 * CASE WHEN test THEN 0.5 ELSE 1 END AS s FROM cd2),
rk AS (SELECT task, id, path, round(CASE WHEN hit THEN 0.05 * s ELSE s END, 6)::DOUBLE AS score FROM sc)
SELECT task, id, score, row_number() OVER (PARTITION BY task ORDER BY score DESC, path, id) AS place FROM rk""")
def task_aware_rerank(t: Tables):
    """What retrieval found, in the order of what the task's text names, asks for and excludes."""
    cands = _hybrid(t).select("task", "id", "score").join(_nodes(t), "id").select("task", "id", "path", "name", F.concat_ws(" ", "name", "content").alias("text"), "score")
    asks = _tasks(t).withColumn("ask", A.represent(_asked(F.col("task"))))
    return A.rerank(cands, asks, authority=0.10)


@registry.add(_HYBRID + """, fq AS (SELECT task, regexp_extract(task, '([a-z]+)$', 1) AS family FROM t), ls AS (SELECT family, fq.task, coalesce(list(id) FILTER (id IS NOT NULL), []) AS ids FROM fq LEFT JOIN (SELECT task, id FROM hy WHERE place <= 10) h USING (task) GROUP BY ALL),
pp AS (SELECT a.family, CASE WHEN len(a.ids) + len(b.ids) = 0 THEN 1 ELSE len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(a.ids || b.ids)) END AS j FROM ls a JOIN ls b ON a.family = b.family AND a.task < b.task)
SELECT l.family, n AS queries, round(coalesce(psi, 1), 6)::DOUBLE AS psi FROM (SELECT family, count(*) AS n FROM ls GROUP BY family) l LEFT JOIN (SELECT family, avg(j) AS psi FROM pp GROUP BY family) p USING (family)""")
def paraphrase_stability(t: Tables):
    """How alike the first ten of tasks are that ask for the same thing."""
    q = _tasks(t).select(F.regexp_extract("task", "([a-z]+)$", 1).alias("family"), F.col("task").alias("query"))
    ranked = _hybrid(t).select(F.col("task").alias("query"), F.col("id").alias("item"), "place")
    return A.stability(q, ranked, 10).select("family", "queries", F.round("psi", 6).alias("psi"))


@registry.add(f"""WITH {_N}, {_E}, k AS (SELECT CASE WHEN path LIKE '%\\_test.go' ESCAPE '\\' THEN 'test' ELSE 'source' END AS kind, path, id FROM n), c AS (SELECT kind, count(DISTINCT path) AS files, count(*) AS symbols FROM k GROUP BY kind), d AS (SELECT kind, count(*) AS edges FROM e JOIN k ON k.id = src GROUP BY k.kind)
SELECT kind, files, symbols, coalesce(edges, 0) AS edges FROM c LEFT JOIN d USING (kind)""".replace("d AS (SELECT kind,", "d AS (SELECT k.kind,"))
def service_stats(t: Tables):
    """Files, symbols and edges of sources and of tests."""
    k = _nodes(t).withColumn("kind", F.when(F.col("path").endswith("_test.go"), "test").otherwise("source"))
    c = k.groupBy("kind").agg(F.countDistinct("path").alias("files"), F.count("*").alias("symbols"))
    d = _edges(t).select(F.col("src").alias("id")).join(k.select("id", "kind"), "id").groupBy("kind").agg(F.count("*").alias("edges"))
    return c.join(d, "kind", "left").fillna({"edges": 0})


@registry.add(f"WITH {_N}, {_E}, d AS (SELECT DISTINCT a.path, b.path AS dep FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.path <> b.path) SELECT path, count(*) AS deps, sha256(string_agg(dep, '|' ORDER BY dep)) AS hash FROM d GROUP BY path")
def dependency_hash(t: Tables):
    """The hash of the sorted files that each file depends on."""
    n = _nodes(t).select("id", "path")
    d = _edges(t).join(n.select(F.col("id").alias("src"), "path"), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("dep")), "dst").where("path <> dep").select("path", "dep").distinct()
    return d.groupBy("path").agg(F.count("*").alias("deps"), F.sha2(F.array_join(F.array_sort(F.collect_list("dep")), "|"), 256).alias("hash"))


@registry.add("WITH q AS (SELECT 'page' AS origin, page_id AS id, regexp_replace(coalesce(url, ''), '^[a-z]+://', '') AS text FROM pages UNION ALL SELECT 'item', item_id, coalesce(text, '') FROM benchmark UNION ALL SELECT 'part', p_partkey, coalesce(p_type, '') FROM part) SELECT origin, id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{c}'" for c, p in A.QUERY_CLASSES) + " ELSE 'conceptual' END AS class FROM q")
def query_class(t: Tables):
    """What each page's address, item and kind of part asks for, read as a query."""
    q = lambda df, origin, id_, text: df.select(F.lit(origin).alias("origin"), F.col(id_).alias("id"), A.query_class(text).alias("class"))
    pages = q(t.pages, "page", "page_id", F.regexp_replace("url", "^[a-z]+://", ""))
    return pages.unionByName(q(t.benchmark, "item", "item_id", F.col("text"))).unionByName(q(t.part, "part", "p_partkey", F.col("p_type")))


_COMPOSITE = "CASE WHEN ev = 0 OR (required > 0 AND matched = 0) THEN 0 ELSE 0.15 + 0.25 * coverage + 0.20 * CASE WHEN required > 0 THEN matched::DOUBLE / required ELSE 1 END + 0.15 * (conflicts = 0)::INT + 0.10 * (stales = 0)::INT + 0.15 * (met = claims AND coverage >= 0.8)::INT END::DOUBLE"
_FINE = "NOT (ev = 0 OR (required > 0 AND matched = 0)) AND stales = 0 AND conflicts = 0 AND coverage >= 0.8 AND (required = 0 OR matched >= 0.8 * required) AND met = claims"


def _subset(name: str, source: str, keys: str) -> str:
    """CTEs that judge the pieces of each group of `source` (task, keys.., place) anew."""
    return f"""{name}a AS (SELECT {keys}, count(*) AS ev, sum(conflict::INT) AS conflicts, sum(stale::INT) AS stales, sum(tokens) AS tokens FROM {source} JOIN pc USING (task, place) GROUP BY ALL),
{name}b AS (SELECT {keys}, count(DISTINCT what) FILTER (what[1:1] = 'c') AS met, count(DISTINCT what) FILTER (what[1:1] = 'p') AS matched FROM {source} JOIN gv USING (task, place) GROUP BY ALL),
{name} AS (SELECT *, round({_COMPOSITE}, 6) AS composite, {_FINE} AS fine FROM (SELECT a.*, coalesce(met, 0) AS met, coalesce(matched, 0) AS matched, coalesce(required, 0) AS required, coalesce(claims, 0) AS claims, CASE WHEN coalesce(claims, 0) > 0 THEN coalesce(met, 0)::DOUBLE / claims ELSE 1 END AS coverage
 FROM {name}a a LEFT JOIN {name}b USING ({keys}) LEFT JOIN wr USING (task) LEFT JOIN wc USING (task)))"""


@registry.add(_CONTRACT + f""",
pc AS MATERIALIZED (SELECT hy.task, hy.place, n.path, n.name || ' ' || n.content AS text, contains(n.content, '{CONFLICT}') AS conflict, n.revision < {STALE} AS stale, 10 + length(n.name) AS tokens FROM hy JOIN n USING (id) WHERE hy.place <= 20),
wr AS (SELECT task, count(DISTINCT path) AS required FROM rq GROUP BY task), wc AS (SELECT task, count(*) AS claims FROM cs GROUP BY task),
ph AS (SELECT task, place, unnest({_BAG.format('text')}) AS term FROM pc),
gv AS MATERIALIZED (SELECT task, 'c ' || claim AS what, place FROM (SELECT task, claim, place, count(*)::DOUBLE / max(n) AS o FROM cw JOIN ph USING (task, term) GROUP BY ALL) WHERE o >= 0.5 UNION ALL SELECT DISTINCT rq.task, 'p ' || rq.path, place FROM rq JOIN pc ON pc.task = rq.task AND pc.path = rq.path),
rs AS (SELECT a.task, a.place AS rung, b.place FROM pc a JOIN pc b ON a.task = b.task AND b.place <= a.place), {_subset('rg', 'rs', 'task, rung')},
mr AS (SELECT task, coalesce(min(rung) FILTER (fine AND composite >= 0.8), max(rung)) AS rung, count(*) AS rungs, max(tokens) AS full_ FROM rg GROUP BY task),
rl AS (SELECT mr.task, o.place AS leave, b.place FROM mr JOIN pc o ON o.task = mr.task AND o.place <= mr.rung JOIN pc b ON b.task = mr.task AND b.place <= mr.rung AND b.place <> o.place), {_subset('lo', 'rl', 'task, leave')},
mn AS (SELECT mr.task, avg((coalesce(lo.composite, 0) < g.composite OR NOT coalesce(lo.fine, false))::INT) AS minimality FROM mr JOIN rg g USING (task, rung) JOIN pc o ON o.task = mr.task AND o.place <= mr.rung LEFT JOIN lo ON lo.task = mr.task AND lo.leave = o.place GROUP BY mr.task)
SELECT task, rung, rungs, rg.tokens::BIGINT AS tokens, round(CASE WHEN rg.tokens > 0 THEN full_::DOUBLE / rg.tokens ELSE 1 END, 6)::DOUBLE AS compression, composite, fine AS sufficient, round(minimality, 6)::DOUBLE AS minimality FROM mr JOIN rg USING (task, rung) JOIN mn USING (task)""")
def contract_ladder(t: Tables):
    """The least prefix of what retrieval finds for each task that meets its contract, and what of it could be left out."""
    n, links = _nodes(t), table(_links(t), "edges")
    got = _hybrid(t, links=links).select("task", "id", "place").join(n, "id")
    ev = got.select("task", "id", "place", "path", F.concat_ws(" ", "name", "content").alias("text"), (10 + F.length("name")).alias("tokens"), F.col("content").contains(CONFLICT).alias("conflict"), (F.col("revision") < STALE).alias("stale"))
    rq = _required(t, n, links)
    out = A.ladder(_tasks(t), ev, rq.select("task", "path"), rq.select("task", "claim"))
    return out.select("task", "rung", "rungs", "tokens", F.round("compression", 6).alias("compression"), "composite", "sufficient", F.round("minimality", 6).alias("minimality"))
