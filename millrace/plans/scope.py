"""Queries: scopes of work, and plans by units inside them. Orders are tasks over the code base of parts of
`plans.retrieval`: an order's first part names what is to be mended, returned parts are changed files, accepted ones were
read lately."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import retrieval as V
from millrace.operators import scope as S
from millrace.plans.retrieval import _E, _HYBRID, _N, _edges, _hybrid, _nodes, registry as _retrieval
from millrace.registry import Registry, Tables

registry = Registry()

_ENDS = str(S.ENDINGS)
_SCOPE = f"""WITH {_N}, {_E}, dir AS (SELECT id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM n),
ln AS (SELECT l_orderkey AS task, path, l_returnflag AS flag, l_linenumber AS line, l_partkey AS id FROM lineitem JOIN n ON id = l_partkey),
fst AS (SELECT task, min((line, id))[2] AS id FROM ln GROUP BY task),
tk AS (SELECT o_orderkey AS task, 'fix ' || coalesce(p_name, 'it') || CASE o_orderpriority WHEN '1-URGENT' THEN ' in ./' || n.path || '.' WHEN '2-HIGH' THEN ' of ' || p_brand ELSE '' END AS text,
 CASE WHEN o_orderstatus = 'O' THEN 'pkg' || (o_custkey % 37) END AS package, CASE WHEN o_orderstatus <> 'F' THEN 'pkg' || (o_custkey % 31) END AS cwd
 FROM orders LEFT JOIN fst ON fst.task = o_orderkey LEFT JOIN n USING (id) LEFT JOIN part ON p_partkey = n.id),
nm AS (SELECT task, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_./-]+'), lambda x: regexp_replace(regexp_replace(x, '\\.+$', ''), '^(\\./)+', ''))) AS path FROM tk),
sg AS (SELECT task, path AS p, 'explicit_path' AS signal FROM nm WHERE contains(path, '.') AND regexp_extract(path, '([^.]*)$', 1) IN {_ENDS} UNION ALL SELECT task, path, 'changed_files' FROM ln WHERE flag = 'R'),
st AS (SELECT task, p AS member, signal FROM sg UNION ALL SELECT task, regexp_extract(p, '^(.*)/[^/]*$', 1), signal FROM sg UNION ALL SELECT task, coalesce(package, cwd), CASE WHEN package IS NOT NULL THEN 'current_package' ELSE 'cwd_locality' END FROM tk),
pm AS (SELECT DISTINCT task, member FROM st WHERE member <> '' AND task IN (SELECT task FROM tk)),
dp AS (SELECT DISTINCT a.dir AS package, b.dir AS dependency FROM e JOIN dir a ON a.id = src JOIN dir b ON b.id = dst WHERE kind = 'import' AND a.dir <> b.dir),
nr AS (SELECT DISTINCT task, dependency AS member FROM pm JOIN dp ON package = member WHERE NOT EXISTS (SELECT 1 FROM pm q WHERE q.task = pm.task AND q.member = dependency)),
al AS (SELECT task, member, signal, true AS strong FROM st WHERE member <> '' UNION ALL SELECT task, path, 'recent_files', false FROM ln WHERE flag = 'A' UNION ALL SELECT task, member, 'dep_neighborhood', false FROM nr),
ev AS (SELECT * FROM al WHERE task IN (SELECT task FROM tk))
"""


def _scope(t: Tables):
    n = _nodes(t)
    lines = t.lineitem.join(n, F.col("id") == F.col("l_partkey")).select(F.col("l_orderkey").alias("task"), "path", F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"), "id")
    first = lines.groupBy("task").agg(F.min(F.struct("line", "id"))["id"].alias("id")).join(n, "id", "left").join(t.part.select(F.col("p_partkey").alias("id"), "p_brand"), "id", "left")
    o = t.orders.join(first.select(F.col("task").alias("o_orderkey"), "name", "path", "p_brand"), "o_orderkey", "left")
    tail = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" in ./"), "path", F.lit("."))).when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" of "), "p_brand")).otherwise("")
    pkg = lambda m: F.concat(F.lit("pkg"), (F.col("o_custkey") % m).cast("string"))
    text = F.concat(F.lit("fix "), F.coalesce("name", F.lit("it")), tail)
    tasks = o.select(F.col("o_orderkey").alias("task"), text.alias("text"), F.when(F.col("o_orderstatus") == "O", pkg(37)).alias("package"), F.when(F.col("o_orderstatus") != "F", pkg(31)).alias("cwd"))
    d = n.select("id", V.folder(F.col("path")).alias("dir"))
    deps = _edges(t).where("kind = 'import'").join(d.select(F.col("id").alias("src"), F.col("dir").alias("package")), "src").join(d.select(F.col("id").alias("dst"), F.col("dir").alias("dependency")), "dst")
    return S.infer(tasks, lines.where("flag = 'R'"), lines.where("flag = 'A'"), deps.where("package <> dependency").select("package", "dependency"))


@registry.add(_SCOPE + "SELECT task, member, CASE WHEN bool_or(strong) THEN 'primary' ELSE 'secondary' END AS tier, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM ev GROUP BY task, member")
def scope_members(t: Tables):
    """What each order's scope holds: named and changed files and their folders, packages, recent files, dependencies."""
    return _scope(t)[0]


_SURE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SIGNALS.items())


@registry.add(_SCOPE + f""", sy AS (SELECT DISTINCT task FROM (SELECT task, unnest(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z0-9_]+')) AS w FROM tk) WHERE (regexp_matches(w, '^[A-Z]') AND length(w) >= 3) OR regexp_matches(w, '^[a-z]+[A-Z]')),
sd AS (SELECT DISTINCT task, signal FROM ev UNION SELECT task, 'exact_symbol' FROM sy), c AS (SELECT task, sum(CASE signal {_SURE} END) AS s, string_agg(signal, ',' ORDER BY signal) AS signals FROM sd GROUP BY task), m AS (SELECT task, count(DISTINCT member) AS members FROM ev GROUP BY task)
SELECT tk.task, round(greatest({S.LEAST}, least({S.MOST}, coalesce(s, 0))), 6)::DOUBLE AS confidence, coalesce(signals, '') AS signals, coalesce(members, 0)::BIGINT AS members FROM tk LEFT JOIN c USING (task) LEFT JOIN m USING (task)""")
def scope_confidence(t: Tables):
    return _scope(t)[1]


_VOTES = """, hp AS (SELECT task, score, path, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS parts FROM hy JOIN n USING (id) WHERE place <= 20 AND score > 0),
vo AS (SELECT task, folder, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS depth, round(sum(score), 6) AS votes FROM (SELECT task, score, '' AS folder FROM hp UNION ALL SELECT task, score, unnest([array_to_string(parts[1:i], '/') for i in generate_series(1, len(parts))]) FROM hp WHERE parts[1] <> '') GROUP BY ALL),
lo AS (SELECT task, arg_max(folder, depth) AS folder, max(depth) AS depth, arg_max(votes, depth) AS votes, any_value(total) AS total FROM (SELECT *, max(CASE WHEN folder = '' THEN votes END) OVER (PARTITION BY task) AS total FROM vo) WHERE votes > 0.5 * total GROUP BY task)"""


@registry.add(_HYBRID + _VOTES + " SELECT task, folder, depth, votes, total FROM lo")
def scope_votes(t: Tables):
    """The folder that holds most of what hybrid retrieval finds for each name; the root where none does."""
    hits = _hybrid(t).join(_nodes(t).select("id", "path"), "id").select("task", "path", "score")
    return S.localize(hits)


_PLAN = _retrieval.oracles["subsystem_plan"]
_HEAD, _LAST = _PLAN.rsplit("\nSELECT", 1)
BUDGET = 120


@registry.add(
    _HEAD.replace("WITH", "WITH RECURSIVE", 1)
    + ", pn AS (SELECT" + _LAST + f"""),
cu AS (SELECT pn.task, id, path, 'signature' AS unit, 1 AS rank, (length('code ' || name) + 3) // 4 AS tokens, round(least(score, 1.0) * 0.6, 6) AS v, 0.9::DOUBLE AS re FROM pn JOIN n USING (id) WHERE name <> '' UNION ALL
 SELECT pn.task, id, path, 'definition', 2, (length(name || ' is a ' || content) + 3) // 4, round(least(score, 1.0), 6), 0.7 FROM pn JOIN n USING (id)),
ou AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(v * (1 + 0.2 * re) / greatest(1, tokens), 12) DESC, path, rank, id) AS k FROM cu),
gu AS (SELECT task, 0::BIGINT AS k, 0::BIGINT AS spent, 1.0::DOUBLE AS wrong, false AS done, NULL::BIGINT AS took FROM (SELECT DISTINCT task FROM ou) UNION ALL
 SELECT gu.task, gu.k + 1, CASE WHEN NOT done AND spent + tokens <= {BUDGET} THEN spent + tokens ELSE spent END, CASE WHEN NOT done AND spent + tokens <= {BUDGET} THEN wrong * (1 - v * 0.8) ELSE wrong END,
  done OR (spent + tokens <= {BUDGET} AND 1 - wrong * (1 - v * 0.8) >= 0.85 AND spent + tokens >= 40), CASE WHEN NOT done AND spent + tokens <= {BUDGET} THEN gu.k + 1 END FROM gu JOIN ou ON ou.task = gu.task AND ou.k = gu.k + 1),
tu AS (SELECT ou.* FROM gu JOIN ou ON ou.task = gu.task AND ou.k = gu.took)
SELECT task, id, unit, tokens::BIGINT AS tokens, row_number() OVER (PARTITION BY task ORDER BY rank, path, id) AS place FROM tu""")
def planned_units(t: Tables):
    """The planner to its end: what subsystem_plan keeps, in signatures and definitions, chosen under a budget of tokens and
    put into the order of a prompt."""
    kept = _retrieval.queries["subsystem_plan"](t.spark, t.sf_dir)
    n = _nodes(t).select("id", "path", "name", F.lit("code").alias("kind"), F.lit(None).cast("string").alias("signature"), F.concat("name", F.lit(" is a "), "content").alias("content"))
    cands = kept.select("task", "id", F.least("score", F.lit(1.0)).alias("score")).join(n, "id")
    return S.plan_units(cands, BUDGET, 0.85, 40)
