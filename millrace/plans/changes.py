"""Queries: changes of a source tree and what rests on them, over the code base of parts and the memories of documents;
seeds of tasks, and terms learned for queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import changes as C
from millrace.operators import seeds as S
from millrace.plans.memories import _MEM, memories
from millrace.plans.retrieval import _E, _N, _edges, _nodes
from millrace.plans.text import _TOK
from millrace.registry import Registry, Tables

registry = Registry()

_TREES = f"""{_N}, {_E}, tr AS (SELECT path, id, p_type AS type, p_size AS size, md5(name) AS hash FROM n JOIN part ON p_partkey = id),
od AS (SELECT path, max(hash) AS hash FROM tr WHERE type <> 'ECONOMY' GROUP BY path), nd AS (SELECT path, max(CASE WHEN size >= 45 THEN md5(hash) ELSE hash END) AS hash FROM tr WHERE type <> 'PROMO' GROUP BY path),
ch AS (SELECT path, CASE WHEN od.path IS NULL THEN 'A' WHEN nd.path IS NULL THEN 'D' WHEN od.hash = nd.hash THEN 'U' ELSE 'M' END AS status FROM od FULL JOIN nd USING (path))"""


def _trees(t: Tables):
    n = _nodes(t).join(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_size").alias("size")), "id").withColumn("hash", F.md5("name"))
    new = n.withColumn("hash", F.when(F.col("size") >= 45, F.md5("hash")).otherwise(F.col("hash")))
    return n.where("type <> 'ECONOMY'").select("path", "hash"), new.where("type <> 'PROMO'").select("path", "hash")


@registry.add(f"WITH {_TREES} SELECT path, status FROM ch")
def manifest_changes(t: Tables):
    """Files of two states of the tree: one before a kind of parts came, one after another kind had gone and large ones changed."""
    return C.statuses(*_trees(t))


@registry.add(f"""WITH RECURSIVE {_TREES}, dp AS (SELECT DISTINCT a.path, b.path AS needs FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE kind = 'import' AND a.path <> b.path),
g AS (SELECT path FROM ch WHERE status <> 'U' UNION SELECT dp.path FROM g JOIN dp ON needs = g.path)
SELECT path FROM g WHERE path NOT IN (SELECT path FROM ch WHERE status <> 'U')""")
def affected_files(t: Tables):
    """The unchanged files that depend on changed ones over any number of steps."""
    n = _nodes(t).select("id", "path")
    deps = _edges(t).where("kind = 'import'").join(n.select(F.col("id").alias("src"), "path"), "src").join(n.select(F.col("id").alias("dst"), F.col("path").alias("needs")), "dst")
    return C.dependents(C.statuses(*_trees(t)), deps.select("path", "needs")).select("path")


@registry.add(f"""WITH {_N}, c AS (SELECT DISTINCT l_orderkey AS key, path FROM lineitem JOIN n ON id = l_partkey), f AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN path ELSE regexp_extract(path, '([^/]*)$', 1) END AS f FROM n JOIN part ON p_partkey = id WHERE p_size >= 50)
SELECT DISTINCT key FROM c WHERE EXISTS (SELECT 1 FROM f WHERE ends_with(path, f) OR ends_with(f, path))""")
def context_invalidation(t: Tables):
    """Contexts (orders, built on the files of their parts) that rest on a changed file; some changes are names without a folder."""
    n = _nodes(t)
    c = t.lineitem.join(n, F.col("id") == F.col("l_partkey")).select(F.col("l_orderkey").alias("key"), "path")
    big = n.join(t.part.where("p_size >= 50").select(F.col("p_partkey").alias("id"), "p_type"), "id")
    return C.built_on(c, big.select(F.when(F.col("p_type") == "PROMO", F.col("path")).otherwise(F.regexp_extract("path", "([^/]*)$", 1)).alias("path")))


@registry.add(_MEM + """, f AS (SELECT DISTINCT source || '/' || lang || CASE WHEN length(text) >= 4000 THEN '/' || doc_id ELSE '' END AS path FROM documents WHERE length(text) >= 3000 AND source <> 'src0')
SELECT mem.id, count(DISTINCT path) AS files FROM mem JOIN f ON location = path OR starts_with(location, path || '/') OR starts_with(path, location || '/') WHERE invalidated_at IS NULL AND authority IN ('source', 'commit') GROUP BY mem.id""")
def touched_memories(t: Tables):
    """Memories that come from sources and commits, and the changed paths at, above or below them."""
    m = memories(t).where(F.col("invalidated_at").isNull() & F.col("authority").isin("source", "commit"))
    tail = F.when(F.length("text") >= 4000, F.concat(F.lit("/"), F.col("doc_id").cast("string"))).otherwise("")
    f = t.documents.where((F.length("text") >= 3000) & (F.col("source") != "src0")).select(F.concat("source", F.lit("/"), "lang", tail).alias("path"))
    return C.touched(m, f)


_STEM = "regexp_extract(path, '([^/]*)[.]go$', 1)"


@registry.add(f"""WITH {_N}, sn AS (SELECT n.id, split_part(name, ' ', 2) AS name, path, p_size AS size, name AS task, {_STEM} AS stem FROM n JOIN part ON p_partkey = id),
tk AS (SELECT task, task || ' ' || arg_max(stem, id) AS text FROM sn GROUP BY task), w AS (SELECT DISTINCT task, unnest(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,}}')) AS w FROM tk),
nm AS (SELECT task, id, max(CASE WHEN lower(name) = w THEN 1.0 ELSE 0.5 END) AS s FROM w JOIN sn x ON contains(lower(name), w) OR contains(lower(path), w) GROUP BY ALL) """.replace("SELECT task, id, max", "SELECT w.task, x.id, max") + f""",
cf AS (SELECT DISTINCT task, CASE WHEN size = 50 THEN path ELSE stem || '.go' END AS f FROM sn WHERE size >= 48), mv AS (SELECT cf.task, sn.id, count(*) * 1.2 AS s FROM cf JOIN sn ON ends_with(path, f) OR ends_with(f, path) GROUP BY ALL),
ff AS (SELECT DISTINCT task, lower(stem) AS f FROM sn WHERE size = 1), br AS (SELECT ff.task, sn.id, count(*) * 1.5 AS s FROM ff JOIN sn ON contains(lower(name), f) OR contains(lower(path), f) GROUP BY ALL)
SELECT task, id, round(sum(s), 6)::DOUBLE AS seed FROM (SELECT * FROM nm UNION ALL SELECT * FROM mv UNION ALL SELECT * FROM br) GROUP BY task, id""")
def task_seeds(t: Tables):
    """Seeds of each name of a part: words and a file that it says, files that changed, tests that failed."""
    n = _nodes(t).join(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), "id")
    n = n.select("id", F.split_part("name", F.lit(" "), F.lit(2)).alias("name"), "path", "size", F.col("name").alias("task"), F.regexp_extract("path", "([^/]*)[.]go$", 1).alias("stem"))
    tasks = n.groupBy("task").agg(F.concat_ws(" ", "task", F.max_by("stem", "id")).alias("text"))
    changed = n.where("size >= 48").select("task", F.when(F.col("size") == 50, F.col("path")).otherwise(F.concat("stem", F.lit(".go"))).alias("path"))
    return S.seeds(tasks, n, changed, n.where("size = 1").select("task", F.col("stem").alias("name")))


@registry.add(f"""WITH d AS (SELECT {_TOK} AS t FROM documents), n AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM d) GROUP BY term),
x AS (SELECT unnest(list_zip(t[:-2], t[2:])) AS x FROM d WHERE len(t) > 1), ab AS (SELECT least(x[1], x[2]) AS a, greatest(x[1], x[2]) AS b, count(*) AS c FROM x WHERE x[1] <> x[2] GROUP BY ALL HAVING count(*) >= 3),
q AS (SELECT DISTINCT item_id AS key, unnest({_TOK}) AS term FROM benchmark), ea AS (SELECT a AS term, b AS partner, c FROM ab UNION ALL SELECT b, a, c FROM ab),
r AS (SELECT ea.term, partner, round(2.0::DOUBLE * c / (n.n + m.n), 9) AS dice FROM ea JOIN n ON n.term = ea.term JOIN n m ON m.term = partner WHERE ea.term IN (SELECT term FROM q)),
l AS (SELECT term, partner FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY dice DESC, partner) AS k FROM r) WHERE k <= 3)
SELECT key, term, max(weight)::DOUBLE AS weight FROM (SELECT key, term, 1.0 AS weight FROM q UNION ALL SELECT key, partner, 0.65 FROM q JOIN l USING (term)) GROUP BY key, term""")
def learned_expansion(t: Tables):
    """Each item's terms and what stands next to them in all documents."""
    q = t.benchmark.select(F.col("item_id").alias("key"), "text")
    terms = q.select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return S.expand(q, S.partners(t.documents, terms))
