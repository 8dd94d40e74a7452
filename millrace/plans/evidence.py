"""Queries: path classes, admission, claims, sufficiency, verification, gates over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import claims as claim_operators
from millrace.operators import evidence as E
from millrace.operators import mentions as mention_operators
from millrace.plans.text import _TOK
from millrace.registry import Registry, Tables

registry = Registry()

#: Folders and files that stand for a source tree, by page id.
_TREE = ["src/main.go", "vendor/lib/a.go", "docs/guide", "web/app.min.js", "pkg/a_test.py", "tests/data/x.json", "internal/generated/x.go", "fixtures/case.yaml", "build/out.bin", ".cache/k", "README.md", "cmd/tool", "dist/x.js", "lib/mocks/m.ts", "a/b/c.rs"]
_PATH = "'p' || page_id || '/' || list_extract([" + ", ".join(f"'{x}'" for x in _TREE) + f"], (page_id % {len(_TREE)} + 1)::INTEGER)"


def _paths(t: Tables):
    name = F.element_at(F.array(*[F.lit(x) for x in _TREE]), (F.col("page_id") % len(_TREE) + 1).cast("int"))
    return t.pages.select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("/"), name).alias("path"))


def _any(names) -> str:
    return "len(list_intersect(string_split(lower(path), '/'), [" + ", ".join(f"'{x}'" for x in names) + "])) > 0"


_EXT = r"regexp_extract(lower(path), '\.([^./]+)$', 1)"


def _in(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


_CLASS = rf"""
WITH f AS (SELECT page_id, {_PATH} AS path FROM pages),
c AS (SELECT page_id, path, CASE WHEN {_any((".agents",))} THEN 'agent_state' WHEN {_any(E.CACHE_DIRS)} THEN 'cache' WHEN {_any(E.VENDOR_DIRS)} THEN 'vendored'
  WHEN {_EXT} IN {_in(E.BUILD_EXTS)} OR regexp_matches(lower(path), '\.min\.(js|css)$') OR len(list_intersect(string_split(lower(path), '/')[1:len(string_split(path, '/')) - CASE WHEN {_EXT} = '' THEN 0 ELSE 1 END], [{", ".join(f"'{x}'" for x in E.BUILD_DIRS)}])) > 0 THEN 'build_artifact'
  WHEN {_any(E.GENERATED_DIRS)} THEN 'generated' WHEN {_any(E.FIXTURE_DIRS)} THEN 'fixture'
  WHEN regexp_matches(lower(path), '(^|/)test_[^/]*$|(_test\.(go|py)|\.(test|spec)\.(ts|js)|test\.java)$') OR {_any(E.TEST_DIRS)} THEN 'test'
  WHEN {_EXT} IN {_in(E.DOC_EXTS)} OR {_any(E.DOC_DIRS)} THEN 'documentation' WHEN {_EXT} IN {_in(E.SOURCE_EXTS)} THEN 'authoritative' ELSE 'unknown' END AS class FROM f)
"""


@registry.add(_CLASS + "SELECT page_id, path, class FROM c")
def classify_paths(t: Tables):
    return _paths(t).select("page_id", "path", E.classify(F.col("path")).alias("class"))


_ADMIT = (
    _CLASS
    + """, a AS (SELECT *, page_id % 9 <> 0 AS tracked FROM c), b AS (SELECT page_id, CASE WHEN NOT tracked THEN 'not tracked' WHEN class IN ('generated','vendored','build_artifact','agent_state','cache','unknown') THEN class || ' excluded' WHEN class = 'fixture' THEN 'fixture excluded' ELSE 'admitted' END AS reason,
  CASE class WHEN 'authoritative' THEN 1.0 WHEN 'test' THEN 0.9 WHEN 'documentation' THEN 0.7 ELSE 0.0 END AS auth FROM a)
"""
)


def _admitted(t: Tables):
    c = _paths(t).select("page_id", E.classify(F.col("path")).alias("class"))
    return c.select("page_id", "class", E.admit(F.col("class"), F.col("page_id") % 9 != 0).alias("a")).select("page_id", "class", "a.*")


@registry.add(_ADMIT + "SELECT page_id, reason = 'admitted' AS eligible, (CASE WHEN reason = 'admitted' THEN auth ELSE 0 END)::DOUBLE AS authority, reason FROM b")
def admission(t: Tables):
    return _admitted(t).select("page_id", "eligible", "authority", "reason")


@registry.add(_ADMIT + "SELECT reason, count(*) AS n FROM b GROUP BY reason")
def admission_audit(t: Tables):
    return _admitted(t).groupBy("reason").agg(F.count("*").alias("n"))


@registry.add(rf"""
WITH f AS (SELECT page_id, {_PATH} AS path FROM pages), x AS (SELECT {_any(E.EXCLUDED_DIRS).replace("lower(path)", "path")} AS dir, {_EXT} IN {_in(E.EXCLUDED_EXTS)} AS ext FROM f)
SELECT count(*) AS considered, count(*) FILTER (dir OR ext) AS excluded FROM x
""")
def exclusion_telemetry(t: Tables):
    return _paths(t).agg(F.count("*").alias("considered"), F.count_if(E.is_excluded(F.col("path"))).alias("excluded"))


@registry.add("SELECT conv_id, turn, i AS n, s AS claim FROM (SELECT conv_id, turn, unnest(list_filter([trim(x) for x in regexp_split_to_array(text, '[.?!]\\s+|\\n+')], lambda x: length(x) >= 10)) AS s, generate_subscripts(list_filter([trim(x) for x in regexp_split_to_array(text, '[.?!]\\s+|\\n+')], lambda x: length(x) >= 10), 1) AS i FROM conversations)")
def claim_extraction(t: Tables):
    return E.claims(t.conversations, "text", "conv_id", "turn")


_LINE = "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, trim(unnest(string_split(text, chr(10)))) AS s FROM documents)"


@registry.add(_LINE + """ SELECT doc_id, line, CASE WHEN regexp_matches(s, '(?i)(revert(ed)?|no longer use|abandon(ed)?|deprecated)') THEN 'reversal' WHEN regexp_matches(s, '(?i)(we decided|decision:|adopt(ed)?|licensed under|use)\\s+[^.]+') THEN 'decision' WHEN regexp_matches(s, '(?i)(error|fail(ed|ure)?|panic|fatal|exception|token)\\s*[:=]\\s*[^.]+') THEN 'failure'
WHEN regexp_matches(s, '(?i)(must not|never allow|invariant:|require[ds]?)\\s*[^.]+') THEN 'constraint' END AS kind FROM l WHERE length(s) >= 5 AND kind IS NOT NULL""")
def line_extraction(t: Tables):
    """Decisions, failures, constraints and reversals told by the first pattern that fits a line."""
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.trim("s").alias("s")).where("length(s) >= 5")  # noqa: E741
    s = F.col("s")
    kind = F.when(s.rlike(r"(?i)(revert(ed)?|no longer use|abandon(ed)?|deprecated)"), "reversal").when(s.rlike(r"(?i)(we decided|decision:|adopt(ed)?|licensed under|use)\s+[^.]+"), "decision").when(s.rlike(r"(?i)(error|fail(ed|ure)?|panic|fatal|exception|token)\s*[:=]\s*[^.]+"), "failure").when(s.rlike(r"(?i)(must not|never allow|invariant:|require[ds]?)\s*[^.]+"), "constraint")
    return l.select("doc_id", "line", kind.alias("kind")).where("kind is not null")


@registry.add("WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, turn, role FROM m WHERE n <= 4")
def recent_turns(t: Tables):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.conversations.select("conv_id", "turn", "role", F.row_number().over(w).alias("n")).where("n <= 4").select("conv_id", "turn", "role")


@registry.add("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, string_agg(role, '>' ORDER BY turn) AS shape, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def conversation_compile(t: Tables):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.array_join(turns["role"], ">").alias("shape"), F.sum(F.length("text")).alias("chars"))


_VER = """
WITH c AS (SELECT item_id AS id, lower(text) AS claim FROM benchmark), e AS (SELECT doc_id AS ord, lower(text) AS body FROM documents),
w AS (SELECT id, list_filter([regexp_replace(x, '^[,.;:"''()]+|[,.;:"''()]+$', '', 'g') for x in regexp_split_to_array(claim, '\\s+')], lambda x: length(x) > 3) AS w, NEG(claim) AS neg FROM c),
p AS (SELECT id, ord, neg, NEG(body) AS eneg, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(body, x) OR (length(x) > 4 AND contains(body, x[1:length(x) - 1]))))::DOUBLE / len(w) ELSE 0 END AS o FROM w, e),
s AS (SELECT id, min(CASE WHEN neg <> eneg AND o >= 0.5 THEN ord END) AS stop FROM p WHERE o >= 0.4 GROUP BY id),
b AS (SELECT p.id, any_value(stop) AS stop, max(o) AS best FROM p JOIN s ON p.id = s.id AND (stop IS NULL OR ord <= stop) WHERE o >= 0.4 GROUP BY p.id),
v AS (SELECT w.id, CASE WHEN stop IS NOT NULL THEN 'CONTRADICTED' WHEN best >= 0.6 THEN 'SUPPORTED' WHEN best IS NOT NULL THEN 'PARTIAL' ELSE 'UNKNOWN' END AS status, round(coalesce(best, 0), 6) AS confidence FROM w LEFT JOIN b USING (id))
"""
_MARKS = [" not ", "no ", "never ", "without ", " don''t ", " doesn''t ", " cannot ", " isn''t ", " aren''t ", " won''t "]


def _neg(c: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in _MARKS) + ")"


_VER = _VER.replace("NEG(claim)", _neg("claim")).replace("NEG(body)", _neg("body"))


def _verified(t: Tables):
    return E.verify(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("claim")), t.documents.select(F.col("doc_id").alias("ord"), F.col("text").alias("body")))


@registry.add(_VER + "SELECT id, status, confidence FROM v")
def claim_verification(t: Tables):
    return _verified(t).select("id", "status", F.round("confidence", 6).alias("confidence"))


@registry.add(_VER + "SELECT count(*) AS total, round(avg((status = 'SUPPORTED')::INT), 6) AS precision, round(avg((status IN ('UNKNOWN', 'PARTIAL'))::INT), 6) AS unsupported, round(avg((status = 'CONTRADICTED')::INT), 6) AS contradiction FROM v")
def claim_rates(t: Tables):
    r = lambda *s: F.round(F.avg(F.col("status").isin(*s).cast("int")), 6)
    return _verified(t).agg(F.count("*").alias("total"), r("SUPPORTED").alias("precision"), r("UNKNOWN", "PARTIAL").alias("unsupported"), r("CONTRADICTED").alias("contradiction"))


@registry.add("""
WITH r AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) > 3))) AS w FROM benchmark),
d AS (SELECT DISTINCT unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) > 3)) AS w FROM documents),
c AS (SELECT item_id, count(*) AS n, count(d.w) AS hit FROM r LEFT JOIN d USING (w) GROUP BY item_id)
SELECT item_id, n, hit, round(hit::DOUBLE / n, 6) AS coverage, hit::DOUBLE / n >= 0.5 AS sufficient FROM c
""")
def evidence_sufficiency(t: Tables):
    tok = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", " "), " "), lambda x: F.length(x) > 3))
    r = t.benchmark.select("item_id", F.explode(tok("text")).alias("w"))
    d = t.documents.select(F.explode(tok("text")).alias("w")).distinct().withColumn("there", F.lit(1))
    c = r.join(d, "w", "left").groupBy("item_id").agg(F.count("*").alias("n"), F.count("there").alias("hit"))
    return c.select("item_id", "n", "hit", F.round(F.col("hit") / F.col("n"), 6).alias("coverage"), (F.col("hit") / F.col("n") >= 0.5).alias("sufficient"))


@registry.add("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, len(string_split(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/')) - 1 AS depth, list_filter(regexp_extract_all(url, '[?&]([^=&#]+)=', 1), lambda x: true) AS params FROM pages")
def url_parts(t: Tables):
    u = F.col("url")
    return t.pages.select("page_id", F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"), (F.size(F.split(F.regexp_extract(u, "://[^/?#]+([^?#]*)", 1), "/")) - 1).cast("long").alias("depth"), F.regexp_extract_all(u, F.lit("[?&]([^=&#]+)="), F.lit(1)).alias("params"))


@registry.add("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.session'), ''), json_extract_string(props, '$.k')) AS key, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'observation' END AS kind FROM events")
def normalise_events(t: Tables):
    from millrace.streaming.ingest import normalise

    e = normalise(t.events, "props", {"key": ["session", "k"]})
    return e.select("event_id", "key", F.when(F.col("event_type") == "error", "failure").otherwise("observation").alias("kind"))


_ROUNDS = 8  # of the statement below: chains of claims that turn on each other are shorter in these tables


def _resolved() -> str:
    """CTEs k0.. of decided claims (id, kept): each round decides those whose earlier ones tell."""
    out = "k0 AS MATERIALIZED (SELECT DISTINCT a AS id, true AS kept FROM pr WHERE a NOT IN (SELECT b FROM pr))"
    for r in range(1, _ROUNDS):
        out += f""", k{r} AS MATERIALIZED (SELECT * FROM k{r - 1} UNION ALL SELECT b, NOT coalesce(bool_or(kept), false) FROM pr LEFT JOIN k{r - 1} ON id = a WHERE b NOT IN (SELECT id FROM k{r - 1}) GROUP BY b HAVING coalesce(bool_or(kept), false) OR count(kept) = count(*))"""
    return out


@registry.add(f"""
WITH c AS (SELECT coalesce(lang, '') AS scope, doc_id AS ord, source, n_chars, list_sort(list_distinct({_TOK})) AS w, lower(coalesce(text, '')) AS low FROM documents),
f AS MATERIALIZED (SELECT *, min(ord) OVER (PARTITION BY scope, CASE WHEN len(w) > 0 THEN 'w ' || array_to_string(w, ' ') ELSE 't ' || low END) AS first FROM c),
x AS MATERIALIZED (SELECT scope, ord, len(w) AS n, unnest(w) AS word FROM f WHERE first = ord),
pr AS MATERIALIZED (SELECT a.ord AS a, b.ord AS b FROM x a JOIN x b ON a.scope = b.scope AND a.word = b.word AND a.ord < b.ord GROUP BY a.ord, b.ord HAVING count(*)::DOUBLE / max(a.n) > 0.85),
{_resolved()},
kp AS (SELECT b, min(a) AS keeper FROM pr JOIN k{_ROUNDS - 1} ON id = a AND kept GROUP BY b)
SELECT scope, coalesce(keeper, first) AS ord, count(*) AS claims, count(DISTINCT source) AS evidence, max(n_chars) AS confidence FROM f LEFT JOIN kp ON b = first GROUP BY ALL
""")
def merged_claims(t: Tables):
    """Documents as claims of their language, in order of their ids: those that an earlier one already makes join it."""
    d = t.documents.select(F.col("lang").alias("scope"), F.col("doc_id").alias("ord"), F.col("text").alias("claim"), F.col("source").alias("evidence"), F.col("n_chars").alias("confidence"))
    return claim_operators.merge(d)


_WORDS_OF = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)"


@registry.add(f"""
WITH n AS (SELECT item_id, ' ' || array_to_string({_WORDS_OF.format(c='text')}[1:4], ' ') || ' ' AS name, len({_WORDS_OF.format(c='text')}[1:4]) AS size FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string({_WORDS_OF.format(c='text')}, ' ') || ' ' AS said, {_WORDS_OF.format(c='text')} AS w FROM documents),
h AS (SELECT * FROM d JOIN n ON size > 0 AND contains(said, name))
SELECT doc_id, item_id, len(list_filter(range(1, len(w) + 1), lambda i: ' ' || array_to_string(w[i:i + size - 1], ' ') || ' ' = name)) AS times FROM h
""")
def name_mentions(t: Tables):
    """Which documents hold the first four words of which items, as whole words in a row."""
    names = t.benchmark.select(F.col("item_id").alias("id"), F.array_join(F.slice(T.all_tokens(F.col("text")), 1, 4), " ").alias("name"))
    got = mention_operators.mentions(t.documents.select(F.col("doc_id").alias("id"), "text"), names, drop_own=False)
    return got.select(F.col("text_id").alias("doc_id"), F.col("name_id").alias("item_id"), "times")
