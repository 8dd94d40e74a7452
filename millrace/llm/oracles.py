"""DuckDB statements for the queries of this subpackage that SQL can express."""

from millrace.llm.secrets import KINDS

OP2 = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_FOUND = r"""
  SELECT rid, {no} AS kind, '{kind}' AS name, {least} AS least, unnest(generate_series(1, len(m))) AS i, m, v, g
  FROM (SELECT rid, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))
"""

OP1 = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS owner, coalesce(lang, chr(0)) AS repo, coalesce(text, '') AS t FROM documents),
f AS ("""
    + " UNION ALL ".join(_FOUND.format(no=i, kind=k, least=least, group=group, p="'" + p.replace("'", "''") + "'") for i, (k, p, group, least) in enumerate(KINDS))
    + r"""),
s AS (
  SELECT rid, kind, name, least, v[i] AS v, (list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS "start", length(m[i]) AS n
  FROM f),
ok AS (
  SELECT rid, kind, name, sha256(v) AS hash, "start", ("start" + n)::BIGINT AS "end"
  FROM s WHERE length(v) >= least AND (kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))),
alone AS (SELECT * FROM ok a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM ok b WHERE b.rid = a.rid AND b.kind < 3 AND b."start" < a."end" AND b."end" > a."start")),
own AS (SELECT hash, count(DISTINCT owner) AS n_owners FROM alone JOIN d USING (rid) GROUP BY hash),
k AS (SELECT *, n_owners <= 2 AS live FROM alone JOIN own USING (hash) WHERE kind < 3 OR n_owners <= 2),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || "start" || ':' || "end", ',' ORDER BY "start", kind) FILTER (kind < 3) AS b,
    string_agg(name || ':' || "start" || ':' || "end", ',' ORDER BY "start", kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
  FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (rid)
"""
)


_REACH = """
r AS (SELECT rid, rid AS other FROM {rows} UNION SELECT r.rid, l.y FROM r JOIN l ON l.x = r.other)
"""

OP5 = (
    """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings),
n AS MATERIALIZED (SELECT rid, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE fine),
l AS MATERIALIZED (SELECT a.rid AS x, b.rid AS y FROM n a JOIN n b ON a.label = b.label AND a.d = b.d AND a.rid <> b.rid WHERE list_inner_product(a.e, b.e) >= 0.93),"""
    + _REACH.format(rows="v")
    + """, c AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.other GROUP BY r.rid), k AS (SELECT x AS rid, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN k USING (rid)
"""
)

OP6 = (
    r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g, least(5, len(w)) AS m FROM (SELECT rid, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
l AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.m = b.m AND a.rid <> b.rid GROUP BY a.rid, b.rid) p
  JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),"""
    + _REACH.format(rows="d")
    + """, c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
)


_ASSIGN = """
d{r} AS MATERIALIZED (SELECT rid, x.part, x, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) * 256 + e)::BIGINT AS m FROM x JOIN c{r} c USING (part) GROUP BY rid, x.part, x),
"""
_UPDATE = """
s{r} AS (SELECT part, e, list(s ORDER BY pos) AS m FROM (
  SELECT part, m % 256 AS e, pos, floor(sum(x[pos]) / count(*)) AS s FROM d{r}, range(1, len(x) + 1) t(pos) GROUP BY ALL) GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT c.part, c.e, coalesce(m, c) AS c FROM c{r} c LEFT JOIN s{r} USING (part, e)),
"""

#: For vectors of one length that four divides.
OP11 = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM v, range(4) t(part)),
c0 AS (SELECT part, rid - 1 AS e, x AS c FROM x WHERE rid <= 256),"""
    + "".join(_ASSIGN.format(r=r) + _UPDATE.format(r=r, n=r + 1) for r in range(4))
    + _ASSIGN.format(r=4)
    + """
k AS (SELECT rid, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM d4 GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, e)) AS h FROM c4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN k USING (rid), b
"""
)


def _crc_table() -> list[int]:
    """The table of the checksum by its rule: eight steps of the reflected polynomial 0xEDB88320 for each byte."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP12 = (
    """
WITH RECURSIVE t AS (SELECT """
    + str(_crc_table())
    + """::BIGINT[] AS crc),
r AS (
  SELECT id, run, count(*) AS c FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
y AS (SELECT run, c, flatten(list_transform(string_split(id || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [(192 + unicode(ch) // 64)::BIGINT, (128 + unicode(ch) % 64)::BIGINT] END)) AS bytes FROM r),
h AS (SELECT run, c, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM y, t),
n AS MATERIALIZED (
  SELECT w AS word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS w FROM h)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
g AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, n.word, n.n FROM g JOIN n ON n.word = g.rest
  UNION SELECT n.word, g.word, g.n FROM g JOIN n ON n.word = g.rest),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT n.word, n.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * n.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 2 * n.n THEN (SELECT min(other) FROM p WHERE p.word = n.word AND p.m = b.m) END AS form
  FROM n LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM w GROUP BY word) USING (word)
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": OP1, "op2_decontaminate": OP2, "op5_embeddings": OP5, "op6_jaccard": OP6, "op11_codes": OP11, "op12_spelling": OP12}
