"""Queries: text functions, corpus statistics, lexical scoring and fusion over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ranking as R
from millrace.registry import Registry, Tables
from millrace.sources.work import spread

registry = Registry()

QUERY = "The Licensed under version, thation ering onedas the nter"
TERMS = ["the", "licensed", "under", "version", "thation", "ering", "onedas", "nter"]
_LIST = "['the','licensed','under','version','thation','ering','onedas','nter']"
_TOK = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)"
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')"

_BM25 = f"""
WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents),
stats AS (SELECT count(*) AS n, sum(len(t))::DOUBLE / count(*) AS avg_len FROM t),
hits AS (SELECT doc_id, len(t)::DOUBLE AS dlen, term, count(*)::DOUBLE AS tf
         FROM (SELECT doc_id, t, unnest(list_filter(t, lambda x: list_contains({_LIST}, x))) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * FORMULA) AS score FROM hits JOIN df USING (term), stats GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 20
"""
_TF = "(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (dlen / avg_len))))"
_C = "(tf / (0.25 + 0.75 * (dlen / avg_len)) + CASE WHEN dlen > avg_len THEN 0.5 ELSE 0 END)"


def _bm25(t: Tables, formula):
    s = R.lexical_scores(t.documents, "doc_id", "text", TERMS, formula)
    return R.top_k(s.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), "score", "doc_id", 20)


@registry.add(_BM25.replace("FORMULA", _TF))
def bm25_topk(t: Tables):
    return _bm25(t, R.bm25)


@registry.add(_BM25.replace("FORMULA", f"({_TF} + 1.0)"))
def bm25_plus_topk(t: Tables):
    return _bm25(t, R.bm25_plus)


@registry.add(_BM25.replace("FORMULA", f"({_C} * 2.5 / ({_C} + 1.5))"))
def bm25l_topk(t: Tables):
    return _bm25(t, R.bm25_l)


@registry.add(f"""
WITH t AS (SELECT doc_id, list_distinct({_TOK}) AS t, greatest(1, CASE WHEN len({_WORDS}) = 0 THEN 1 ELSE floor(len({_WORDS}) * 1.3 + 0.999) END) AS est FROM documents),
a AS (SELECT sum(est) / count(*) AS avg_len FROM t)
SELECT doc_id, round(least(1.0, len(list_intersect(t, {_LIST})) * (2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / avg_len))) / ({len(TERMS)} * (2.5 / 2.5))), 6) AS score
FROM t, a WHERE len(t) > 0
""")
def bm25_corpus_free(t: Tables):
    d = t.documents.select("doc_id", T.tokens(F.col("text")).alias("t"), T.estimate_tokens(F.col("text")).alias("est"))
    avg = d.agg((F.sum("est") / F.count("*")).alias("avg_len"))
    q = F.array(*[F.lit(x) for x in TERMS])
    k = 1.5 * (0.25 + 0.75 * F.size("t") / F.col("avg_len"))
    s = F.size(F.array_intersect("t", q)) * (2.5 / (1 + k)) / (len(TERMS) * 1.0)
    return d.where(F.size("t") > 0).crossJoin(F.broadcast(avg)).select("doc_id", F.round(F.least(F.lit(1.0), s), 6).alias("score"))


@registry.add(f"SELECT count(*) AS doc_count, sum(len({_TOK}))::BIGINT AS total_len, round(sum(len({_TOK}))::DOUBLE / count(*), 6) AS avg_len FROM documents")
def corpus_statistics(t: Tables):
    return R.corpus_stats(t.documents, "text").select("doc_count", "total_len", F.round("avg_len", 6).alias("avg_len"))


@registry.add(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
def document_frequency(t: Tables):
    return R.term_counts(t.documents, "text")


@registry.add(f"""
WITH p AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM p, n
""")
def inverse_document_frequency(t: Tables):
    df = R.term_counts(t.documents, "text").drop("cf")
    n = t.documents.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@registry.add(f"""
WITH q AS (SELECT unnest({_LIST}) AS term), n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term)
SELECT round(sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) * 2.5), 6) AS max_score FROM q LEFT JOIN p USING (term), n
""")
def max_query_score(t: Tables):
    q = t.literal([(x,) for x in TERMS], "term string")
    _, _, df = R.term_hits(t.documents, "doc_id", "text", TERMS)
    n = t.documents.agg(F.count("*").alias("n"))
    rows = q.join(df, "term", "left").crossJoin(F.broadcast(n))
    return rows.agg(F.round(F.sum(R.idf(F.col("n"), F.coalesce("df", F.lit(0))) * 2.5), 6).alias("max_score"))


@registry.add(f"SELECT doc_id, CASE WHEN len({_WORDS}) = 0 THEN 1 ELSE floor(len({_WORDS}) * 1.3 + 0.999) END::BIGINT AS est FROM documents")
def token_estimate(t: Tables):
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("est"))


@registry.add(f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def token_counts(t: Tables):
    return t.documents.select("doc_id", F.size(T.all_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_distinct"))


@registry.add(f"""
WITH d AS (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents),
b AS (SELECT item_id, list_distinct({_TOK}) AS t FROM benchmark), bt AS (SELECT item_id, len(t) AS n, unnest(t) AS term FROM b),
s AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS o FROM bt JOIN d USING (term) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(o, 6) AS overlap FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY o DESC, doc_id) <= 3
""")
def overlap_neardup(t: Tables):
    """Three documents of the largest overlap for each item: an equi-join on distinct tokens, not a product of all pairs."""
    d = t.documents.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    b = t.benchmark.select("item_id", T.tokens(F.col("text")).alias("t")).select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    s = b.join(d, "term").groupBy("item_id", "doc_id", "n").agg((F.count("*") / F.col("n")).alias("o"))
    w = Window.partitionBy("item_id").orderBy(F.desc("o"), "doc_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 3").select("item_id", "doc_id", F.round("o", 6).alias("overlap"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, [ascii(x)::BIGINT for x in string_split(term, '')]), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@registry.add(f"""
WITH b AS (SELECT DISTINCT unnest({_TOK}) AS term FROM benchmark) SELECT term, {_FNV} AS fnv, {_FNV} % 128 AS bucket FROM b
""")
def fnv_hash(t: Tables):
    b = t.benchmark.select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    return b.select("term", T.fnv1a(F.col("term")).alias("fnv"), (T.fnv1a(F.col("term")) % 128).alias("bucket"))


_PARTS = """
{0}parts AS (
  SELECT {1}, term, 1.0 AS w FROM {0}tok UNION ALL
  SELECT {1}, substr(term, i::INTEGER, 3), 0.35 FROM (SELECT {1}, term, unnest(generate_series(1, length(term) - 2)) AS i FROM {0}tok WHERE length(term) >= 3)),
{0}v AS (SELECT {1}, {2} % 128 AS bucket, sum(w) AS v FROM {0}parts GROUP BY ALL)
"""


@registry.add(f"""
WITH dtok AS (SELECT item_id AS id, unnest(list_distinct({_TOK})) AS term FROM benchmark), qtok AS (SELECT 0 AS q, unnest({_LIST}) AS term),
{_PARTS.format("d", "id", _FNV)}, {_PARTS.format("q", "q", _FNV)},
n AS (SELECT id, sqrt(sum(v * v)) AS n FROM dv GROUP BY id), qn AS (SELECT sqrt(sum(v * v)) AS qn FROM qv)
SELECT id AS item_id, round(sum(dv.v * qv.v) / any_value(n * qn), 6) AS similarity FROM dv JOIN qv USING (bucket) JOIN n USING (id), qn GROUP BY id
""")
def feature_hash_similarity(t: Tables):
    def vector(tok, key):
        tri = tok.where(F.length("term") >= 3).select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - 2), lambda i: F.substring("term", i, F.lit(3)))).alias("term"), F.lit(0.35).alias("w"))
        parts = tok.select(key, "term", F.lit(1.0).alias("w")).unionByName(tri)
        return parts.groupBy(key, (T.fnv1a(F.col("term")) % 128).alias("bucket")).agg(F.sum("w").alias("v"))

    d = vector(t.benchmark.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")), "item_id")
    q = vector(t.literal([(0, x) for x in TERMS], "q int, term string"), "q").select("bucket", F.col("v").alias("qv"))  # at most 128 rows
    qn = q.agg(F.sqrt(F.sum(F.col("qv") * F.col("qv"))).alias("qn"))
    s = d.join(F.broadcast(q), "bucket", "left").groupBy("item_id").agg(F.sum(F.col("v") * F.col("qv")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return s.where("dot is not null").crossJoin(F.broadcast(qn)).select("item_id", F.round(F.col("dot") / (F.col("n") * F.col("qn")), 6).alias("similarity"))


@registry.add("""
WITH p AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id = 0)
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) AS cosine FROM embeddings e, p
ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 5) DESC, e.vec_id LIMIT 20
""")
def cosine_topk(t: Tables):
    p = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    s = t.embeddings.crossJoin(F.broadcast(p)).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))
    return R.top_k(s, "cosine", "vec_id", 20)


@registry.add("""
SELECT label, i, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM (SELECT label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings) GROUP BY label, i
""")
def label_centroid(t: Tables):
    return t.embeddings.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@registry.add("""
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id < 4), d AS (SELECT label, vec_id, embedding::DOUBLE[] AS b FROM embeddings),
m AS (SELECT label, q, greatest(0, max(list_cosine_similarity(a, b))) AS best FROM d, q GROUP BY label, q)
SELECT label, round(sum(best), 4) AS max_sim FROM m GROUP BY label
""")
def late_interaction(t: Tables):
    """MaxSim of a query of four vectors against the vectors of each label."""
    q = t.embeddings.where("vec_id < 4").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"))  # four rows
    s = t.embeddings.crossJoin(F.broadcast(q)).groupBy("label", "q").agg(F.greatest(F.lit(0.0), F.max(T.cosine(F.col("embedding"), F.col("a")))).alias("best"))
    return s.groupBy("label").agg(F.round(F.sum("best"), 4).alias("max_sim"))


@registry.add("""
SELECT item_id, substr(sha256(concat_ws('|', 'v3', item_id::VARCHAR, text)), 1, 20) AS id FROM benchmark
""")
def content_hash_id(t: Tables):
    return t.benchmark.select("item_id", T.content_id(F.lit("v3"), F.col("item_id").cast("string"), F.col("text")).alias("id"))


@registry.add("""
SELECT source, sha256(string_agg(h, chr(10) ORDER BY h)) AS dir_hash, count(*) AS files FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source
""")
def directory_fingerprint(t: Tables):
    """A folder's hash is that of its children's sorted hashes."""
    h = t.documents.select("source", F.sha2("text", 256).alias("h"))
    return h.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("dir_hash"), F.count("*").alias("files"))


@registry.add("""
WITH f AS (SELECT lang, source, sha256(text) AS h FROM documents), d AS (SELECT lang, source, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM f GROUP BY ALL),
l AS (SELECT lang, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM d GROUP BY lang)
SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS root FROM l
""")
def merkle_root(t: Tables):
    up = lambda df, *k: df.groupBy(*k).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    leaf = t.documents.select("lang", "source", F.sha2("text", 256).alias("h"))
    return up(up(up(leaf, "lang", "source"), "lang")).select(F.col("h").alias("root"))


@registry.add(f"""
WITH p AS (SELECT DISTINCT term, doc_id FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) WHERE list_contains({_LIST}, term))
SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM p
""")
def posting_gaps(t: Tables):
    p = t.documents.select("doc_id", F.explode(F.filter(T.tokens(F.col("text")), lambda x: x.isin(TERMS))).alias("term"))
    return p.select("term", "doc_id", (F.col("doc_id") - F.coalesce(F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id")), F.lit(0))).alias("gap"))


_RUN = "list_filter(regexp_split_to_array(token, '[^A-Za-z0-9_]+'), lambda r: {0})"
_CAPS = "(length(r) - length(regexp_replace(r, '[A-Z]', '', 'g')))"
_HEAD = "substr(r, 1, 1)"
_WORD_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"


@registry.add(f"""
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(html, '[^A-Za-z0-9_.-]+')) AS token FROM pages),
c AS (SELECT token, CASE WHEN lower(token) IN {_WORD_IN(T.STOP_WORDS)} THEN 'STOPWORD'
  WHEN contains(token, '/') OR regexp_extract(lower(token), '[a-z0-9_.-]\\.([a-z]+)$', 1) IN {_WORD_IN(T.FILE_ENDINGS)} THEN 'PATH/FILENAME'
  WHEN len(list_filter(string_split(token, '-'), lambda c: regexp_matches(c, '(^|[^A-Za-z0-9_])[A-Za-z_]\\w*\\.[A-Za-z_]'))) > 0 THEN 'SYMBOL'
  WHEN len({_RUN.format(f"NOT contains(r, '_') AND {_HEAD} BETWEEN 'a' AND 'z' AND {_CAPS} > 0")}) > 0 THEN 'SYMBOL'
  WHEN len({_RUN.format(f"NOT contains(r, '_') AND {_HEAD} BETWEEN 'A' AND 'Z' AND {_CAPS} > 1 AND NOT regexp_matches(r, '[A-Z]([A-Z]|$)')")}) > 0 THEN 'SYMBOL'
  WHEN len({_RUN.format(f"({_HEAD} BETWEEN 'a' AND 'z' OR {_HEAD} BETWEEN 'A' AND 'Z' OR {_HEAD} = '_') AND regexp_matches(r, '[0-9]')")}) > 0 THEN 'SYMBOL'
  WHEN substr(token, 1, 1) BETWEEN 'A' AND 'Z' AND lower(token) NOT IN {_WORD_IN(T.GENERIC)} AND lower(token) NOT IN {_WORD_IN(T.ACTIONS)} THEN 'SYMBOL'
  WHEN len({_RUN.format("regexp_matches(r, '^[A-Z]{2,6}$')")}) > 0 AND token NOT IN ('AND', 'THE', 'FOR', 'NOT') THEN 'ENTITY'
  WHEN contains(token, '_') OR contains(token, '-') THEN 'IDENTIFIER' WHEN lower(token) IN {_WORD_IN(T.ACTIONS)} THEN 'ACTION' WHEN lower(token) IN {_WORD_IN(T.GENERIC)} THEN 'GENERIC' ELSE 'TECHNICAL_TERM' END AS token_class
FROM w WHERE length(token) >= 2)
SELECT token, token_class, list_position({list(T.TOKEN_CLASSES)}, token_class)::BIGINT AS priority FROM c
""")
def token_class(t: Tables):
    """Class and priority of every distinct token of the pages."""
    w = t.pages.select(F.explode(F.split("html", "[^A-Za-z0-9_.-]+")).alias("token")).distinct().where(F.length("token") >= 2)
    return w.withColumn("token_class", T.token_class(F.col("token"))).withColumn("priority", T.token_priority(F.col("token_class")))


@registry.add("""
SELECT c.c_custkey, list_filter(string_split(lower(regexp_replace(regexp_replace(c_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_/.:#-]+', ' ', 'g')), ' '), lambda x: x <> '') AS parts FROM customer c
""".replace("\\\\", "\\"))
def normalize_identifier(t: Tables):
    s = F.regexp_replace(F.regexp_replace("c_name", "([a-z])([A-Z])", "$1 $2"), "[_/.:#-]+", " ")
    return t.customer.select("c_custkey", F.filter(F.split(F.lower(s), " "), lambda x: x != "").alias("parts"))


_TRI = "[substr(lower(trim(p_name)), i::INTEGER, 3) for i in generate_series(1, length(trim(p_name)) - 2)]"


@registry.add("""
WITH q AS (SELECT ['red', 'wid', 'idg', 'dge', 'get'] AS q), p AS (SELECT p_partkey, list_filter([instr(lower(trim(p_name)), x) for x in q], lambda y: y > 0) AS p FROM part, q)
SELECT p_partkey, len(p) AS matched, round(0.6 * len(p) / 5 + CASE WHEN len(p) > 1 THEN 0.25 * list_sum([CASE WHEN p[i + 1] - p[i] BETWEEN 1 AND 5 THEN 1.0::DOUBLE / (p[i + 1] - p[i]) ELSE 0 END for i in generate_series(1, len(p) - 1)]) / (len(p) - 1) ELSE 0 END + 0.15, 6)::DOUBLE AS score FROM p WHERE len(p) > 0
""")
def trigram_match(t: Tables):
    """0.60 coverage of the query's trigrams, 0.25 proximity of those that follow each other within five places, 0.15."""
    q = F.array(*[F.lit(x) for x in ("red", "wid", "idg", "dge", "get")])
    return t.part.select("p_partkey", T.trigram_score(F.col("p_name"), q).alias("x")).select("p_partkey", "x.*").where("matched > 0")


@registry.add(f"""
WITH d AS (SELECT doc_id, lang, {_TOK} AS t FROM documents), p AS (SELECT lang, doc_id, list_distinct(t) AS t FROM d),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) AS m FROM p a JOIN p b ON a.lang = b.lang AND a.doc_id < b.doc_id WHERE len(a.t) > 0 AND len(b.t) > 0 AND 4 * least(len(a.t), len(b.t)) >= 3 * greatest(len(a.t), len(b.t)))
SELECT a, b, round(i::DOUBLE / (m - i), 6) AS jaccard FROM j WHERE 4 * i >= 3 * (m - i)
""")
def set_jaccard(t: Tables):
    """Pairs of documents of a language that decide alike: a Jaccard of their tokens of 0.75 or more."""
    return R.similar_sets(t.documents.select("lang", "doc_id", T.tokens(F.col("text")).alias("t")), "lang", "doc_id", "t", 75).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_FUSE = f"""
WITH t AS (SELECT doc_id, len({_TOK}) AS dlen, len(list_intersect(list_distinct({_TOK}), {_LIST})) AS hit, n_chars FROM documents),
s AS (SELECT doc_id, hit::DOUBLE / {len(TERMS)} AS lexical, 1.0 / (1 + abs(dlen - 400)) AS semantic, (doc_id % 10) / 10::DOUBLE AS affinity FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY lexical DESC, doc_id) AS lr, row_number() OVER (ORDER BY semantic DESC, doc_id) AS sr, row_number() OVER (ORDER BY affinity DESC, doc_id) AS ar FROM s)
"""


def _signals(t: Tables):
    d = spread(t.documents.select("doc_id", "text")).select("doc_id", F.size(T.all_tokens(F.col("text"))).alias("dlen"), F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*[F.lit(x) for x in TERMS]))).alias("hit"))
    s = d.select("doc_id", (F.col("hit") / F.lit(float(len(TERMS)))).alias("lexical"), (1.0 / (1 + F.abs(F.col("dlen") - 400))).alias("semantic"), ((F.col("doc_id") % 10) / F.lit(10.0)).alias("affinity"))
    return R.ranks(s, "doc_id", "lexical", "semantic", "affinity")


@registry.add(_FUSE + "SELECT doc_id, lr AS lexical_rank, sr AS semantic_rank, ar AS affinity_rank, round(1.0/(60+lr) + 1.0/(60+sr) + 1.0/(60+ar), 9) AS rrf FROM r")
def rrf_fusion(t: Tables):
    r = _signals(t)
    return r.select("doc_id", *[F.col(f"{c}_rank").cast("long").alias(f"{c}_rank") for c in ("lexical", "semantic", "affinity")], F.round(R.rrf(F.col("semantic_rank"), F.col("lexical_rank"), F.col("affinity_rank")), 9).alias("rrf"))


@registry.add(_FUSE + "SELECT doc_id, round(CASE WHEN lexical > 0 THEN 1.0/(60+lr) ELSE 0 END + CASE WHEN affinity > 0 THEN 0.5/(60+ar) ELSE 0 END + CASE WHEN semantic > 0 THEN 2.0/(60+sr) ELSE 0 END, 9) AS fused FROM r")
def weighted_rrf(t: Tables):
    r = _signals(t)
    return r.select("doc_id", F.round(R.weighted_rrf([(F.col("lexical"), F.col("lexical_rank"), 1.0), (F.col("affinity"), F.col("affinity_rank"), 0.5), (F.col("semantic"), F.col("semantic_rank"), 2.0)]), 9).alias("fused"))


@registry.add("""
WITH p AS (SELECT term, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM (SELECT doc_id, unnest(list_distinct(list_filter(TOK, lambda x: list_contains(LIST, x)))) AS term FROM documents)),
b AS (SELECT term, gap, CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 ELSE 4 END AS n FROM p)
SELECT term, gap, n AS n_bytes, upper(array_to_string([printf('%02x', ((gap >> (7 * i)) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END) for i in generate_series(0, n - 1)], '')) AS varint FROM b
""".replace("TOK", _TOK).replace("LIST", _LIST))
def varint_gaps(t: Tables):
    """Gaps of the document ids of each term's postings as bytes of seven bits, the lowest first."""
    p = t.documents.select("doc_id", F.explode(F.filter(T.tokens(F.col("text")), lambda x: x.isin(TERMS))).alias("term"))
    gap = (F.col("doc_id") - F.coalesce(F.lag("doc_id").over(Window.partitionBy("term").orderBy("doc_id")), F.lit(0))).alias("gap")
    return p.select("term", gap).select("term", "gap", (F.length(T.varint(F.col("gap"))) / 2).cast("int").alias("n_bytes"), T.varint(F.col("gap")).alias("varint"))


_CAND = """
WITH c AS (SELECT source AS path, CASE doc_id % 5 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' WHEN 2 THEN 'symbol' WHEN 3 THEN 'path' ELSE 'graph' END AS channel, round(n_chars % 97 / 97.0, 6)::DOUBLE AS score, doc_id % 4 AS tier FROM documents)
"""


def _cands(t: Tables):
    ch = F.element_at(F.array(*[F.lit(x) for x in ("lexical", "semantic", "symbol", "path", "graph")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select(F.col("source").alias("path"), ch.alias("channel"), F.round((F.col("n_chars") % 97) / F.lit(97.0), 6).alias("score"), (F.col("doc_id") % 4).alias("tier"))


@registry.add(_CAND + "SELECT path, max(score) AS score, array_to_string(list_sort(list_distinct(list(channel))), ',') AS provenance, count(*) - 1 AS duplicates FROM c GROUP BY path")
def canonical_dedup(t: Tables):
    return R.deduplicate(_cands(t), ["path"], "score", "channel").select("path", "score", F.array_join("channel", ",").alias("provenance"), "duplicates")


@registry.add(_CAND + "SELECT count(*) AS n, count(DISTINCT path) AS kept, round((count(*) - count(DISTINCT path)) / count(*)::DOUBLE, 6) AS amplification FROM c")
def duplicate_amplification(t: Tables):
    return _cands(t).groupBy("path").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("kept")).select("n", "kept", F.round((F.col("n") - F.col("kept")) / F.col("n"), 6).alias("amplification"))


@registry.add(_CAND + "SELECT path, min(tier) AS tier, arg_max(score, (-tier, score)) AS score FROM c GROUP BY path")
def tiered_merge(t: Tables):
    return R.merge_tiers(_cands(t), ["path"], "tier", "score")


_MAXES = ", ".join(f"coalesce(max(score) FILTER (channel = '{c}'), 0) AS {c}" for c in ("lexical", "semantic", "symbol", "path", "graph")).replace(" AS path", " AS pathc")


@registry.add(_CAND + f", m AS (SELECT path, {_MAXES}, max((channel IN ('symbol', 'path'))::INT) AS e FROM c GROUP BY path) SELECT path, round(0.2*lexical + 0.2*semantic + 0.2*symbol + 0.2*pathc + 0.05*graph + 0.5*e, 6) AS fused FROM m")
def multi_channel_fusion(t: Tables):
    w = {"lexical": 0.20, "semantic": 0.20, "symbol": 0.20, "path": 0.20, "graph": 0.05}
    return R.fuse_channels(_cands(t), "path", "channel", "score", w, bonus=("symbol", "path")).select("path", F.round("fused", 6).alias("fused"))


@registry.add(_CAND + f", m AS (SELECT path, {_MAXES} FROM c GROUP BY path) SELECT path, round(1.0*symbol + 0.6*lexical + 0.4*semantic + 0.3*graph + 0.1*pathc, 6) AS fused FROM m")
def channel_fusion(t: Tables):
    return R.fuse_channels(_cands(t), "path", "channel", "score", {"symbol": 1.0, "lexical": 0.6, "semantic": 0.4, "graph": 0.3, "path": 0.1}).select("path", F.round("fused", 6).alias("fused"))


@registry.add(_CAND + """, e AS (SELECT path, exp(score - greatest(0, max(score) OVER (PARTITION BY path))) AS e FROM c), p AS (SELECT path, e / sum(e) OVER (PARTITION BY path) AS p FROM e),
h AS (SELECT path, count(*) AS n, sum(CASE WHEN p > 1e-12 THEN -p * ln(p) ELSE 0 END) AS h FROM p GROUP BY path)
SELECT path, round(h, 6) AS entropy, (CASE WHEN n > 1 THEN 5 + round(20 * least(1.0, h / ln(n))) ELSE 5 END)::BIGINT AS k FROM h""")
def adaptive_k(t: Tables):
    e = R.softmax_entropy(_cands(t), "score", 1.0, ["path"])
    return e.select("path", F.round("entropy", 6).alias("entropy"), R.adaptive_k(F.col("n"), F.col("entropy"), 5, 25).alias("k"))


@registry.add(_CAND + """, r AS (SELECT path, score, row_number() OVER (PARTITION BY path ORDER BY score DESC) AS k, lead(score) OVER (PARTITION BY path ORDER BY score DESC) AS nxt, count(*) OVER (PARTITION BY path) AS n FROM c)
SELECT path, coalesce(min(CASE WHEN k > 3 AND k < n AND least(score, 1.0) >= 0.5 AND score - nxt < 0.02 THEN k END), max(n)) AS stop FROM r GROUP BY path""")
def adaptive_stop(t: Tables):
    w = Window.partitionBy("path").orderBy(F.desc("score"))
    r = _cands(t).select("path", "score", F.row_number().over(w).alias("k"), F.lead("score").over(w).alias("nxt"), F.count("*").over(Window.partitionBy("path")).alias("n"))
    ok = (F.col("k") > 3) & (F.col("k") < F.col("n")) & (F.least("score", F.lit(1.0)) >= 0.5) & (F.col("score") - F.col("nxt") < 0.02)
    return r.groupBy("path").agg(F.coalesce(F.min(F.when(ok, F.col("k"))), F.max("n")).cast("long").alias("stop"))


@registry.add("""
SELECT part.p_partkey, round(coalesce(0.1 * ln(1 + n), 0) + p_size / 50.0, 6)::DOUBLE AS boosted FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
ORDER BY round(coalesce(0.1 * ln(1 + n), 0) + p_size / 50.0, 6) DESC, p_partkey LIMIT 50
""")
def historical_boost(t: Tables):
    use = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    s = t.part.join(use, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.round(F.coalesce(0.1 * F.log1p("n"), F.lit(0.0)) + F.col("p_size") / 50.0, 6).alias("boosted"))
    return R.top_k(s, "boosted", "p_partkey", 50)
