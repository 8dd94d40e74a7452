"""Search of named rows for many queries at once: a cascade of tiers that each query leaves when it has enough, and ranked
prefix search with a fall-back. All tiers are equi-joins on keys (names, prefixes, trigrams), none compares all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.work import table

EXACT, PREFIX, PARTS, LOOSE = 16, 6, 2, 10
LEAST = 3


def query_tokens(queries: DataFrame) -> DataFrame:
    """queries: query, text. query, token, class (path, symbol, word), n (its place in its class: the longest first).

    The class says which tiers a token is looked up in: a path (with a slash) by path and base name, a symbol (with an
    underscore, a digit or an inner capital) by name and prefix, a word by prefix and part."""
    clean = F.transform(F.split(F.col("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
    each = queries.select("query", F.explode(F.array_distinct(F.filter(clean, lambda w: F.length(w) >= 2))).alias("token"))
    kind = F.when(F.col("token").contains("/"), "path").when(F.col("token").rlike("_|[0-9]|[a-z][A-Z]"), "symbol").otherwise("word")
    each = each.withColumn("class", kind)
    return each.withColumn("n", F.row_number().over(Window.partitionBy("query", "class").orderBy(F.desc(F.length("token")), "token")))


def _first(found: DataFrame, have: DataFrame | None, limit: int) -> DataFrame:
    """found: query, id, weight. The heaviest new ones of each query, up to its limit with those it has."""
    found = found.groupBy("query", "id").agg(F.max("weight").alias("weight"))
    if have is not None:
        found = found.join(have.select("query", "id"), ["query", "id"], "left_anti")
        counts = have.groupBy("query").agg(F.count("*").alias("_has"))
        found = found.join(counts, "query", "left")
    else:
        found = found.withColumn("_has", F.lit(None).cast("long"))
    w = Window.partitionBy("query").orderBy(F.desc("weight"), "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).where(F.col("_n") + F.coalesce("_has", F.lit(0)) <= limit).select("query", "id", "weight")


def _prefixes(c: Column) -> Column:
    """All prefixes of LEAST or more characters."""
    return F.when(F.length(c) >= LEAST, F.transform(F.sequence(F.lit(LEAST), F.length(c)), lambda i: F.substring(c, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def _grams(c: Column) -> Column:
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def cascade(queries: DataFrame, nodes: DataFrame, limit: int = 50, loose: int = LOOSE) -> DataFrame:
    """queries: query, text; nodes: id, name, path, text, weight. query, id, tier: up to `limit` nodes for each query.

    Tiers: 0 path or base name of a path token; 1 name equal to a symbol or word (16 of them); 2 a name, or a part of the
    path, that begins with one of six symbols or words; 3 the text or path holds one of two words, only for queries with
    fewer than `loose` results; 4 for queries without tokens the heaviest nodes. Each tier reads the queries that are
    still open and no others. Within a tier heavier nodes come first, then smaller ids; a node counts in its first tier.
    """
    tokens = table(query_tokens(queries), "tokens")
    n = table(nodes.select("id", "name", "path", F.lower("name").alias("low"), F.lower("path").alias("low_path"), F.lower("text").alias("body"), "weight"), "nodes")
    base = F.element_at(F.split("token", "/"), -1)
    segments = F.split("low_path", "/")
    by_prefix = n.select("id", "weight", F.explode(F.array_distinct(F.concat(_prefixes(F.col("low")), F.flatten(F.transform(F.slice(segments, 2, 1000), _prefixes))))).alias("key"))

    def paths(open_):
        t = tokens.where("class = 'path'").join(open_, "query", "left_semi")
        whole = t.select("query", F.col("token").alias("path")).join(n, "path").select("query", "id", "weight")
        return whole.unionByName(t.select("query", F.lower(base).alias("low")).join(n, "low").select("query", "id", "weight"))

    def equal(open_):
        t = _ranked(tokens.where("class <> 'path'").join(open_, "query", "left_semi")).where(F.col("at") <= EXACT)
        return t.select("query", F.col("token").alias("name")).join(n, "name").select("query", "id", "weight")

    def begin(open_):
        t = _ranked(tokens.where(f"class <> 'path' and length(token) >= {LEAST}").join(open_, "query", "left_semi")).where(F.col("at") <= PREFIX)
        return t.select("query", F.lower("token").alias("key")).join(by_prefix, "key").select("query", "id", "weight")

    def hold(open_):
        t = _ranked(tokens.where(f"class = 'word' and length(token) >= {LEAST}").join(open_, "query", "left_semi")).where(F.col("at") <= PARTS)
        t = t.select("query", F.lower("token").alias("part"))
        grams = n.select("id", F.explode(F.array_union(_grams(F.col("body")), _grams(F.col("low_path")))).alias("gram"))
        asked = t.select("part").distinct().select("part", F.explode(_grams(F.col("part"))).alias("gram"))
        df = grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
        rare = asked.join(df, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))["gram"].alias("gram"))  # the rarest trigram stands for the word
        hits = rare.join(grams, "gram").join(n, "id").where(F.col("body").contains(F.col("part")) | F.col("low_path").contains(F.col("part"))).select("part", "id", "weight")
        return t.join(hits, "part").select("query", "id", "weight")

    have, open_ = None, table(queries.select("query").distinct(), "open")
    for tier, (find, enough, most) in enumerate(((paths, limit, limit), (equal, limit, limit), (begin, limit, limit), (hold, min(limit, loose), min(limit, loose)))):
        got = _first(find(open_), have, most if tier < 3 else limit).withColumn("tier", F.lit(tier))
        if tier == 3:
            w = Window.partitionBy("query").orderBy(F.desc("weight"), "id")
            got = got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= loose).drop("_n")
        got = table(got, f"tier{tier}")
        have = got if have is None else have.unionByName(got)
        full = limit if tier < 2 else min(limit, loose)  # what closes a query for the next tier
        closed = have.groupBy("query").agg(F.count("*").alias("c")).where(F.col("c") >= full)
        open_ = table(open_.join(closed, "query", "left_anti"), "open")
    blank = queries.select("query").distinct().join(tokens, "query", "left_anti")
    top = n.orderBy(F.desc("weight"), "id").limit(limit).select("id", "weight")
    whole = blank.crossJoin(F.broadcast(top)).select("query", "id", "weight", F.lit(4).alias("tier"))  # at most `limit` rows, and queries without a token
    return have.unionByName(whole).select("query", "id", "tier")


def _ranked(tokens: DataFrame) -> DataFrame:
    """at: the place of a token among those of its query that are left: symbols first, then the longest."""
    return tokens.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy((F.col("class") != "symbol"), F.desc(F.length("token")), "token")))


def prefix_search(queries: DataFrame, docs: DataFrame, limit: int = 10, least: int = 4) -> DataFrame:
    """queries: query, text; docs: id, text. query, id, score, found: documents with a word that begins with a word (of
    `least` or more letters) of the query, by the summed rarity of the words met; a query that meets nothing gets the
    latest documents (found is false).

    Words of queries are joined with the prefixes of the distinct words of all documents, and what they stand for with the
    postings of those words only. A document counts a query's word once.
    """
    asked = queries.select("query", F.explode(T.tokens(F.col("text"))).alias("word")).where(F.length("word") >= least)
    words = docs.select("id", F.explode(T.tokens(F.col("text"))).alias("term"))
    vocabulary = words.select("term").distinct().withColumn("word", F.explode(F.filter(_prefixes(F.col("term")), lambda p: F.length(p) >= least)))
    stands = table(asked.select("word").distinct().join(vocabulary, "word").select("word", "term"), "stands")
    postings = table(words.join(stands, "term").select("word", "id").distinct(), "postings")
    n = docs.count()
    rarity = postings.groupBy("word").agg(F.log(1 + F.lit(n) / F.count("*")).alias("rarity"))
    scored = asked.join(postings, "word").join(rarity, "word").groupBy("query", "id").agg(F.round(F.sum("rarity"), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("id"))
    best = table(scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).select("query", "id", "score", F.lit(True).alias("found")), "best")
    latest = docs.select("id").orderBy(F.desc("id")).limit(limit)
    rest = queries.select("query").distinct().join(best, "query", "left_anti").crossJoin(F.broadcast(latest)).select("query", "id", F.lit(0.0).alias("score"), F.lit(False).alias("found"))
    return best.unionByName(rest)
