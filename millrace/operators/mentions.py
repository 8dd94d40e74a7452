"""Names in texts, and the kinds of pairs of candidates that they and their files make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.work import table


def mentions(texts: DataFrame, names: DataFrame, drop_own: bool = True) -> DataFrame:
    """texts: id, text; names: id, name (one or more words). text_id, name_id, times: how often a text has the words of a
    name in a row, as whole words; with drop_own not where both ids are equal.

    Names are known by their word that is rarest in the texts. Only places of such words leave a text's scan; they are
    joined with the names and come back to the text with the place where the name would begin, to be compared there.
    A name whose rarest word is common costs as many places as that word has, spread over the texts.
    """
    words = lambda c: T.all_tokens(c)
    n = names.select(F.col("id").alias("name_id"), words(F.col("name")).alias("nw")).where(F.size("nw") > 0)
    n = table(n.groupBy("nw").agg(F.collect_set("name_id").alias("name_ids")).withColumn("nid", F.monotonically_increasing_id()), "names")  # equal names are looked for once
    each = n.select("nid", F.posexplode("nw").alias("at", "word"))
    t = table(texts.select(F.col("id").alias("text_id"), words(F.col("text")).alias("tw")).where(F.size("tw") > 0).withColumn("tid", F.monotonically_increasing_id()), "texts")
    places = t.select("tid", F.posexplode("tw").alias("place", "word"))
    df = places.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("df"))
    keys = each.join(df, "word").groupBy("nid").agg(F.min(F.struct("df", "word", "at")).alias("k"), F.count("*").alias("known"))
    keys = table(keys.join(n.select("nid", F.size("nw").alias("size")), "nid").where("known = size").select("nid", "k.word", "k.at", "size"), "keys")  # a name with a word that no text has is in none
    starts = places.join(keys, "word").select("tid", "nid", (F.col("place") - F.col("at")).alias("start")).where("start >= 0")
    by = starts.join(n.select("nid", "nw"), "nid").groupBy("tid", "nid").agg(F.first("nw").alias("nw"), F.collect_set("start").alias("starts"))  # places of one name in one text
    same = lambda p: F.slice(F.col("tw"), p + 1, F.size("nw")) == F.col("nw")
    found = by.join(t, "tid").select("text_id", "nid", F.size(F.filter("starts", same)).cast("long").alias("times")).where("times > 0")
    out = found.join(n.select("nid", F.explode("name_ids").alias("name_id")), "nid").select("text_id", "name_id", "times")
    return out.where("text_id <> name_id") if drop_own else out


def pair_type(a: dict[str, Column], b: dict[str, Column], calls: Column) -> Column:
    """What two candidates are to each other, the first that fits: kind, path and text of each, and whether the text of
    either names the other. Null if they are nothing to each other."""
    both = lambda x, y: ((a["kind"] == x) & (b["kind"] == y)) | ((a["kind"] == y) & (b["kind"] == x))
    test = lambda s: F.coalesce(s["path"].endswith("_test.go"), F.lit(False))
    declares = lambda s: F.coalesce(s["text"].contains("type ") & s["text"].contains("interface"), F.lit(False))
    return (
        F.when(both("decision", "code"), "decision+source")
        .when(both("failure", "decision"), "failure+fix")
        .when(test(a) != test(b), "source+test")
        .when(declares(a) | declares(b), "interface+impl")
        .when(calls, "caller+callee")
        .when((a["kind"] == "constraint") & (b["kind"] == "code"), "architecture+code")
    )


def typed_pairs(cands: DataFrame, by: str) -> DataFrame:
    """cands: by, id, kind, path, name, text (the candidates of one task are a short list). by, a, b, type of the pairs a < b."""
    c = cands.select(by, "id", "kind", "path", "name", "text")
    words = lambda x: F.concat(F.lit(" "), F.array_join(T.all_tokens(F.col(x)), " "), F.lit(" "))
    c = c.withColumn("said", words("text")).withColumn("called", words("name"))
    a, b = (c.select(by, *[F.col(x).alias(f"{x}_{s}") for x in c.columns if x != by]) for s in "ab")
    j = a.join(b, by).where("id_a < id_b")
    side = lambda s: {x: F.col(f"{x}_{s}") for x in ("kind", "path", "text")}
    names = lambda x, y: (F.length(F.trim(f"called_{y}")) > 0) & F.col(f"said_{x}").contains(F.col(f"called_{y}"))
    return j.select(by, F.col("id_a").alias("a"), F.col("id_b").alias("b"), pair_type(side("a"), side("b"), names("a", "b") | names("b", "a")).alias("type")).where("type is not null")
