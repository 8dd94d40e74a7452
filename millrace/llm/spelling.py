"""Spelling variants: words one edit apart, by forward and reversed sorted dictionaries.

Words are counted over all texts. One edit leaves the first or the last half of a
word as it is, so words are sorted into blocks that share a prefix (the forward
dictionary) and into blocks that share a suffix (the reversed one): one kind for
replacements, among words of equal length, and one for insertions, where a word
stands as the shorter of a pair and, cut by one, as the longer. A block above
`block` words is divided: of the part of the word where the edit may be, one half
is again as it is, so its words go to a block that shares more of the front and to
one that shares more of the end. That ends in blocks of words alike but for one
place, which the alphabet bounds. Sizes come from pre-aggregated counts, so no
large block is gathered. Blocks are then range-partitioned by their key, so each
is a run of the sorted dictionary, and its words are verified with each other.

A word's form is the commonest near word, if it is at least twice as common; its
root ends the chain of forms, found by pointer doubling (counts double with each
step, so a chain has 63 at most).

Defined cases: null texts have no words; a null id counts as an empty one in the
checksum; repeated rows count each time; a table without words gives no row. Very
long words work as others do. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.keys import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, NOISE, BLOCK = 5, 3, 97, 48


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """word, n: the runs of letters of all texts, one in `noise` of them (by a checksum of id and run) less a letter."""
    src = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.translate(docs[text].cast("string"), UPPER, LOWER).alias("t"))
    runs = src.select("id", F.explode(F.regexp_extract_all("t", F.lit(RUN), 0)).alias("run")).where(F.length("run") >= least_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    words = runs.withColumn("h", h).withColumn("at", at).select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(lo, hi):
    """What the words of a block share; from the end it is read backwards, so keys sort as the reversed dictionary does."""
    front, end = F.substring("word", F.lit(1), lo), F.expr("reverse(substring(word, length(word) - hi + 1, hi))")
    return F.concat_ws("|", F.col("kind"), F.col("s").cast("string"), lo.cast("string"), hi.cast("string"), front, end)


def _blocks(rows: DataFrame) -> DataFrame:
    """rows: word, n, kind (r or i), s (letters of the shorter word), long, lo, hi. Two rows for each: more of the front shared, more of the end."""
    m = F.col("s") - F.col("lo") - F.col("hi")
    h = F.when(F.col("kind") == "r", F.floor(m / 2)).otherwise(F.ceil(m / 2)).cast("int")
    rest = F.when(F.col("kind") == "r", m - h).otherwise(m - h + 1).cast("int")
    both = F.array(F.struct((F.col("lo") + h).alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), (F.col("hi") + rest).alias("hi")))
    cut = rows.withColumn("cut", F.explode(both)).select("word", "n", "kind", "s", "long", F.col("cut.lo").alias("lo"), F.col("cut.hi").alias("hi"))
    return cut.withColumn("key", _key(F.col("lo"), F.col("hi")))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """words: word, n (distinct, no nulls). a, a_n, b, b_n: each pair of words one edit apart, once."""
    size = F.length("word")
    alike = words.select("word", "n", F.lit("r").alias("kind"), size.alias("s"), F.lit(False).alias("long"))
    short = words.select("word", "n", F.lit("i").alias("kind"), size.alias("s"), F.lit(False).alias("long"))
    long = words.select("word", "n", F.lit("i").alias("kind"), (size - 1).alias("s"), F.lit(True).alias("long"))
    rows = alike.unionByName(short).unionByName(long).select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    found = None
    while True:
        rows = table(_blocks(rows), "blocks")
        sizes = rows.groupBy("key", "kind").agg(F.count("*").alias("c"), F.sum(F.col("long").cast("long")).alias("longs"))
        sizes = sizes.where(F.when(F.col("kind") == "r", F.col("c") > 1).otherwise((F.col("longs") > 0) & (F.col("longs") < F.col("c"))))
        rows = table(rows.join(sizes.select("key", "c"), "key"), "sized")
        m = F.col("s") - F.col("lo") - F.col("hi")
        split = (F.col("c") > block) & (m > F.when(F.col("kind") == "r", 1).otherwise(0))
        part = rows.where(~split).select("key", "kind", "word", "n", "long")
        found = part if found is None else found.unionByName(part)
        rows = rows.where(split).drop("key", "c")
        if not rows.limit(1).count():
            break
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = found.repartitionByRange(parts, "key").groupBy("key", "kind").agg(F.collect_list(F.struct("word", "n", "long")).alias("run"))
    each = runs.select("kind", "run", F.explode("run").alias("a")).where("not a.long")

    def near(w):
        apart = F.levenshtein(F.col("a.word"), w["word"], 1) == 1
        return F.when(F.col("kind") == "r", F.col("a.word") < w["word"]).otherwise(w["long"]) & apart

    pairs = each.select("kind", "a", F.explode(F.filter("run", near)).alias("b"))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def group_variants(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; distinct, no nulls)."""
    words = table(words.select("word", "n"), "words")
    pairs = table(near_pairs(words, block), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    held = words.join(near, "word", "left")
    common = -F.col("best.less") >= 2 * F.col("n")
    held = table(held.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "forms")
    roots = held.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = table(roots.join(step, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if not roots.where("moved").limit(1).count():
            break
        roots = roots.drop("moved")
    held = held.join(roots.drop("moved"), "word", "left")
    return held.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form_n").cast("long").alias("form_n"))
