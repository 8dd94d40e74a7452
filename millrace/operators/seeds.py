"""Seeds of a walk over a graph for many tasks at once, and expansion of queries by terms that a corpus says belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.changes import endings
from millrace.sources.work import sent, table

#: A name met whole, a name or path that holds a token, a changed file, a failed test; what a learned term weighs.
WHOLE, PART, CHANGED, FAILED = 1.0, 0.5, 1.2, 1.5
LEARNED = 0.65
GRAM = 3
#: So many grams or patterns are sent to the tasks that read the texts; more are joined by a shuffle.
FEW = 100_000


def _grams(text: Column, size: int) -> Column:
    n = F.length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def holding(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """pattern, id: the texts (id, text) that hold a pattern (pattern) anywhere in them. Empty and null patterns hold nothing.

    A pattern is looked up by the one of its three-letter grams that the fewest texts have (a shorter one by itself), and
    what that finds is verified; so common grams cost nothing unless a pattern has no other. The texts are read twice, for
    counts of the patterns' grams and for the texts of the chosen ones: a text goes nowhere for any other gram."""
    p = patterns.where("pattern <> ''").select("pattern").distinct()
    own = table(p.select("pattern", F.explode(F.array_distinct(F.when(F.length("pattern") < GRAM, F.array("pattern")).otherwise(_grams(F.col("pattern"), GRAM)))).alias("g")), "grams")
    every = F.array_distinct(F.flatten(F.array(*[_grams(F.col("text"), n) for n in range(1, GRAM + 1)])))
    g = texts.where("text is not null").select("id", "text", F.explode(every).alias("g"))
    often = g.select("g").join(sent(own.select("g").distinct(), FEW), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n"))
    rare = own.join(often, "g", "left").groupBy("pattern").agg(F.bool_and(F.col("n").isNotNull()).alias("ok"), F.min_by("g", F.struct("n", "g")).alias("g")).where("ok")
    rare = table(rare.select("pattern", "g"), "rare")
    found = g.join(sent(rare.select("g").distinct(), FEW), "g", "left_semi").join(sent(rare, FEW), "g")
    return found.where(F.col("text").contains(F.col("pattern"))).select("pattern", "id").distinct()


def seeds(tasks: DataFrame, nodes: DataFrame, changed: DataFrame, failures: DataFrame) -> DataFrame:
    """task, id, seed. tasks: task, text; nodes: id, name, path; changed: task, path; failures: task, name.

    A node whose name is a token of the task counts WHOLE, else one whose name or path holds one counts PART; each changed
    file that ends with the node's path, or the other way, adds CHANGED, and each failure that its name or path holds adds
    FAILED. Case does not matter but in paths of changed files. Nodes without any are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z_][a-z0-9_]{2,}"), 0))
    t = tasks.select("task", F.explode(words).alias("w")).distinct()
    n = nodes.select("id", F.lower("name").alias("name"), F.lower("path").alias("path"), F.col("path").alias("raw"))
    n = table(n, "nodes")  # read for names, paths and files
    both = n.select("id", F.col("name").alias("text")).unionByName(n.select("id", F.col("path").alias("text")))
    whole = t.join(n.select("id", F.col("name").alias("w")), "w").select("task", "id", F.lit(WHOLE).alias("s"))
    part = t.join(holding(t.select(F.col("w").alias("pattern")), both).withColumnRenamed("pattern", "w"), "w").select("task", "id", F.lit(PART).alias("s"))
    named = whole.unionByName(part).groupBy("task", "id").agg(F.max("s").alias("s"))
    ch = changed.where("path <> ''").select("task", F.col("path").alias("f")).distinct()
    at = endings(n.select(F.col("raw").alias("path")), ch.select(F.col("f").alias("path")))
    moved = ch.join(at, "f").join(n.select("id", F.col("raw").alias("p")), "p").groupBy("task", "id").agg((F.count("*") * F.lit(CHANGED)).alias("s"))
    fl = failures.where("name <> ''").select("task", F.lower("name").alias("pattern")).distinct()
    broken = fl.join(holding(fl, both), "pattern").groupBy("task", "id").agg((F.count("*") * F.lit(FAILED)).alias("s"))
    return named.unionByName(moved).unionByName(broken).groupBy("task", "id").agg(F.round(F.sum("s"), 6).alias("seed"))


def partners(texts: DataFrame, terms: DataFrame, least: int = 3, most: int = 3) -> DataFrame:
    """term, partner, dice, of the terms (term): those `most` that stand next to a term the most often for how often both
    occur (Dice coefficient over all texts), `least` times or more. Pairs of neighbours are as many as words, so nothing
    grows with the square of a text, and the counts are summed within tasks before they are shuffled.

    The texts are read once: each word is a row with the next one, and both words of a pair get their counts from the pairs'.
    A word's neighbour is left out where neither is asked for (and where it is the word itself), so such pairs are as few as words."""
    asked = terms.select("term").distinct()
    next_to = lambda t: F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.transform(F.array(T.all_tokens(F.col("text"))), next_to)[0]
    w = texts.select(F.explode_outer(pairs).alias("x")).select("x.*").where("a is not null")  # outer: no filter that cuts each text again
    if asked.limit(FEW + 1).count() <= FEW:
        for c in "ab":
            w = w.join(F.broadcast(asked.select(F.col("term").alias(c), F.lit(True).alias(f"is_{c}"))), c, "left")
        w = w.select("a", F.when(F.col("is_a") | F.col("is_b"), F.col("b")).alias("b"))
    lower, upper = F.least("a", "b"), F.greatest("a", "b")  # both the word itself where the other is null
    g = table(w.groupBy(lower.alias("a"), upper.alias("b")).agg(F.count("*").alias("c"), F.count_if(F.col("a") == lower).alias("first")), "pairs")
    n = g.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("first").alias("n")), F.struct(F.col("b").alias("term"), (F.col("c") - F.col("first")).alias("n")))).alias("x")).select("x.*").groupBy("term").agg(F.sum("n").alias("n"))
    ab = g.where((F.col("a") != F.col("b")) & (F.col("c") >= least)).select("a", "b", "c")
    each = ab.select(F.explode(F.array(F.struct(F.col("a").alias("term"), F.col("b").alias("partner")), F.struct(F.col("b").alias("term"), F.col("a").alias("partner")))).alias("x"), "c").select("x.*", "c")
    each = each.join(asked, "term", "left_semi")
    d = each.join(n, "term").join(n.select(F.col("term").alias("partner"), F.col("n").alias("m")), "partner")
    d = d.withColumn("dice", F.round(2 * F.col("c") / (F.col("n") + F.col("m")), 9))
    r = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("dice"), "partner"))
    return d.withColumn("r", r).where(F.col("r") <= most).select("term", "partner", "dice")


def expand(queries: DataFrame, learned: DataFrame) -> DataFrame:
    """key, term, weight of queries (key, text): their own terms at 1, the partners of those that are not there at LEARNED."""
    own = queries.select("key", F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    more = own.join(learned.select("term", "partner"), "term").select("key", F.col("partner").alias("term")).distinct()
    return own.withColumn("weight", F.lit(1.0)).unionByName(more.withColumn("weight", F.lit(LEARNED))).groupBy("key", "term").agg(F.max("weight").alias("weight"))
