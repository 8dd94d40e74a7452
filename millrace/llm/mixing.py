"""Mixing sources to target weights, with DataFrame functions only.

The words of each source, documents in a fixed pseudorandom order, are one
stream that is packed into blocks of `block` words, the last of which may be
part of one. A source's target gives its number of output slots, counted in
blocks of the source's mean size (so that whole passes are whole) and at least
one where the target is above 0; each slot draws its output shard, so a source's
counts per shard are multinomial. Slots are numbered through the shards and
mapped to blocks by pseudorandom permutations of the source's block indexes,
one permutation for each pass over the source (swap-or-not rounds, which are
bijections of 0..n-1 for every n). Blocks join their slots by index; a
document's taken words are those of its parts of taken blocks.

Running totals are two-level: within (source, chunk), a chunk being a hash
bucket, then over the chunks of a source; so a source that holds a third of
all rows is spread over CHUNKS groups.

Defined cases: null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0; rows with equal id and
text are separate rows; an empty table gives an empty result. Runs agree, as
all draws are hashes of (seed, source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.keys import table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK = 64
SHARD_SLOTS = 8192
CHUNKS = 1024
SPREAD = 1 << 15
ROUNDS = 8


def _source_key(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """source, key, source_size -> with target. Targets share `share` of all sizes by weight, none above `most` times its source's size.

    Capped sources are those of the smallest cap / weight; the level at which
    the caps and the weighted rest add up to the whole share is found with
    running sums over the sources in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("share", F.sum("source_size").over(whole) * float(share))
    t = t.withColumn("level", (F.col("share") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(whole)["level"])
    return t.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))).select("source", "key", "source_size", "weight", "target")


def permuted(index: Column, n: Column, salt: Column, rounds: int = ROUNDS) -> Column:
    """The place of index under a pseudorandom permutation of 0..n-1 (swap-or-not)."""

    def step(x, r):
        other = F.pmod(F.xxhash64(salt, r, F.lit("k")) - x, n)
        return F.when(F.pmod(F.xxhash64(salt, r, F.greatest(x, other)), F.lit(2)) == 0, x).otherwise(other)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), index.cast("long"), step)


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sources, slots).

    documents: doc_id, h (hash of id and text), key, size, chunk, rn, begin (first word within the source's stream);
    sources: source, key, source_size, weight, target, blocks, slots;
    slots: key, shard, slot, block - the mix itself, one row for each block taken.
    """
    t = docs[text].cast("string")
    base = docs.select(docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(docs[doc_id], t).alias("h"))
    base = table(base.withColumn("key", _source_key(F.col("source"))).withColumn("chunk", F.pmod("h", F.lit(CHUNKS)).cast("int")), "sizes")
    sources = targets(base.groupBy("source", "key").agg(F.sum("size").alias("source_size")))
    sources = table(sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("slots", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") * F.col("blocks") / F.col("source_size")))).otherwise(0).cast("long")), "sources")
    own = Window.partitionBy("key", "chunk").orderBy("h", "doc_id", "size")
    chunks = base.groupBy("key", "chunk").agg(F.sum("size").alias("n"))
    chunks = chunks.withColumn("offset", F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    placed = base.withColumn("rn", F.row_number().over(own)).withColumn("before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(chunks, ["key", "chunk"]).withColumn("begin", F.col("before") + F.col("offset")).drop("before", "offset", "source")
    # draws: every slot of a source takes a shard; the numbers per shard are then laid end to end
    shards = F.greatest(F.lit(1), F.ceil(F.sum("slots").over(Window.partitionBy()) / SHARD_SLOTS)).cast("long")
    runs = sources.withColumn("shards", shards).where("slots > 0")
    runs = runs.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SPREAD).cast("long"))))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as few small rows make many slots
    runs = runs.repartition(spread, "key", "lo")
    drawn = runs.withColumn("j", F.explode(F.sequence("lo", F.least(F.col("lo") + SPREAD, F.col("slots")) - 1)))
    drawn = drawn.groupBy("key", "blocks", F.pmod(F.xxhash64(F.lit(seed), "key", "j"), F.col("shards")).alias("shard")).agg(F.count("*").alias("n"))
    drawn = drawn.withColumn("first", F.sum("n").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    slots = drawn.repartition(spread, "key", "shard").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    salt = F.xxhash64(F.lit(seed), F.col("key"), F.floor(F.col("slot") / F.col("blocks")))
    slots = slots.withColumn("salt", salt).select("key", "shard", "slot", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("salt")).alias("block"))
    return placed, sources, slots


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each part of a document in one block (one with nulls for a document without words): key, chunk, rn, doc_id, h, size, lo, hi (words of the document), times."""
    times = slots.groupBy("key", "block").agg(F.count("*").alias("times"))
    parts = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))))
    parts = parts.withColumn("lo", F.greatest(F.lit(0), F.col("block") * block - F.col("begin"))).withColumn("hi", F.least(F.col("size"), (F.col("block") + 1) * block - F.col("begin")))
    times = times.hint("merge")  # Spark takes what comes out of explode for as small as what goes in, and would broadcast it
    return parts.join(times, ["key", "block"], "left").select("key", "chunk", "rn", "doc_id", "h", "size", "lo", "hi", F.coalesce("times", F.lit(0)).alias("times"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken."""
    placed, sources, slots = plan(docs, doc_id, text, source, seed)
    got = pieces(placed, slots).groupBy("key", "chunk", "rn", "doc_id", "size").agg(F.sum((F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))) * F.col("times")).cast("long").alias("taken"))
    return got.join(sources.select("key", "source_size", "target"), "key").select("doc_id", "size", "source_size", "target", "taken").withColumnRenamed("doc_id", doc_id)


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", seed: int = 7) -> DataFrame:
    """The documents as the mix takes them, with their columns: a document no block of which is taken is left out,
    one that is wholly taken once keeps its text, otherwise its text is its words of the first pass, then of the
    second, joined by spaces. A document without words, which no slot can take, is left out. Rows alike in id and
    text take the passages of each of them in turn."""
    placed, _, slots = plan(docs, doc_id, text, source, seed)
    got = pieces(placed, slots).where("times > 0").groupBy("doc_id", "h", "chunk", "key", "rn", "size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("parts"))
    got = got.select(F.col("doc_id").alias("d0"), F.col("h").alias("h0"), F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("key", "chunk", "rn")).alias("n0"), F.col("size").alias("s0"), "parts")
    names = docs.columns
    left = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], F.xxhash64(docs[doc_id], docs[text].cast("string")).alias("h"), docs[doc_id].alias("d"))
    left = left.withColumn("n", F.row_number().over(Window.partitionBy("d", "h").orderBy(F.lit(1))))
    t = f"c{names.index(text)}"
    j = left.join(got, left["d"].eqNullSafe(got["d0"]) & (left["h"] == got["h0"]) & (left["n"] == got["n0"]))
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + (p["hi"] - p["lo"]))
    once = (taken == F.col("s0")) & F.forall("parts", lambda p: p["times"] == 1)
    words = F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0))

    def passage(n):
        return F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= n), lambda p: F.slice(F.col("w"), p["lo"].cast("int") + 1, (p["hi"] - p["lo"]).cast("int"))))

    new = F.when(once, F.col(t)).otherwise(F.array_join(F.concat(*[passage(n) for n in range(1, MAX_REPEATS + 1)]), " "))
    j = j.withColumn("w", F.when(~once, words)).withColumn("new", new)
    out = []
    for i, c in enumerate(names):
        if c == text:
            out.append(F.col("new").alias(c))
        elif c == chars:
            out.append(F.length("new").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"c{i}").alias(c))
    return j.select(*out)
