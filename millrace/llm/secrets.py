"""Secret scans with corpus-wide ownership, with DataFrame functions only.

Each kind's pattern gives its matches and, by splitting on it, the gaps between
them; running sums of both lengths are the spans (code points, end exclusive).
Every candidate value is hashed. Over the whole corpus a hash gets its number
of distinct repositories and owners (an owner and repository pair is one
repository); the counts are pre-aggregated by (hash, owner, repository), so a
value that stands in a third of all rows is a few rows per task. A hash of
more than `max_owners` owners is a widely copied example; the others are
owner-specific and look live.

Base spans (assign, access, hex) are all kept and classed. The method adds
spans of kind `owned`: runs of 20 or more credential characters with a digit,
an upper and a lower case letter that touch no base span and whose hash is
owner-specific. The join of candidates with the counts is salted.

Defined cases: null text is empty; null owners or repositories count as one of
their own; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.keys import table

#: Fixed values of the contract: kind, pattern, group that holds the value, least length of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
BASE_KINDS = ("assign", "access", "hex")
MAX_OWNERS = 2
SALTS = 8


def _candidates(text: Column, kind: int) -> Column:
    """array<struct<kind, at, gap, len, ok, hash>> of a pattern's matches, in order."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    values = F.regexp_extract_all(text, p, F.lit(group))
    both = F.zip_with(F.regexp_extract_all(text, p, F.lit(0)), values, lambda m, v: F.struct(m.alias("m"), v.alias("v"))) if group else F.transform(values, lambda m: F.struct(m.alias("m"), m.alias("v")))

    def one(gap, b):
        ok = F.length(b["v"]) >= least
        if KINDS[kind][0] == "owned":
            ok = ok & b["v"].rlike("[0-9]") & b["v"].rlike("[A-Z]") & b["v"].rlike("[a-z]")
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(b["m"]).alias("len"), ok.alias("ok"), F.sha2(b["v"], 256).alias("hash"))

    found = F.filter(F.zip_with(F.split(text, pattern, -1), both, one), lambda x: x["len"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,hash:string>>"))


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang", max_owners: int = MAX_OWNERS) -> DataFrame:
    """A row for each document: its id, and spans: array<struct<start, kind, end, live, n_owners, n_repositories>> by start, then kind (0 assign, 1 access, 2 hex, 3 owned)."""
    src = docs.select(docs[doc_id].alias("doc_id"), docs[owner].cast("string").alias("owner"), docs[repository].cast("string").alias("repo"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    base = src.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", F.array(*[_candidates(F.col("t"), k) for k in range(len(KINDS))]).alias("found"))
    base = table(base, "candidates")  # fixes rid
    each = base.select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", F.posexplode("f").alias("at", "c")).select("rid", "owner", "repo", "at", "c.*")
    upto = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto).cast("long")).withColumn("start", F.col("end") - F.col("len")).where("ok").drop("ok", "gap", "len", "at")
    by_start = Window.partitionBy("rid").orderBy("start")
    is_base = F.col("kind") < len(BASE_KINDS)
    each = each.withColumn("left", F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = each.withColumn("left", F.greatest("left", F.max(F.when(is_base, F.col("end"))).over(by_start.rangeBetween(Window.currentRow, Window.currentRow))))
    each = each.withColumn("right", F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    each = table(each.where(is_base | ~(F.coalesce(F.col("left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("right") < F.col("end"), F.lit(False)))).drop("left", "right"), "spans")
    owners = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"))
    owners = owners.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    known = each.withColumn("salt", F.pmod(F.col("rid"), F.lit(SALTS)).cast("int")).join(owners, ["hash", "salt"]).withColumn("live", F.col("n_owners") <= max_owners)
    known = known.where(is_base | F.col("live")).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "n_owners", "n_repositories"))).alias("spans"))
    empty = F.array().cast(known.schema["spans"].dataType)
    return base.select("rid", "doc_id").join(known, "rid", "left").select(F.col("doc_id").alias(doc_id), F.coalesce("spans", empty).alias("spans"))


def ownership(docs: DataFrame, **names) -> DataFrame:
    """What the scan says per document, counted: n_live and n_copied base or added spans."""
    got = find_secrets(docs, **names)
    return got.withColumn("n_live", F.size(F.filter("spans", lambda s: s["live"]))).withColumn("n_copied", F.size(F.filter("spans", lambda s: ~s["live"])))
