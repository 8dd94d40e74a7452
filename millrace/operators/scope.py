"""The scope of a task: the files and folders that it is about and what says so, votes of what was found over the tree of
folders, and the units that a plan is made of.

Tasks: task (key), text, package and cwd (both may be null). Paths are relative to the root, folders have no slash at
the end. Everything is grouped by (task, member), so neither a task with many files nor a file of many tasks is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import packing as P
from millrace.operators.retrieval import folder
from millrace.sources.work import shuffled, table

#: What each signal adds to the confidence of a scope; bounds of a confidence.
SIGNALS = {"explicit_path": 0.40, "changed_files": 0.25, "current_package": 0.15, "cwd_locality": 0.10, "exact_symbol": 0.10, "recent_files": 0.05, "dep_neighborhood": 0.05}
LEAST, MOST = 0.10, 1.0
#: At most so many pairs of packages are sent to all tasks; more are joined by a shuffle.
FEW = 100_000
#: So many tasks are dealt to one of Spark's, which holds their members while it groups them.
TASKS = 25_000
#: Endings of files that a text may name.
ENDINGS = ("go", "ts", "js", "py", "rs", "java", "cpp", "c", "h", "md", "json", "yaml", "yml", "sql")
#: Fixed values of units: share of the score, cache reuse, place in the order of a prompt.
UNITS = {"signature": (0.60, 0.90, 1), "definition": (1.00, 0.70, 2)}


def clean(path: Column) -> Column:
    """A path without ./ in front, doubled slashes and a slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"^(\./)+", ""), "/$", "")


def named_paths(text: Column) -> Column:
    """The distinct files that a text names: runs of path characters (dots at the end are the sentence's) with a known ending."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9_./-]+"), 0), lambda x: clean(F.regexp_replace(x, r"\.+$", "")))
    return F.array_distinct(F.filter(runs, lambda x: F.element_at(F.split(x, r"\."), -1).isin(*ENDINGS) & x.contains(".")))


def names_symbol(text: Column) -> Column:
    """Does a text hold a word that begins with a capital and has three characters or more, or letters with a capital after small ones?"""
    words = F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+")
    return F.exists(words, lambda w: (w.rlike("^[A-Z]") & (F.length(w) >= 3)) | w.rlike("^[a-z]+[A-Z]"))


def _masks() -> tuple[Column, Column, Column]:
    """Of the column mask: the tier, the names of its signals in order, and what they add up to."""
    names = list(SIGNALS)
    of = [[x for i, x in enumerate(names) if m >> i & 1] for m in range(2 ** len(names))]
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("mask") + 1)
    return F.when(F.col("mask").bitwiseAND(F.lit(_STRONG)) > 0, "primary").otherwise("secondary"), at([",".join(sorted(x)) for x in of]), at([round(float(sum(SIGNALS[y] for y in x)), 6) for x in of])


#: A bit for each signal; those that make a member primary.
_BIT = {k: 1 << i for i, k in enumerate(SIGNALS)}
_STRONG = _BIT["explicit_path"] | _BIT["changed_files"] | _BIT["current_package"] | _BIT["cwd_locality"]


def _said(member: Column, signal: str) -> Column:
    return F.struct(member.alias("member"), F.lit(_BIT[signal]).alias("mask"))


def infer(tasks: DataFrame, changed: DataFrame, recent: DataFrame, deps: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(task, member, tier, signals) and (task, confidence, signals, members).

    changed and recent: task, path; deps: package, dependency. Paths that the text names, changed files and the folders of
    both, and the current package (else the working folder) are primary; recent files and the packages that primary
    members depend on are secondary unless they are primary. A dependency counts as a signal where it adds or confirms a
    secondary member. A task without signals is there with the least confidence and no member.

    Signals are bits. What is said of a task is dealt by the task, once and before dependencies, which make many rows of one,
    are put in; these are grouped where they are made (with few dependencies), so members are neither shuffled nor written.
    """
    # a row without member stands for the task itself
    itself = F.struct(F.lit(None).cast("string").alias("member"), F.when(names_symbol(F.col("text")), _BIT["exact_symbol"]).otherwise(0).alias("mask"))
    here = F.struct(F.coalesce("package", "cwd").alias("member"), F.when(F.col("package").isNotNull(), _BIT["current_package"]).otherwise(_BIT["cwd_locality"]).alias("mask"))
    named = F.flatten(F.transform(named_paths(F.col("text")), lambda p: F.array(_said(p, "explicit_path"), _said(folder(p), "explicit_path"))))
    own = tasks.select("task", F.explode(F.concat(F.array(itself), F.filter(F.concat(F.array(here), named), lambda x: x["member"] != ""))).alias("x"))
    path = clean(F.col("path"))
    there = lambda d: d.where("path is not null and path <> ''")
    late = there(recent).select("task", _said(path, "recent_files").alias("x"))
    touched = there(changed).select("task", F.explode(F.array(_said(path, "changed_files"), _said(folder(path), "changed_files"))).alias("x")).where("x.member <> ''")
    known = table(tasks.select("task").distinct(), "tasks")
    n = max(known.sparkSession.sparkContext.defaultParallelism, -(-known.count() // TASKS))
    rows = own.unionByName(touched).unionByName(late).select("task", "x.member", "x.mask").repartition(n, "task")
    rows = rows.join(shuffled(known.repartition(n, "task")), "task")  # a semi join would be put below the union, and deal rows twice
    said = rows.groupBy("task", "member").agg(F.bit_or("mask").alias("mask"))
    # few packages have most members: a shuffle by package would be as many tasks as packages, so few dependencies go to the tasks
    deps = table(deps.select(F.col("package").alias("member"), "dependency").where("dependency is not null").distinct(), "deps")
    strong = F.col("mask").bitwiseAND(F.lit(_STRONG)) > 0
    near = lambda y: _said(y, "dep_neighborhood")
    if deps.limit(few + 1).count() <= few:
        to = deps.groupBy("member").agg(F.collect_list("dependency").alias("to"))
        with_near = F.concat(F.array(F.struct("member", "mask")), F.when(strong & F.col("to").isNotNull(), F.transform("to", near)).otherwise(F.array().cast("array<struct<member:string,mask:int>>")))
        rows = said.join(F.broadcast(to), "member", "left").select("task", F.explode(with_near).alias("x")).select("task", "x.*")
    else:
        said = table(said, "scope")
        rows = said.unionByName(said.where(strong).join(deps, "member").select("task", near(F.col("dependency")).alias("x")).select("task", "x.*"))
    both = rows.groupBy("task", "member").agg(F.bit_or("mask").alias("mask"))
    both = both.withColumn("mask", F.when(strong, F.col("mask").bitwiseAND(F.lit(~_BIT["dep_neighborhood"]))).otherwise(F.col("mask")))
    tier, names, sure = _masks()
    members = both.where("member is not null").select("task", "member", tier.alias("tier"), names.alias("signals"))
    sums = both.groupBy("task").agg(F.bit_or("mask").alias("mask"), F.count("member").alias("members"))
    c = F.round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), sure)), 6)
    return members, sums.select("task", c.alias("confidence"), names.alias("signals"), "members")


def folders_above(path: Column) -> Column:
    """The folders that a path lies in, the root (empty) first."""
    parts = F.split(folder(path), "/")
    below = F.when(folder(path) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return F.concat(F.array(F.lit("")), below)


def localize(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """task, folder, depth, votes, total: the deepest folder that holds more than `share` (at least a half) of the votes of
    a task's hits (task, path, score). Every hit votes with its score, if above 0, for all folders above it; as more than
    a half is asked, the folders that pass lie in one another, so one grouping finds the last without a walk down the tree.
    """
    if share < 0.5:
        raise ValueError("with less than a half several folders of one depth may pass")
    v = hits.where("score > 0").select("task", "score", F.explode(folders_above(F.col("path"))).alias("folder"))
    v = v.groupBy("task", "folder").agg(F.round(F.sum("score"), 6).alias("votes"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    v = v.withColumn("depth", depth).withColumn("total", F.max(F.when(F.col("folder") == "", F.col("votes"))).over(Window.partitionBy("task")))
    best = F.max_by(F.struct("folder", "depth", "votes", "total"), "depth")
    return v.where(F.col("votes") > share * F.col("total")).groupBy("task").agg(best.alias("b")).select("task", "b.*")


def units(cands: DataFrame) -> DataFrame:
    """task, id, path, unit, tokens, value, reuse, content of candidates (task, id, score, name, kind, path, signature,
    content): the signature (kind and name where it is empty), and the content where there is any; four characters a token."""

    def unit(name: str, text: Column) -> Column:
        part, reuse, _ = UNITS[name]
        return F.when(text != "", F.struct(F.lit(name).alias("unit"), F.floor((F.length(text) + 3) / 4).alias("tokens"), F.round(F.col("score") * part, 6).alias("value"), F.lit(reuse).alias("reuse"), text.alias("content")))

    empty = F.lit("")
    heading = F.when(F.coalesce("signature", empty) != "", F.col("signature")).when(F.coalesce("name", empty) != "", F.concat_ws(" ", "kind", "name"))
    return cands.select("task", "id", "path", F.explode(F.array_compact(F.array(unit("signature", heading), unit("definition", F.coalesce("content", empty))))).alias("u")).select("task", "id", "path", "u.*")


def plan_units(cands: DataFrame, budget: int, target: float = 0.85, floor: int = 200) -> DataFrame:
    """task, id, unit, tokens, place of the units that a plan takes: by value (with cache reuse) per token until the chance
    that all are wrong is small enough, then in the order of a prompt: signatures, definitions, each by path and id.

    A unit that alone is above the budget is left out, and of a task's rest only what the budget could hold is gathered."""
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[2])]), F.col("unit"))
    u = units(cands).withColumn("o", F.round(F.col("value") * (1 + 0.2 * F.col("reuse")) / F.greatest(F.lit(1), F.col("tokens")), 12)).withColumn("rank", rank)
    u = u.withColumn("key", F.struct("id", "unit"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("o")).alias("o"), F.struct("path", "rank", "id").alias("k"), "tokens", F.col("value").alias("score"), F.struct("rank", "path", "id", "unit", "tokens").alias("id"))))
    got = P.fitting(u, ["task"], budget, F.desc("o"), F.col("path"), F.col("rank"), F.col("id")).groupBy("task").agg(P.noisy_or(items, budget, target, floor, "struct<rank:int,path:string,id:bigint,unit:string,tokens:bigint>").alias("g"))
    return got.select("task", F.posexplode(F.array_sort("g.chosen")).alias("n", "c")).select("task", "c.id", "c.unit", "c.tokens", (F.col("n") + 1).cast("long").alias("place"))
