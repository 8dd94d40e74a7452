"""Retrieval over a table of nodes and one of edges: candidate channels, graph expansion, evidence status, planning,
segments and shards of postings, and what is measured of them.

Nodes: id (long), name, path, content. Edges: src, dst, kind. Tasks are a stated query set: task (text). Candidates:
task, id, channel, score. Each caps its list by rank within the task, never by reading less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import ranking as R
from millrace.sources.work import dealt, sent, shuffled, table

#: Weights of edges by kind, and of kinds without one.
EDGE_WEIGHTS = {"call": 1.0, "test-reference": 0.9, "test": 0.9, "import": 0.8, "type-reference": 0.6, "type": 0.6, "references": 0.7, "documentation": 0.3, "doc": 0.3}
OTHER_WEIGHT = 0.5
#: Scores of what expansion adds, by reason.
SIBLING, CALL, TEST = 0.7, 0.85, 0.6
SIBLINGS_LIMIT, CALLS_LIMIT, TOTAL_LIMIT = 8, 8, 15
#: So many ids are sent to the tasks that read the edges; more are joined by a shuffle.
FEW = 100_000


def edge_weight(kind: Column) -> Column:
    pairs = [x for k, v in EDGE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(OTHER_WEIGHT))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def test_path(path: Column) -> Column:
    """The file that tests a source file; null for what is a test or no source."""
    return F.when(path.endswith(".go") & ~path.endswith("_test.go"), F.concat(F.regexp_replace(path, r"\.go$", ""), F.lit("_test.go")))


def _first(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of edges (src, dst, ..) that begin or end at one of ids (id, distinct); those that do both come twice."""
    few = ids.limit(FEW + 1).count() <= FEW
    side = lambda c: (F.broadcast if few else shuffled)(ids.select(F.col("id").alias(c)))
    return edges.join(side("src"), "src", "left_semi").unionByName(edges.join(side("dst"), "dst", "left_semi"))


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Candidates around seeds (task, id, place): task, id, depth, reason, score.

    Siblings of a seed's folder (first hop only), nodes joined by an edge either way, and files that test a source
    file. A new node belongs to the first place that reaches it; a place adds SIBLINGS_LIMIT and CALLS_LIMIT nodes at
    most, and a task that has TOTAL_LIMIT nodes is not expanded further. Tests are added but not expanded. A node
    that is reached for several reasons counts with the largest score. Edges may repeat; each hop reads them anew and keeps
    those of its front, so costly ones are handed in as a written table. Nodes are looked up where they are read, by what was
    reached, as long as that is few; they are not shuffled and sorted for it.
    """
    at = shuffled(nodes.select("id", "path", folder(F.col("path")).alias("dir")))
    front, seen, out = seeds.select("task", "id", "place"), seeds.select("task", "id"), None
    for d in range(1, depth + 1):
        here = table(at.join(sent(table(front, "front")), "id"), "here")
        links = table(touching(edges.select("src", "dst"), here.select("id").distinct()), "links")
        both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        calls = here.select("task", "place", F.col("id").alias("src")).join(both, "src").select("task", "place", F.col("dst").alias("id"))
        known = table(at.join(sent(table(both.select(F.col("dst").alias("id")).distinct(), "ends")), "id", "left_semi").select("id"), "known")
        calls = calls.join(known, "id", "left_semi").join(seen, ["task", "id"], "left_anti").groupBy("task", "id").agg(F.min("place").alias("place"))
        found = _first(calls, ["task", "place"], CALLS_LIMIT, F.col("id")).select("task", "id", "place", F.lit("call").alias("reason"), F.lit(CALL / d).alias("score"))
        if d == 1:
            most = seen.groupBy("task").count().agg(F.max("count")).first()[0] or 0  # what a task has seen cannot take more places than that
            near = _first(dealt(at.where("dir <> ''").select("id", "dir", "path"), "id"), ["dir"], SIBLINGS_LIMIT + most, F.col("path"), F.col("id"))
            kin = here.where("dir <> ''").groupBy("task", "dir").agg(F.min("place").alias("place")).join(near, "dir")
            kin = kin.join(seen, ["task", "id"], "left_anti")
            found = found.unionByName(_first(kin, ["task", "dir"], SIBLINGS_LIMIT, F.col("path"), F.col("id")).select("task", "id", "place", F.lit("sibling").alias("reason"), F.lit(SIBLING / d).alias("score")))
        tests = at.select("id", "path").join(sent(here.select("task", "place", test_path(F.col("path")).alias("path")).where("path is not null")), "path").join(seen, ["task", "id"], "left_anti")
        ends = tests.groupBy("task", "id").agg(F.min("place").alias("place")).select("task", "id", "place", F.lit("test").alias("reason"), F.lit(TEST / d).alias("score"))
        hop = table(found.unionByName(ends).withColumn("depth", F.lit(d)), "hop")  # written: used three times below
        out = hop if out is None else out.unionByName(hop)
        full = out.groupBy("task").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= TOTAL_LIMIT)
        seen = seen.unionByName(hop.select("task", "id")).distinct()
        front = hop.where("reason <> 'test'").groupBy("task", "id").agg(F.min("place").alias("_p")).join(full, "task", "left_anti")
        front = front.select("task", "id", F.row_number().over(Window.partitionBy("task").orderBy("_p", "id")).alias("place"))
    best = F.max_by(F.struct("depth", "reason"), F.struct("score", "reason"))
    return out.groupBy("task", "id").agg(best.alias("b"), F.max("score").alias("score")).select("task", "id", "b.depth", "b.reason", "score")


def evidence_status(exact: Column, lexical: Column, top: Column, graph: Column, asks_exact: Column, least: float = 0.10) -> Column:
    """What a task's candidates are worth: counts by channel, the largest lexical score, whether the task names a thing."""
    return (
        F.when((exact > 0) & asks_exact, "EXACT_FOUND")
        .when(exact > 0, "LEXICAL_FOUND")
        .when((lexical > 0) & (top >= least), "LEXICAL_FOUND")
        .when(lexical > 0, "INSUFFICIENT")
        .when(graph > 0, "GRAPH_FOUND")
        .otherwise("NONE")
    )


def channels(tasks: DataFrame, nodes: DataFrame, limit: int = 25) -> DataFrame:
    """task, id, channel, score: nodes whose name is the task (exact), that share tokens (lexical: share of the task's
    tokens) or trigrams of the name (semantic: Jaccard); of each channel the `limit` best of a task. Equi-joins on
    names, tokens and trigrams; tasks are a stated set, so their terms are few beside the nodes'.

    A score depends on name and content alone, so it is made once for the nodes that have both in common, and of these only
    the first `limit` by id are looked at: no later one can be among a task's `limit` best."""
    least = _by_text(nodes, limit)
    texts = least.where("id = text").select("id", "name", "content")
    found = _scores(tasks, texts).withColumnRenamed("id", "text")
    got = _first(found.join(least.select("text", "id"), "text"), ["task", "channel"], limit, F.desc("score"), F.col("id"))
    return got.select("task", "id", "channel", "score")


def _by_text(nodes: DataFrame, limit: int) -> DataFrame:
    """id, name, content, text: the first `limit` nodes by id of each name and content; text is the first one's id."""
    said = nodes.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("content", F.lit("")).alias("content"))
    first = _first(dealt(said, "id"), ["name", "content"], limit, F.col("id"))
    return table(first.withColumn("text", F.min("id").over(Window.partitionBy("name", "content"))), "texts")


def _scores(tasks: DataFrame, texts: DataFrame) -> DataFrame:
    """task, id, channel, score of texts (id, name, content) in the three channels, without a cap."""
    q = tasks.select("task", T.tokens(F.col("task")).alias("t"), T.trigrams(F.col("task")).alias("g"))
    n = texts.select("id", "name", T.tokens(F.concat_ws(" ", "name", "content")).alias("t"), T.trigrams(F.col("name")).alias("g"))
    exact = texts.select("id", F.lower(F.trim("name")).alias("key")).join(tasks.select("task", F.lower(F.trim("task")).alias("key")), "key").select("task", "id", F.lit("exact").alias("channel"), F.lit(1.0).alias("score"))
    words = q.select("task", F.size("t").alias("n"), F.explode("t").alias("w")).join(n.select("id", F.explode("t").alias("w")), "w")
    lexical = words.groupBy("task", "id", "n").agg(F.count("*").alias("c")).select("task", "id", F.lit("lexical").alias("channel"), F.round(F.col("c") / F.col("n"), 6).alias("score"))
    grams = q.select("task", F.size("g").alias("n"), F.explode("g").alias("w")).join(n.select("id", F.size("g").alias("m"), F.explode("g").alias("w")), "w")
    near = grams.groupBy("task", "id", "n", "m").agg(F.count("*").alias("c")).select("task", "id", F.lit("semantic").alias("channel"), F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("score"))
    return exact.unionByName(lexical).unionByName(near)


#: Weights of channels where candidates are fused; exact ones get a bonus.
WEIGHTS = {"exact": 0.20, "lexical": 0.20, "semantic": 0.20, "recent": 0.10, "graph": 0.05}


def hybrid(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, admitted: Column, seeds: int = 10, limit: int = 25, keep: int = 20) -> DataFrame:
    """Five channels (exact, lexical, semantic, recent, graph), admission of nodes by `admitted` (of their columns),
    fusion, expansion of the best `seeds`, and the order of the result: task, id, score, place, sources."""
    ok = shuffled(table(dealt(nodes.where(admitted), "id"), "nodes"))  # read about ten times below
    cands = table(channels(tasks, ok, limit), "channels")
    recent = _first(ok.where("revision is not null").select("id", "revision").join(sent(cands.select("task", "id").distinct()), "id"), ["task"], limit, F.desc("revision"), F.col("id"))
    cands = table(cands.unionByName(recent.select("task", "id", F.lit("recent").alias("channel"), F.lit(1.0).alias("score"))), "channels")
    fuse = lambda c: R.fuse_channels(c.withColumn("key", F.struct("task", "id")), "key", "channel", "score", WEIGHTS, bonus=("exact",)).select("key.task", "key.id", F.round("fused", 6).alias("score"))
    first = _first(fuse(cands), ["task"], seeds, F.desc("score"), F.col("id"))
    places = first.select("task", "id", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "id")).alias("place"))
    graph = expand(places, ok, edges).select("task", "id", F.lit("graph").alias("channel"), "score")
    every = table(cands.unionByName(graph), "candidates")
    sources = every.groupBy("task", "id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"))
    out = fuse(every).join(sources, ["task", "id"])
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "id")))
    return out.where(F.col("place") <= keep).select("task", "id", "score", F.col("place").cast("long").alias("place"), "sources")


def status_of(tasks: DataFrame, cands: DataFrame, asks_exact: Column) -> DataFrame:
    """task, status of every task, from its candidates by channel; a task without evidence is NONE and plans nothing."""
    n = lambda c: F.count_if(F.col("channel") == c)
    per = cands.groupBy("task").agg(n("exact").alias("e"), n("lexical").alias("l"), F.max(F.when(F.col("channel") == "lexical", F.col("score"))).alias("top"), n("graph").alias("g"))
    c = lambda x: F.coalesce(x, F.lit(0))
    return tasks.join(per, "task", "left").select("task", evidence_status(c("e"), c("l"), c("top"), c("g"), asks_exact).alias("status"))


def plan(fused: DataFrame, status: DataFrame, k_min: int = 5, k_max: int = 25, least: int = 3, target: float = 0.70, gap: float = 0.05) -> DataFrame:
    """task, id, score, place of what a plan keeps: candidates (task, id, score) up to an entropy-scaled k, then up to
    the first place after `least` with a score of `target` and a gap under `gap`; none where the status is NONE."""
    sound = fused.join(status.where("status <> 'NONE'").select("task"), "task", "left_semi")
    e = R.softmax_entropy(sound, "score", 1.0, ["task"]).select("task", R.adaptive_k(F.col("n"), F.col("entropy"), k_min, k_max).alias("k"))
    w = Window.partitionBy("task").orderBy(F.desc("score"), "id")
    r = sound.withColumn("place", F.row_number().over(w)).join(e, "task").where(F.col("place") <= F.col("k"))
    r = r.withColumn("_next", F.lead("score").over(w)).withColumn("_m", F.count("*").over(Window.partitionBy("task")))
    stops = (F.col("place") > least) & (F.col("place") < F.col("_m")) & (F.least("score", F.lit(1.0)) >= target) & (F.col("score") - F.col("_next") < gap)
    r = r.withColumn("_stop", F.min(F.when(stops, F.col("place"))).over(Window.partitionBy("task")))
    return r.where(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop"))).select("task", "id", "score", F.col("place").cast("long").alias("place"))


def exhaustive(tasks: DataFrame, nodes: DataFrame, least: float = 0.05, limit: int = 100) -> DataFrame:
    """task, id, score: 0.6 of the semantic and 0.4 of the lexical score over all nodes, from `least`, `limit` best; what
    indexed retrieval is compared with. As in `channels`, a score is made once for nodes of one name and content."""
    first = _by_text(nodes, limit)
    c = _scores(tasks, first.where("id = text").select("id", "name", "content")).where("channel <> 'exact'")
    s = c.groupBy("task", "id").agg(F.round(F.sum(F.when(F.col("channel") == "semantic", 0.6 * F.col("score")).otherwise(0.4 * F.col("score"))), 6).alias("score"))
    s = s.where(F.col("score") >= least).withColumnRenamed("id", "text").join(first.select("text", "id"), "text").select("task", "id", "score")
    return _first(s, ["task"], limit, F.desc("score"), F.col("id"))


def diagnose(ranked: DataFrame, targets: DataFrame, deep: int = 10) -> DataFrame:
    """task, place, diagnosis of targets (task, id) in ranked lists (task, id, place)."""
    j = targets.join(ranked.select("task", "id", "place"), ["task", "id"], "left")
    d = F.when(F.col("place").isNull(), "candidate_generation_failure").when(F.col("place") > deep, "ranking_failure").otherwise("success")
    return j.select("task", "id", "place", d.alias("diagnosis"))


def expand_until_sufficient(seeds: DataFrame, edges: DataFrame, holds: DataFrame, required: list[str], least: float, rounds: int = 3, depth: int = 2) -> DataFrame:
    """id, round: evidence from seeds (id), grown along edges by `depth` steps a round until the pool's terms (holds: id,
    term) cover `least` of the required ones, `rounds` rounds at most. Coverage is one row; only it decides."""
    from millrace.operators.graph import closure

    pool = seeds.select("id", F.lit(0).alias("round")).distinct()
    for r in range(1, rounds + 1):
        n = holds.join(pool.select("id"), "id", "left_semi").where(F.col("term").isin(required)).agg(F.countDistinct("term").alias("n")).first()["n"]
        if n >= least * len(required):
            break
        reached = closure(edges, pool.select("id"), depth).select("id")
        pool = pool.unionByName(reached.join(pool, "id", "left_anti").select("id", F.lit(r).alias("round")))
    return pool


def weighted_coverage(requirements: DataFrame, acquired: DataFrame) -> DataFrame:
    """key, coverage, missing, conflict. requirements: key, need, weight; acquired: key, need, weight, conflict. A need is
    met by evidence of positive weight that is not in conflict; conflict is the share of evidence that is."""
    good = acquired.where("weight > 0 and not conflict").select("key", "need").distinct().withColumn("_met", F.lit(1))
    c = requirements.join(good, ["key", "need"], "left").groupBy("key").agg(F.sum("weight").alias("_w"), F.sum(F.when(F.col("_met") == 1, F.col("weight")).otherwise(0)).alias("_s"), F.count_if(F.col("_met").isNull()).alias("missing"))
    bad = acquired.groupBy("key").agg(F.avg(F.col("conflict").cast("int")).alias("conflict"))
    cover = F.when(F.col("_w") > 0, F.col("_s") / F.col("_w")).otherwise(1.0)
    return c.join(bad, "key", "left").select("key", cover.alias("coverage"), "missing", F.coalesce("conflict", F.lit(0.0)).alias("conflict"))


def conflicts(evidence: DataFrame, on: str = "enable_", off: str = "disable_") -> DataFrame:
    """bundle, a, b, kind: pairs of one bundle (bundle, ord, content, revision; a bundle is one answer's short list), the
    first of which sets a flag that the second clears, or whose revisions differ."""
    e = evidence.select("bundle", "ord", F.lower("content").contains(on).alias("on"), F.lower("content").contains(off).alias("off"), "revision")
    a, b = (e.select("bundle", *[F.col(c).alias(f"{c}_{s}") for c in ("ord", "on", "off", "revision")]) for s in "ab")
    p = a.join(b, "bundle").where("ord_a < ord_b")
    kinds = F.array_compact(F.array(F.when(F.col("on_a") & F.col("off_b"), "feature_flag"), F.when(F.col("revision_a") != F.col("revision_b"), "superseded_revision")))
    return p.select("bundle", F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), F.explode(kinds).alias("kind"))


def compact(postings: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Postings (segment, id, term, tf) of all segments in one, without deleted documents (segment, id), the newest
    segment of a document counting."""
    live = postings.join(tombstones, ["segment", "id"], "left_anti")
    newest = live.groupBy("id").agg(F.max("segment").alias("segment"))
    return live.join(newest, ["segment", "id"]).select("id", "term", "tf")


def search_shards(postings: DataFrame, terms: list[str], k: int, shards: int = 2) -> DataFrame:
    """shard, id, score (summed tf) of the k best documents of the shards that hold most of the terms' postings."""
    hits = postings.where(F.col("term").isin(terms))
    route = hits.groupBy("shard").agg(F.countDistinct("term").alias("_t"), F.sum("tf").alias("_tf")).orderBy(F.desc("_t"), F.desc("_tf"), "shard").limit(shards)
    s = hits.join(F.broadcast(route.select("shard")), "shard", "left_semi").groupBy("shard", "id").agg(F.sum("tf").alias("score"))
    return s.orderBy(F.desc("score"), "shard", "id").limit(k)


def glob(pattern: str) -> str:
    """A path pattern as a regular expression: ** any folders, * within one, ? one character; a plain name is a prefix."""
    if not any(c in pattern for c in "*?"):
        return "^" + _quoted(pattern.rstrip("/")) + "(/|$)"
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], _quoted(pattern[i])), i + 1
    return f"^{out}$"


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "_/-" else c for c in s)


def by_globs(path: Column, deny: list[str], allow: list[str], otherwise: Column) -> Column:
    """Eligible: not by a deny pattern, else by an allow pattern, else as otherwise."""
    any_of = lambda ps: path.rlike("|".join(glob(p) for p in ps)) if ps else F.lit(False)
    return F.when(any_of(deny), False).when(any_of(allow), True).otherwise(otherwise)


def cache_tier(age: Column, same: Column, memory: int = 300, disk: int = 3600) -> Column:
    """Where an entry of this age in seconds is found; one of another revision or model, or none, is missed."""
    return F.when(age.isNull() | ~same, "miss").when(age <= memory, "memory").when(age <= disk, "disk").otherwise("miss")


def synergy(rows: DataFrame, group: str) -> DataFrame:
    """group, a, b, synergy: U(ab) - U(a) - U(b) for pairs of a short list (group, id, words), U being the number of
    distinct words covered; it is never positive, and 0 for items that complement each other."""
    a, b = (rows.select(group, F.col("id").alias(s), F.col("words").alias(f"w{s}")) for s in "ab")
    return a.join(b, group).where("a < b").select(group, "a", "b", (-F.size(F.array_intersect("wa", "wb"))).cast("long").alias("synergy"))


def curvature(rows: DataFrame, group: str) -> DataFrame:
    """group, curvature: 1 - the least share of an item's words that no other item of its short list has."""
    w = rows.select(group, "id", F.size("words").alias("n"), F.explode("words").alias("w"))
    alone = w.groupBy(group, "w").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy(group, "id").agg(F.count("*").alias("own"))
    per = rows.where(F.size("words") > 0).select(group, "id", F.size("words").alias("n")).join(alone, [group, "id"], "left")
    return per.groupBy(group).agg((1 - F.min(F.coalesce("own", F.lit(0)) / F.col("n"))).alias("curvature"))


def max_score_topk(hits: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """key, score of the k best by summed weight, with MaxScore pruning. hits: key, term, weight; bounds: term, most (one
    row a term of the query). The rarest half of the terms are scored first; the k-th best of them is a threshold, and
    documents that cannot reach it with all that is left are not scored further."""
    order = Window.orderBy(F.desc("most"), "term")  # a query's few terms
    b = bounds.withColumn("_n", F.row_number().over(order)).withColumn("_half", F.ceil(F.count("*").over(Window.partitionBy()) / 2))
    h = hits.join(F.broadcast(b.select("term", (F.col("_n") <= F.col("_half")).alias("_first"))), "term")
    left = b.where("_n > _half").agg(F.coalesce(F.sum("most"), F.lit(0.0)).alias("_left"))
    per = h.groupBy("key").agg(F.sum(F.when(F.col("_first"), F.col("weight")).otherwise(0.0)).alias("_s"))
    least = per.orderBy(F.desc("_s")).limit(k).agg(F.when(F.count("*") == k, F.min("_s")).otherwise(0.0).alias("_least"))
    live = per.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(least)).where(F.col("_s") + F.col("_left") >= F.col("_least")).select("key")
    return h.join(live, "key", "left_semi").groupBy("key").agg(F.sum("weight").alias("score"))


def prefer(df: DataFrame, choice: Column) -> DataFrame:
    """The rows of the best choice (an integer, the lowest) that any row has: one look-up that falls back on the next."""
    rows = df.withColumn("_choice", choice).where(F.col("_choice").isNotNull())
    best = rows.agg(F.min("_choice").alias("_best"))  # one row
    return rows.join(F.broadcast(best), F.col("_choice") == F.col("_best")).drop("_choice", "_best")


def by_basename(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose file has this name, whatever the case; sources before tests."""
    base = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    return prefer(nodes.where(base == name.lower()), F.when(F.col("path").endswith("_test.go"), 1).otherwise(0))


def by_path(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes at a path or below it, else those whose path holds it."""
    return prefer(nodes, F.when((F.col("path") == path) | F.col("path").startswith(path + "/"), 0).when(F.col("path").contains(path), 1))


def by_package(nodes: DataFrame, package: str) -> DataFrame:
    """Nodes in a folder whose name ends so, or in a file of that name."""
    p = F.lower("path")
    return nodes.where(p.contains(package.lower() + "/") | p.contains("/" + package.lower() + "."))
