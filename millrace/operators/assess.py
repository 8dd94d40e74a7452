"""Assessment of tasks and of the evidence found for them: task profiles, contracts, layers of sufficiency, calibrated
confidence, the value of the next action, stop rules and task-aware order, as Columns and equi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.work import table

#: Words that raise the risk of a task, its ambiguity, scope and depth, with what each group adds.
RISK = ((("auth", "security", "permission"), 0.4), (("race", "deadlock", "concurrency"), 0.4), (("delete", "drop", "migrate"), 0.3))
AMBIGUITY = ((("how", "why", "investigate"), 0.3), (("maybe", "perhaps", "check"), 0.2))
SCOPE = ((("refactor", "redesign", "architecture"), 15), (("distributed", "consensus", "engine"), 15))
DEEP = ("trace", "callers", "graph", "distributed", "consensus")
LOOKUPS = ("where is", "find definition", "find symbol", "find callers", "find implementations", "find where", "find block size", "locate", "list imports", "get method", "callers of")
#: Weights of a task's difficulty, its classes from easy to hard with their tool calls.
DIFFICULTY = {"scope": 0.20, "depth": 0.15, "ambiguity": 0.20, "novelty": 0.15, "risk": 0.20, "history": 0.10}
CLASSES = (("T1", 0.25, 1), ("T2", 0.50, 3), ("T3", 0.75, 6), ("T4", None, 12))
FILE = r"[A-Za-z0-9_-]+\.(?:go|ts|js|py|rs|c|cpp|h|md|json|yaml|yml|sql)(?:[^A-Za-z0-9_]|$)"
SYMBOL = r"(?:^|[^A-Za-z0-9_])(?:func|type|class|interface|struct)\s+[A-Za-z0-9_]+"


def _one() -> Column:
    return F.lit(1.0)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _raised(start: Column, text: Column, groups: tuple) -> Column:
    return reduce(lambda a, g: a + F.when(_any(text, g[0]), F.lit(g[1])).otherwise(F.lit(type(g[1])(0))), groups, start)


def task_profile(task: Column, history: Column | None = None) -> Column:
    """Struct of a task's features, difficulty, class (T0 needs no model) and expected tool calls. A null task counts as empty."""
    task = F.coalesce(task, F.lit(""))
    history = F.lit(0.0) if history is None else history
    low, tokens = F.lower(task), T.estimate_tokens(task)
    files, symbols = F.regexp_count(task, F.lit(FILE)), F.regexp_count(task, F.lit(SYMBOL))
    ambiguity = F.least(_one(), _raised(0.2 + F.when(tokens < 10, 0.3).otherwise(0.0), low, AMBIGUITY))
    risk = F.least(_one(), _raised(F.lit(0.1), low, RISK))
    scope = F.greatest(F.lit(1), _raised(files * 5 + symbols * 3 + F.floor(tokens / 50), low, SCOPE))
    depth = F.when(_any(low, DEEP), 4).when((files > 2) | (symbols > 2), 3).otherwise(1)
    novelty = F.when(history > 0, 0.5 * (1 - history)).otherwise(0.3)
    part = {"scope": F.least(_one(), scope / 50), "depth": depth / 5, "ambiguity": ambiguity, "novelty": novelty, "risk": risk, "history": history}
    difficulty = F.round(F.greatest(F.lit(0.0), F.least(_one(), reduce(lambda a, b: a + b, [w * part[k] for k, w in DIFFICULTY.items()]))), 9)
    bypass = reduce(lambda a, b: a | b, [low.startswith(w) for w in LOOKUPS]) & (files <= 2)
    cls, calls = F.when(bypass, "T0"), F.when(bypass, 0)
    for name, below, n in CLASSES:
        fits = F.lit(True) if below is None else difficulty < below
        cls, calls = cls.when(fits, name), calls.when(fits, n)
    out = {"files": files.cast("long"), "symbols": symbols.cast("long"), "scope": scope.cast("long"), "depth": depth, "risk": F.round(risk, 6), "ambiguity": F.round(ambiguity, 6), "difficulty": difficulty, "class": cls, "calls": calls}
    return F.struct(*[c.alias(k) for k, c in out.items()])


#: Words by which a task's kind is told, edges from which it counts so, complexity, penalty of failure, least and largest budget.
KINDS = (
    ("architectural_migration", ("architect", "migrat", "redesign"), 15, 0.90, 10.0, 2048, 8192),
    ("cross_file_refactor", ("refactor", "cross-file"), 5, 0.65, 5.0, 1024, 4096),
    ("local_edit", ("fix", "bug", "test"), None, 0.40, 3.0, 512, 2048),
    ("simple_lookup", None, None, 0.20, 1.5, 256, 1024),
)
STEP = 256
TOKEN_PRICE = 0.000003


def task_budget(task: Column, edges: Column, uncertainty: Column) -> Column:
    """Struct kind, penalty, least, most, budget: the budget grows with complexity and uncertainty, in steps of 256 tokens."""
    low, out = F.lower(F.coalesce(task, F.lit(""))), None
    for kind, words, deps, base, penalty, least, most in KINDS:
        fits = F.lit(True) if words is None else _any(low, words)
        fits = fits if deps is None else fits | (edges > deps)
        raw = F.round((least + (most - least) * (0.6 * base + 0.4 * uncertainty)) / STEP) * STEP
        budget = F.greatest(F.lit(least), F.least(F.lit(most), raw)).cast("long")
        row = F.struct(F.lit(kind).alias("kind"), F.lit(penalty).alias("penalty"), F.lit(least).cast("long").alias("least"), F.lit(most).cast("long").alias("most"), budget.alias("budget"))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def early_stop_pack(items: Column, plan: Column, uncertainty: Column) -> Column:
    """items: array<struct<.., id, tokens, confidence>> in order; plan: of task_budget. Struct<spent, taken, done>: what fits
    is taken until an item is worth less than its tokens cost, once the least budget is spent."""

    def step(a, x):
        fits = ~a["done"] & (a["spent"] + x["tokens"] <= plan["budget"])
        stop = fits & (x["confidence"] * (1 - uncertainty * 0.5) * plan["penalty"] * 0.001 < TOKEN_PRICE * x["tokens"]) & (a["spent"] >= plan["least"])
        take = fits & ~stop
        return F.struct(F.when(take, a["spent"] + x["tokens"]).otherwise(a["spent"]).alias("spent"), (a["taken"] + take.cast("long")).alias("taken"), (a["done"] | stop).alias("done"))

    zero = F.lit(0).cast("long")
    return F.aggregate(items, F.struct(zero.alias("spent"), zero.alias("taken"), F.lit(False).alias("done")), step)


def contract(tasks: DataFrame, evidence: DataFrame, required: DataFrame, claims: DataFrame) -> DataFrame:
    """What evidence (task, id, path, text, conflict, stale) meets of the paths (required: task, path) and claims (claims:
    task, claim) of each task: a row for each task with the inputs of `layers` and of the answer gate.

    Paths are compared without case. A claim is met by evidence that holds half of its words; it is supported from 0.6, and
    contradicted if evidence in conflict meets it. Repeated paths and claims count once.
    """
    per = evidence.groupBy("task").agg(F.count("*").alias("evidence"), F.bool_or("conflict").alias("conflict"), F.bool_or("stale").alias("stale"))
    want = required.select("task", F.lower("path").alias("path")).distinct()
    there = evidence.select("task", F.lower("path").alias("path")).distinct().withColumn("there", F.lit(1))
    r = want.join(there, ["task", "path"], "left").groupBy("task").agg(F.count("*").alias("required"), F.count("there").alias("matched"))
    c = claims.select("task", "claim").distinct().withColumn("w", T.tokens(F.col("claim")))
    words = c.select("task", "claim", F.size("w").alias("n"), F.explode("w").alias("term"))
    held = evidence.select("task", "id", "conflict", F.explode(T.tokens(F.col("text"))).alias("term"))
    o = words.join(held, ["task", "term"]).groupBy("task", "claim", "id", "conflict").agg((F.count("*") / F.max("n")).alias("o"))
    best = o.groupBy("task", "claim").agg(F.max("o").alias("best"), F.bool_or(F.col("conflict") & (F.col("o") >= 0.5)).alias("bad"))
    j = c.join(best, ["task", "claim"], "left").select("task", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("bad", F.lit(False)).alias("bad"))
    share = lambda x: F.avg(x.cast("int"))
    q = j.groupBy("task").agg(F.count("*").alias("claims"), F.count_if(F.col("best") < 0.5).alias("missing"), share(F.col("best") >= 0.5).alias("coverage"), share((F.col("best") >= 0.6) & ~F.col("bad")).alias("precision"), share((F.col("best") < 0.6) & ~F.col("bad")).alias("unsupported"), share(F.col("bad")).alias("contradicted"))
    out = tasks.select("task").distinct().join(per, "task", "left").join(r, "task", "left").join(q, "task", "left")
    zero = {k: 0 for k in ("evidence", "required", "matched", "claims", "missing")}
    return out.fillna(zero | {"coverage": 1.0, "precision": 1.0, "unsupported": 0.0, "contradicted": 0.0, "conflict": False, "stale": False})


#: Weights of the layers.
LAYERS = {"existence": 0.15, "semantic": 0.25, "dependency": 0.20, "contradiction": 0.15, "provenance": 0.10, "readiness": 0.15}
ENOUGH = 0.80


def layers() -> Column:
    """Struct composite, sufficient, failure (the layer that failed, else null) of a row of `contract`. Without evidence, or
    without any required path, nothing else counts; staleness is told before conflict."""
    absent = (F.col("evidence") == 0) | ((F.col("required") > 0) & (F.col("matched") == 0))
    dependency = F.when(F.col("required") > 0, F.col("matched") / F.col("required")).otherwise(1.0)
    ready = (F.col("missing") == 0) & (F.col("coverage") >= ENOUGH)
    part = {"existence": _one(), "semantic": F.col("coverage"), "dependency": dependency, "contradiction": (~F.col("conflict")).cast("double"), "provenance": (~F.col("stale")).cast("double"), "readiness": ready.cast("double")}
    composite = F.when(absent, 0.0).otherwise(reduce(lambda a, b: a + b, [w * part[k] for k, w in LAYERS.items()]))
    failure = F.when(absent, "existence").when(F.col("stale"), "provenance").when(F.col("conflict"), "contradiction").when(F.col("coverage") < ENOUGH, "semantic").when(dependency < ENOUGH, "dependency").when(~ready, "readiness")
    return F.struct(F.round(composite, 6).alias("composite"), failure.isNull().alias("sufficient"), failure.alias("failure"))


def ladder(tasks: DataFrame, evidence: DataFrame, required: DataFrame, claims: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """The least prefix of each task's evidence that suffices: contexts nested in order of place, each judged by `layers`.

    evidence: task, id, place (1.. in order), path, text, tokens, conflict, stale; required and claims as for `contract`.
    A row for each task with evidence: rung (the first whose layers suffice with a composite of `enough`, else the last),
    rungs, tokens of it, compression (all tokens by these), composite, sufficient, minimality (the share of the rung's
    pieces that cannot be left out without a lower composite or losing sufficiency).

    Nothing is judged again from the start: what a rung covers is a running sum over the places where each path, claim,
    conflict or stale piece first appears, and what a piece alone covers is what has one provider up to the rung.
    """
    e = evidence.select("task", "id", "place", F.lower("path").alias("path"), "text", "tokens", "conflict", "stale")
    paths = required.select("task", F.lower("path").alias("path")).distinct()
    wants = claims.select("task", "claim").distinct().withColumn("w", T.tokens(F.col("claim")))
    words = wants.select("task", "claim", F.size("w").alias("n"), F.explode("w").alias("term"))
    held = e.select("task", "place", F.explode(T.tokens(F.col("text"))).alias("term"))
    meets = words.join(held, ["task", "term"]).groupBy("task", "claim", "place").agg((F.count("*") / F.max("n")).alias("o")).where("o >= 0.5").select("task", F.concat(F.lit("c "), "claim").alias("what"), "place")
    has = paths.join(e.select("task", "path", "place"), ["task", "path"]).select("task", F.concat(F.lit("p "), "path").alias("what"), "place").distinct()
    gives = table(meets.unionByName(has), "gives")  # task, what (a claim or path), place of each piece that provides it
    first = gives.groupBy("task", "what").agg(F.min("place").alias("place"))
    new = first.groupBy("task", "place").agg(F.count_if(F.col("what").startswith("c ")).alias("new_claims"), F.count_if(F.col("what").startswith("p ")).alias("new_paths"))
    asked = tasks.select("task").distinct().join(paths.groupBy("task").agg(F.count("*").alias("required")), "task", "left").join(wants.groupBy("task").agg(F.count("*").alias("claims")), "task", "left").fillna({"required": 0, "claims": 0})
    upto = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rungs = e.join(new, ["task", "place"], "left").join(asked, "task").fillna({"new_claims": 0, "new_paths": 0})
    run = lambda c: F.sum(c).over(upto)
    rungs = rungs.select("task", "place", "required", "claims", F.count("*").over(upto).alias("evidence"), run("new_paths").alias("matched"), run("new_claims").alias("met"), run(F.col("conflict").cast("int")).alias("conflicts"), run(F.col("stale").cast("int")).alias("stales"), run("tokens").alias("tokens"))
    judged = table(_judged(rungs).select("*", ((F.col("l.composite") >= enough) & F.col("l.sufficient")).alias("enough")), "rungs")
    at = judged.groupBy("task").agg(F.coalesce(F.min(F.when(F.col("enough"), F.col("place"))), F.max("place")).alias("place"), F.count("*").alias("rungs"), F.max("tokens").alias("full"))
    base = judged.join(at, ["task", "place"]).withColumnRenamed("place", "rung")
    inside = gives.join(base.select("task", "rung"), "task").where("place <= rung")
    alone = inside.groupBy("task", "what").agg(F.count("*").alias("c"), F.min("place").alias("place")).where("c = 1")
    own = alone.groupBy("task", "place").agg(F.count_if(F.col("what").startswith("c ")).alias("own_claims"), F.count_if(F.col("what").startswith("p ")).alias("own_paths"))
    less = base.withColumn("was", F.col("l")).drop("l").join(e.select("task", "place", "conflict", "stale"), "task").where("place <= rung").join(own, ["task", "place"], "left").fillna({"own_claims": 0, "own_paths": 0})
    less = less.select("task", "required", "claims", "was", (F.col("evidence") - 1).alias("evidence"), (F.col("matched") - F.col("own_paths")).alias("matched"), (F.col("met") - F.col("own_claims")).alias("met"), (F.col("conflicts") - F.col("conflict").cast("int")).alias("conflicts"), (F.col("stales") - F.col("stale").cast("int")).alias("stales"))
    needed = _judged(less).groupBy("task").agg(F.avg(((F.col("l.composite") < F.col("was.composite")) | ~F.col("l.sufficient")).cast("int")).alias("minimality"))
    return base.join(needed, "task").select("task", "rung", "rungs", "tokens", F.when(F.col("tokens") > 0, F.col("full") / F.col("tokens")).otherwise(1.0).alias("compression"), "l.composite", "l.sufficient", "minimality")


def _judged(rows: DataFrame) -> DataFrame:
    """rows with l: the layers of counts (evidence, required, matched, claims, met, conflicts, stales)."""
    r = rows.withColumn("conflict", F.col("conflicts") > 0).withColumn("stale", F.col("stales") > 0).withColumn("missing", F.col("claims") - F.col("met"))
    return r.withColumn("coverage", F.when(F.col("claims") > 0, F.col("met") / F.col("claims")).otherwise(1.0)).withColumn("l", layers()).drop("conflict", "stale", "missing", "coverage")


def calibrated(confidence: Column, difficulty: Column, coverage: Column, conflict: Column) -> Column:
    """Confidence less what is not covered, in conflict or hard, shrunk by a quarter towards one half."""
    c = confidence - 0.40 * (1 - coverage) - 0.35 * conflict - 0.20 * difficulty
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), 0.75 * c + 0.25 * 0.50)), 9)


def residual_risk(confidence: Column, task_risk: Column) -> Column:
    return F.round(F.least(_one(), F.greatest(F.lit(0.0), 1 - confidence) * (0.5 + 0.5 * task_risk)), 9)


#: Dollars, seconds and least dollars left of each action; prices of a dollar, a second and risk.
ACTIONS = {"retrieve": (0.015, 0.2, 0.02), "think": (0.08, 2.5, 0.05), "verify": (0.035, 0.8, 0.03), "escalate": (0.25, 4.0, 0.20)}
PRICES = (1.0, 0.05, 2.0)
THINK_TOKENS = 2048


def best_action(confidence: Column, risk: Column, coverage: Column, difficulty: Column, dollars: Column, tokens: Column, hit: Column, penalty: Column) -> Column:
    """Struct voi, action: the action that is open and raises utility most, the first of equals; stop if none raises it.
    `hit` and `penalty`: probability that a cached prefix is met, and the dollars that thinking costs where it is not."""
    gap = 1 - coverage
    effect = {  # open, gain of confidence, risk kept, further cost
        "retrieve": (coverage < 0.90, 0.35 * gap, 1 - 0.6 * gap, F.lit(0.0)),
        "think": (tokens >= THINK_TOKENS, coverage * (0.10 + 0.30 * difficulty), F.lit(0.7), (1 - hit) * penalty),
        "verify": ((coverage >= 0.65) & (risk > 0.10), F.lit(0.05), F.lit(0.25), F.lit(0.0)),
        "escalate": (difficulty > 0.60, 0.30 * difficulty, F.lit(0.4), F.lit(0.0)),
    }
    row = lambda v, name, n: F.struct(v.alias("voi"), F.lit(-n).alias("_first"), F.lit(name).alias("action"))
    rows = [row(F.lit(0.0), "stop", 0)]
    for n, (name, (open_, gain, kept, more)) in enumerate(effect.items(), 1):
        cost, seconds, least = ACTIONS[name]
        voi = F.least(F.lit(0.99), confidence + gain) - confidence - PRICES[0] * cost - PRICES[1] * seconds + PRICES[2] * risk * (1 - kept) - more
        rows.append(F.when(open_ & (dollars >= least), row(F.round(voi, 9), name, n)))
    return F.array_max(F.array_compact(F.array(*rows)))


def stop_reason(turns: Column, dollars: Column, risk: Column, coverage: Column, confidence: Column, voi: Column, most_turns: int = 15, target: float = 0.05) -> Column:
    """Why a loop of actions ends here, else null."""
    return F.when(turns >= most_turns, "turns").when(dollars <= 0.01, "budget").when((risk <= target) & (coverage >= 0.85) & (voi <= 0), "target").when((voi <= 0) & (confidence >= 0.70), "returns")


NEGATIONS = ("not", "never", "no", "without", "exclude", "except")
ARTIFACTS = ("policy", "config", "schema", "test", "doc")


def represent(task: Column) -> Column:
    """Struct entities (array<struct<name, salience>>), identifiers, artifacts, negations and intent of a task's text. An
    identifier has a digit or an underscore after its first letter; what follows a word of negation is negated."""
    low = F.lower(F.coalesce(task, F.lit("")))
    words = T.tokens(low)
    negated = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?:^|\s)(?:{'|'.join(NEGATIONS)})\s+([a-z0-9_]+)"), F.lit(1)))
    kept = F.filter(words, lambda w: ~w.isin(*NEGATIONS) & (F.length(w) >= 3) & ~F.exists(negated, lambda n: w.contains(n)))
    named = lambda w: w.rlike("^[a-z][a-z]*[0-9_]")
    entities = F.transform(F.filter(kept, lambda w: ~named(w)), lambda w: F.struct(w.alias("name"), F.least(_one(), F.length(w) / 8).alias("salience")))
    artifacts = F.filter(F.array(*[F.lit(a) for a in ARTIFACTS]), lambda a: F.array_contains(words, a))
    intent = F.when(F.array_contains(words, "test"), "test").otherwise("lookup")
    return F.struct(entities.alias("entities"), F.filter(kept, named).alias("identifiers"), artifacts.alias("artifacts"), negated.alias("negations"), intent.alias("intent"))


def rerank(cands: DataFrame, asks: DataFrame, authority: float = 0.15, keep: int = 20) -> DataFrame:
    """task, id, score, place of candidates (task, id, path, name, text, score) by the asks (task, ask: of `represent`) of
    their tasks. Scores count to 1e-6, equal ones go by path and id."""
    c = cands.join(asks.select("task", "ask"), "task")
    path, body, name = F.lower("path"), F.lower("text"), F.lower("name")
    place = lambda w, near, far: F.when(path.contains(w), near).when(body.contains(w), far).otherwise(0.0)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    bonus = total(F.col("ask.entities"), lambda x: x["salience"] * place(x["name"], 0.35, 0.20)) + total(F.col("ask.identifiers"), lambda x: place(x, 0.30, 0.15)) + total(F.col("ask.artifacts"), lambda x: F.when(path.contains(x), 0.25).otherwise(0.0))
    test = path.rlike(r"_test\.go$|/test/")
    mode = F.when(test & (F.col("ask.intent") == "test"), 0.20).when(test, -0.15).otherwise(0.0)
    trust = F.when(test, 0.5).when(path.rlike("/mock/|distractor|override"), 0.3).otherwise(1.0)
    hit = F.exists("ask.negations", lambda n: (F.length(n) >= 3) & (path.contains(n) | name.contains(n)))
    s = F.col("score") + bonus + mode + authority * trust
    out = c.select("task", "id", "path", F.round(F.when(hit, 0.05 * s).otherwise(s), 6).alias("score"))
    w = Window.partitionBy("task").orderBy(F.desc("score"), "path", "id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= keep).select("task", "id", "score", "place")


def stability(queries: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """family, queries, psi: the mean Jaccard index of the first k items of each pair of a family's queries.

    queries: family, query; ranked: query, item, place. A family of one query is stable, and so is a pair of empty lists;
    items count once, without case. The pairs are those of one family's list of paraphrases.
    """
    q = queries.select("family", "query").distinct()
    top = q.join(ranked.where(F.col("place") <= k).select("query", F.lower(F.col("item").cast("string")).alias("item")).distinct(), "query")
    size = q.join(top.groupBy("family", "query").agg(F.count("*").alias("n")), ["family", "query"], "left").fillna({"n": 0})
    side = lambda df, s, *cols: df.select("family", *[F.col(c).alias(c + s) for c in cols])
    pairs = side(size, "1", "query", "n").join(side(size, "2", "query", "n"), "family").where("query1 < query2")
    both = top.select("family", F.col("query").alias("query1"), "item").join(top.select("family", F.col("query").alias("query2"), "item"), ["family", "item"]).where("query1 < query2")
    both = both.groupBy("family", "query1", "query2").agg(F.count("*").alias("both"))
    p = pairs.join(both, ["family", "query1", "query2"], "left").fillna({"both": 0})
    union = F.col("n1") + F.col("n2") - F.col("both")
    mean = p.groupBy("family").agg(F.avg(F.when(union > 0, F.col("both") / union).otherwise(1.0)).alias("psi"))
    return q.groupBy("family").agg(F.count("*").alias("queries")).join(mean, "family", "left").fillna({"psi": 1.0})


_EXT = "go|py|ts|tsx|js|jsx|java|rs|rb|kt|swift|c|cc|cpp|h|hpp"
#: What a query asks for, by the first rule that its text meets; then three words are lexical and fewer conceptual.
QUERY_CLASSES = (
    ("path", rf"(?i)[\w.-]+(?:/[\w.-]+)*/[\w.-]+\.(?:{_EXT})(?:\W|$)"),
    ("file", rf"(?i)(?:^|[^\w/])[\w-]+\.(?:{_EXT})(?:\W|$)"),
    ("qualified_symbol", r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){2,}"),
    ("relation", r"(?i)(?:^|\W)(?:calls?|callers?|callees?|imports?|depends?|implements?|references?|uses)(?:\W|$)"),
    ("symbol", r"(?:^|\W)[A-Z]\w*[a-z]\w*[A-Z]\w*"),
    ("identifier", r"(?:^|\W)[a-z][a-z0-9]*(?:_[a-z0-9]+)+(?:\W|$)"),
    ("lexical", r"\S\s+\S+\s+\S"),
)


def query_class(text: Column) -> Column:
    """One of eight classes; a null or blank query is conceptual."""
    text = F.coalesce(text, F.lit(""))
    out = reduce(lambda a, r: a.when(text.rlike(r[1]), r[0]), QUERY_CLASSES[1:], F.when(text.rlike(QUERY_CLASSES[0][1]), QUERY_CLASSES[0][0]))
    return out.otherwise("conceptual")
