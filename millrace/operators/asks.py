"""What a query says: typed spans with salience from one pass over its tokens; its intent, contract and routing from those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of negation, kinds of artifacts, verbs of actions, articles between a negation and what it excludes.
NEGATIONS = ("not", "never", "no", "without", "exclude", "except", "prevent", "block", "deny", "disabled")
EXCLUDING = ("not", "never", "no", "without")
ARTIFACTS = ("policy", "workflow", "provider", "plan", "test", "config", "spec", "doc", "script", "handler", "helper")
ACTIONS = ("attach", "build", "call", "create", "debug", "delete", "filter", "find", "fix", "hydrate", "inspect", "remove", "route", "trace", "verify")
ARTICLES = ("a", "an", "the")
#: Intents by the parts of words that tell them, in order; the last is what is left.
INTENTS = (
    ("trace", ("trace", "call", "chain", "workflow", "flow")),
    ("policy", ("policy", "exclude", "prevent", "rule", "stop")),
    ("debug", ("why", "bug", "fail", "error", "issue", "debug")),
    ("test", ("test", "spec", "verify")),
    ("architecture", ("architecture", "design", "overview")),
    ("comparison", ("compare", "difference", "vs")),
    ("lookup", ()),
)
#: For each intent the weights of the channels lexical, semantic, symbol, path, entity, graph, of authority, the depth of expansion, the least score.
PROFILES = {
    "trace": (0.10, 0.15, 0.25, 0.15, 0.20, 0.15, 0.10, 3, 0.10),
    "policy": (0.15, 0.25, 0.15, 0.20, 0.20, 0.05, 0.15, 2, 0.15),
    "debug": (0.20, 0.25, 0.20, 0.10, 0.10, 0.15, 0.10, 2, 0.10),
    "architecture": (0.15, 0.25, 0.20, 0.25, 0.10, 0.05, 0.15, 2, 0.10),
    "test": (0.20, 0.15, 0.25, 0.25, 0.10, 0.05, 0.10, 1, 0.10),
    "comparison": (0.25, 0.30, 0.15, 0.15, 0.10, 0.05, 0.10, 1, 0.10),
    "lookup": (0.20, 0.20, 0.25, 0.25, 0.10, 0.00, 0.10, 1, 0.05),
}
CHANNELS = ("lexical", "semantic", "symbol", "path", "entity", "graph")
#: How much each kind of span says about what is asked for; a concept says more the longer it is, up to eight letters.
SALIENCE = {"path": 1.0, "entity": 1.0, "symbol": 0.9, "identifier": 0.8, "artifact": 0.6, "action": 0.5, "concept": 0.4, "negation": 0.0}
TOKEN = r"[A-Za-z0-9_](?:[A-Za-z0-9_./-]*[A-Za-z0-9_])?"
PATH = r"/|\.(?:go|py|rs|ts|js|java|md|json|yaml|yml|sql)$"
SYMBOL = r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$|^[a-z]+[A-Z]|^[A-Z][a-z0-9]+[A-Z]|^[A-Za-z_]+[0-9]"
ACRONYM = r"^[A-Z][A-Z]+$"


def _stem(low: Column) -> Column:
    """Without the ending of a plural."""
    return F.when(low.endswith("ies"), F.concat(F.expr("substring(low, 1, length(low) - 3)"), F.lit("y"))).when(low.endswith("s") & (F.length(low) > 3), F.expr("substring(low, 1, length(low) - 1)")).otherwise(low)


def spans(queries: DataFrame) -> DataFrame:
    """queries: query, text. query, at (0-based place of the token), token, kind, salience, negated.

    Kinds, the first that fits: negation, path, entity (an acronym), symbol, action, artifact, identifier (joined by an
    underscore or a dash), concept (four letters or more); other tokens give no span. What follows a word that excludes,
    articles left aside, is negated and weighs nothing."""
    tokens = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), 0)
    t = queries.select("query", F.posexplode(tokens).alias("at", "token"), tokens.alias("all"))
    before = lambda n: F.lower(F.get("all", F.col("at") - n))
    after = before(1).isin(*EXCLUDING) | (before(1).isin(*ARTICLES) & before(2).isin(*EXCLUDING))
    t = t.withColumn("low", F.lower("token")).withColumn("negated", F.coalesce((F.col("at") > 0) & after, F.lit(False)))
    stem = _stem(F.col("low"))
    kind = (
        F.when(F.col("low").isin(*NEGATIONS), "negation").when(F.col("token").rlike(PATH), "path").when(F.col("token").rlike(ACRONYM), "entity").when(F.col("token").rlike(SYMBOL), "symbol")
        .when(stem.isin(*ACTIONS), "action").when(stem.isin(*ARTIFACTS), "artifact").when(F.col("token").rlike("[_-]"), "identifier").when(F.length("token") >= 4, "concept")
    )
    t = t.withColumn("kind", kind).where("kind is not null")
    weight = reduce(lambda c, k: c.when(F.col("kind") == k, SALIENCE[k]), SALIENCE, F.when(F.lit(False), 0.0))
    weight = F.when(F.col("negated"), 0.0).when(F.col("kind") == "concept", SALIENCE["concept"] * F.least(F.lit(1.0), F.length("token") / 8)).otherwise(weight)
    return t.select("query", "at", "token", "kind", F.round(weight, 6).alias("salience"), "negated")


def contracts(queries: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """query, intent, paths, symbols, identifiers, actions, exclusions (distinct, in order), entities (of the most salience
    first, ten at most) and salience in all, from the spans; a query without spans has an empty contract."""
    s = found if found is not None else spans(queries)
    first = s.groupBy("query", "token", "kind", "negated").agg(F.min("at").alias("at"), F.max("salience").alias("salience"))
    names = lambda cond: F.transform(F.array_sort(F.filter(F.collect_list(F.when(cond, F.struct("at", "token"))), lambda x: x.isNotNull())), lambda x: x["token"])
    kind = lambda k: (F.col("kind") == k) & ~F.col("negated")
    entity = F.col("kind").isin("entity", "symbol", "identifier", "concept") & ~F.col("negated")
    ranked = F.transform(F.array_sort(F.filter(F.collect_list(F.when(entity, F.struct((-F.col("salience")).alias("less"), "at", "token"))), lambda x: x.isNotNull())), lambda x: x["token"])
    a = first.groupBy("query").agg(names(kind("path")).alias("paths"), names(kind("symbol")).alias("symbols"), names(kind("identifier")).alias("identifiers"), names(kind("action")).alias("actions"), names(F.col("negated")).alias("exclusions"), F.slice(ranked, 1, 10).alias("entities"), F.round(F.sum("salience"), 6).alias("salience"))
    low = F.lower(F.coalesce("text", F.lit("")))
    intent = reduce(lambda c, i: c.when(reduce(lambda x, y: x | y, [low.contains(w) for w in i[1]]), i[0]), INTENTS[:-1], F.when(F.lit(False), "")).otherwise(INTENTS[-1][0])
    empty = F.array().cast("array<string>")
    out = queries.select("query", intent.alias("intent")).join(a, "query", "left")
    return out.select("query", "intent", *[F.coalesce(c, empty).alias(c) for c in ("paths", "symbols", "identifiers", "actions", "exclusions", "entities")], F.coalesce("salience", F.lit(0.0)).alias("salience"))


def route(intents: DataFrame) -> DataFrame:
    """intents (with a column intent) and the weights of its profile: one of each channel, authority, depth and floor."""
    rows = [(k, *v) for k, v in PROFILES.items()]
    p = intents.sparkSession.createDataFrame(rows, "intent string, " + ", ".join(f"{c} double" for c in CHANNELS) + ", authority double, depth int, floor double")
    return intents.join(F.broadcast(p), "intent")  # seven rows
