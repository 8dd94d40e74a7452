"""Exploration policies: mutation, scoring of many policies at once, and a search over generations."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Risks from which a level of verification is asked, dollars that the model-based levels 3 and 4 need, the
#: spending of a task and its share for verification, and calls to tools beyond those that are expected.
LEVELS = (0.15, 0.40, 0.70)
CHEAP_CHECK, STRONG_CHECK = 0.005, 0.050
MOST_DOLLARS, RESERVE, SPARE_CALLS = 2.00, 0.20, 5


@dataclass(frozen=True)
class Model:
    """A model that a task may go to: the hardest difficulty it is trusted with, dollars for a million tokens in and out."""

    name: str
    capability: float
    dollars_in: float
    dollars_out: float


@dataclass(frozen=True)
class Policy:
    semantic: float = 1.15
    lexical: float = 1.00
    affinity: float = 0.90
    authority: float = 0.75
    reuse: float = 0.45
    graph: float = 0.35
    stale: float = 1.50
    prune: float = 0.0


#: Weight, frequency and size of its swing, sine or cosine, and bounds.
SWINGS = (
    ("semantic", math.sin, 1.13, 0.20, 0.5, 2.5),
    ("lexical", math.cos, 2.27, 0.20, 0.5, 2.0),
    ("graph", math.sin, 3.41, 0.15, 0.1, 1.5),
    ("affinity", math.cos, 4.59, 0.15, 0.2, 2.0),
    ("stale", math.sin, 5.73, 0.15, 0.5, 3.0),
    ("prune", math.cos, 6.89, 0.0025, 0.0, 0.10),
)


def mutate(p: Policy, seed: int, scale: float = 1.0) -> Policy:
    """A neighbour of the policy: each weight moves by a wave of the seed and stays in its bounds."""
    return replace(p, **{name: min(high, max(low, getattr(p, name) + wave(seed * rate) * size * scale)) for name, wave, rate, size, low, high in SWINGS})


def score(prefix: str = "p_") -> Column:
    """The linear score of a row of signals under a policy's columns."""
    w = lambda c: F.col(prefix + c)
    return w("semantic") * F.col("semantic") + w("lexical") * F.col("lexical") + w("affinity") * F.col("affinity") + w("authority") * F.col("auth") + w("reuse") * F.col("re") + w("graph") * 0.6 - w("stale") * F.col("risk")


def evaluate(cands: DataFrame, policies: list[Policy], wanted: str = "relevant", share: float = 0.5) -> DataFrame:
    """policy, fitness: how much larger the mean score of the wanted rows is than that of the others. One pass over the
    candidates; the policies are a few rows."""
    rows = [(i, *asdict(p).values()) for i, p in enumerate(policies)]
    table = cands.sparkSession.createDataFrame(rows, "policy int, " + ", ".join(f"p_{k} double" for k in asdict(policies[0])))
    s = cands.crossJoin(F.broadcast(table)).withColumn("s", score())
    return s.groupBy("policy").agg(F.avg(F.when(F.col(wanted), F.col("s"))).alias("hit"), F.avg(F.when(~F.col(wanted), F.col("s"))).alias("miss")).select("policy", (F.coalesce("hit", F.lit(0.0)) - share * F.coalesce("miss", F.lit(0.0))).alias("fitness"))


def search(cands: DataFrame, start: Policy = Policy(), generations: int = 3, population: int = 6, wanted: str = "relevant") -> tuple[Policy, list[float]]:
    """The fittest policy found, and the fitness of each generation's best: a driver loop over a few rows a round."""
    best, history = start, []
    for g in range(generations):
        pool = [best] + [mutate(best, g * population + i + 1) for i in range(population)]
        rows = evaluate(cands, pool, wanted).collect()  # population + 1 rows
        top = max(rows, key=lambda r: (r["fitness"], -r["policy"]))
        best = pool[top["policy"]]
        history.append(top["fitness"])
    return best, history


def minimum_evidence(rows: list[tuple], needed: frozenset, budget: int, coverage: float = 0.8) -> list[int]:
    """rows: (id, tokens, score, words). Greedy by score per token until enough of `needed` is covered, then what can be left out is."""

    def enough(chosen):
        return not needed or len(needed & frozenset().union(*(c[3] for c in chosen))) / len(needed) >= coverage if chosen else not needed

    chosen, spent = [], 0
    for r in sorted(rows, key=lambda r: (-(r[2] + 2 * bool(r[3] & needed)) / max(1, r[1]), r[0])):
        if chosen and spent + r[1] > budget:
            continue
        chosen.append(r)
        spent += r[1]
        if enough(chosen):
            break
    least = [r for r in chosen if not enough([c for c in chosen if c is not r])]
    return [r[0] for r in (least if least and enough(least) else chosen)]


def verification_level(risk: Column, bypass: Column, dollars: Column) -> Column:
    """0 deterministic, 2 consistency of evidence, 3 a cheap model, 4 a strong one: by risk, no dearer than what is left."""
    cheap = F.when(dollars >= CHEAP_CHECK, 3).otherwise(2)
    low, middle, high = LEVELS
    return F.when(bypass | (risk < low), 0).when(risk < middle, 2).when(risk < high, cheap).when(dollars >= STRONG_CHECK, 4).otherwise(cheap)


def compute_plan(profile: Column, tokens: Column, models: list[Model], answer: int = 500) -> Column:
    """Struct model, dollars, calls, left, level: how a task of this profile (of assess.task_profile) and so many tokens of
    context is worked on. The cheapest model that is trusted with its difficulty, else the most capable; no model for class
    T0. `left` is what the budget keeps for verification: its reserve, or less where the work is dear. Models are a few
    values of a request and stand in the expression, so nothing is joined."""
    if not models:
        raise ValueError("no models")
    order = sorted(models, key=lambda m: (m.dollars_in + m.dollars_out, m.name))
    most = max(order, key=lambda m: m.capability)
    row = lambda m: F.struct(F.lit(m.name).alias("name"), F.lit(float(m.capability)).alias("capability"), F.lit(float(m.dollars_in)).alias("in"), F.lit(float(m.dollars_out)).alias("out"))
    fit = F.filter(F.array(*[row(m) for m in order]), lambda x: x["capability"] >= profile["difficulty"])
    bypass = profile["class"] == "T0"
    m = F.when(F.size(fit) > 0, F.get(fit, F.lit(0))).otherwise(row(most))
    dollars = F.when(bypass, 0.0).otherwise(F.round((tokens * m["in"] + answer * m["out"]) / 1e6, 9))
    left = F.round(F.greatest(F.lit(0.0), F.least(F.lit(MOST_DOLLARS * RESERVE), MOST_DOLLARS - dollars)), 9)
    calls = F.when(bypass, 0).otherwise(profile["calls"] + SPARE_CALLS)
    level = verification_level(profile["risk"], bypass, left)
    return F.struct(F.when(~bypass, m["name"]).alias("model"), dollars.alias("dollars"), calls.alias("calls"), left.alias("left"), level.alias("level"))
