"""Budgeted selection: order-dependent folds over the ranked items of a group.

Items that do not fit are skipped and the fold goes on, so a running sum is not
enough. Before a group is gathered it is cut to what a fold could choose
(`fitting`), which a budget bounds whatever the group's size; the greedy forms stay
in the JVM as an aggregate over a sorted array, the ones that compare items with
what is chosen are grouped-map functions over a query's top-N.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fitting(cands: DataFrame, groups: list[str], budget: int, *order: Column) -> DataFrame:
    """The items that a greedy fold in this order could choose: of each group the first budget / n ones of n tokens.

    What is spent never falls, so where an item fits, all items of its size before it did and were chosen: those further
    back cannot be. About budget * ln(budget) items a group are left, and a hot group is spread by its sizes. Items of no
    tokens are as items of one; the order must not leave ties."""
    n = F.greatest(F.lit(1), F.col("tokens"))
    fit = cands.where(F.col("tokens") <= budget).withColumn("_n", n)
    fit = fit.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_n").orderBy(*order)))
    return fit.where((F.col("_r") <= budget) & (F.col("_r") * F.col("_n") <= budget)).drop("_n", "_r")


def greedy(items: Column, budget: Column | int) -> Column:
    """items: array<struct<.., id, tokens>> in order. Struct<spent, chosen ids>."""
    budget = F.lit(budget).cast("long") if isinstance(budget, int) else budget

    def step(a, x):
        fits = (x["tokens"] > 0) & (a["spent"] + x["tokens"] <= budget)
        return F.struct(
            F.when(fits, a["spent"] + x["tokens"]).otherwise(a["spent"]).alias("spent"),
            F.when(fits, F.concat(a["chosen"], F.array(x["id"]))).otherwise(a["chosen"]).alias("chosen"),
            F.when(fits, a["score"] + x["score"]).otherwise(a["score"]).alias("score"),
        )

    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<bigint>").alias("chosen"), F.lit(0.0).alias("score"))
    return F.aggregate(items, start, step)


def _folded(kept: DataFrame, group: str, budget: int, *more: Column) -> DataFrame:
    """group, _items (in order of density, those that could be chosen: see `fitting`), further aggregates, _fold of the greedy.
    One pass over the candidates, as they are costly to make; a group whose items are all too large keeps its row."""
    order = Window.partitionBy(group, "tokens").orderBy(F.desc("density"), "id")
    rows = kept.withColumn("_r", F.row_number().over(order))
    item = F.struct((-F.col("density")).alias("o"), F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"), F.col("score").cast("double").alias("score"))
    items = F.array_sort(F.collect_list(F.when((F.col("tokens") > 0) & (F.col("_r") * F.col("tokens") <= budget), item)))  # nulls are left out
    return rows.groupBy(group).agg(items.alias("_items"), *more).withColumn("_fold", greedy(F.col("_items"), budget))


def greedy_pack(cands: DataFrame, group: str, budget: int) -> DataFrame:
    """group, spent, chosen, score of a density greedy. cands: group, id, tokens, score, density (null: rejected)."""
    return _folded(cands.where("density is not null"), group, budget).select(group, "_fold.spent", "_fold.chosen", "_fold.score")


def singleton_rescue(cands: DataFrame, group: str, budget: int, fill: bool = False) -> DataFrame:
    """As greedy_pack, but the best single item that fits replaces a selection of smaller total score; with `fill`, what
    budget that item leaves is filled by density (after the greedy itself nothing that is left fits)."""
    kept = cands.where("density is not null")
    best = F.max(F.when((F.col("tokens") > 0) & (F.col("tokens") <= budget), F.struct(F.col("score").cast("double").alias("score"), (-F.col("id")).cast("long").alias("neg"), F.col("tokens").cast("long").alias("tokens"))))
    rows = _folded(kept, group, budget, best.alias("_best"))
    rescue = F.coalesce(F.col("_best.score") > F.col("_fold.score"), F.lit(False))
    one = F.struct(F.col("_best.tokens").alias("spent"), F.array(-F.col("_best.neg")).alias("chosen"), F.col("_best.score").alias("score"))
    if fill:
        more = greedy(F.filter("_items", lambda x: x["id"] != -F.col("_best.neg")), F.lit(budget).cast("long") - F.col("_best.tokens"))
        one = F.struct((one["spent"] + more["spent"]).alias("spent"), F.concat(one["chosen"], more["chosen"]).alias("chosen"), (one["score"] + more["score"]).alias("score"))
    got = F.when(rescue, one).otherwise(F.col("_fold"))
    return rows.select(group, got.alias("_got"), rescue.alias("rescued")).select(group, "_got.spent", "_got.chosen", "_got.score", "rescued")


def _overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a) if a and b else 0.0


def submodular(rows: list[tuple], budget: int, penalty: float = 0.35) -> list[int]:
    """rows: (id, tokens, score, token set). At each step the most (score - penalty * summed overlap) per token."""
    left, chosen, spent = list(rows), [], 0
    while left:
        best, at = -1.0, -1
        for i, (_, n, score, words, *_) in enumerate(left):
            if n <= 0 or spent + n > budget:
                continue
            gain = score - penalty * sum(_overlap(words, c[3]) for c in chosen)
            if gain > 0 and gain / n > best:
                best, at = gain / n, i
        if at < 0:
            break
        chosen.append(left.pop(at))
        spent += chosen[-1][1]
    return [c[0] for c in chosen]


def lazy_greedy(rows: list[tuple], budget: int, penalty: float = 0.35) -> list[int]:
    """As submodular, but gains are only brought up to date when they come to the top of a heap."""
    import heapq

    heap = [(-score / n, i, 0) for i, (_, n, score, *_) in enumerate(rows) if 0 < n <= budget and score > 0]
    heapq.heapify(heap)
    chosen, spent = [], 0
    while heap:
        gain, i, seen = heapq.heappop(heap)
        _, n, score, words, *_ = rows[i]
        if spent + n > budget:
            continue
        if seen == len(chosen):
            chosen.append(rows[i])
            spent += n
            continue
        fresh = score - penalty * sum(_overlap(words, c[3]) for c in chosen)
        if fresh > 0:
            heapq.heappush(heap, (-fresh / n, i, len(chosen)))
    return [c[0] for c in chosen]


def information_gain(rows: list[tuple], budget: int) -> list[int]:
    """rows: (id, tokens, score, token set, kind, affinity, confidence)."""
    boundary = {"decision": 1.0, "constraint": 1.0, "symbol": 0.8, "type": 0.8, "file": 0.5}
    left, chosen, spent = list(rows), [], 0
    while left and spent < budget:
        best, at = -1.0, -1
        for i, (_, n, _, words, kind, affinity, confidence) in enumerate(left):
            if n <= 0 or spent + n > budget:
                continue
            near = max((_overlap(words, c[3]) for c in chosen), default=0.0)
            gain = max(0.01, 0.35 * (1 - near) + 0.25 * boundary.get(kind, 0.2) + 0.25 * (0.6 * affinity + 0.4 * confidence) - 0.15 * near)
            if gain / n > best:
                best, at = gain / n, i
        if at < 0:
            break
        chosen.append(left.pop(at))
        spent += chosen[-1][1]
    return [c[0] for c in chosen]


def value_of_information(rows: list[tuple], budget: int, least: float = 1e-6) -> list[int]:
    """rows as for information_gain. Adds what changes the decision most per token, until that is under `least`."""
    from math import log2

    def entropy(p):
        p = max(0.001, min(0.999, p))
        return -p * log2(p) - (1 - p) * log2(1 - p)

    weight = {"constraint": 0.35, "decision": 0.35, "failure": 0.25}
    left, chosen, spent, utility = list(rows), [], 0, 0.5
    while left and spent < budget:
        now = min(utility, 0.95)
        best, at = -1.0, -1
        for i, (_, n, _, _, kind, _, confidence) in enumerate(left):
            if n <= 0 or spent + n > budget:
                continue
            new = min(now + weight.get(kind, 0.10) * confidence, 1.0)
            value = max(new - now, max(0.0, entropy(now) - entropy(new))) / n
            if value > best:
                best, at = value, i
        if at < 0 or best < least:
            break
        chosen.append(left.pop(at))
        spent += chosen[-1][1]
        utility += 0.15 if chosen[-1][4] in ("decision", "constraint") else 0.05
    return [c[0] for c in chosen]


def by_utility(rows: list[tuple], budget: int, utility) -> list[int]:
    """At each step the item that adds most to the caller's utility (a function of a list of rows) per token, until none adds."""
    left, chosen, spent, now = list(rows), [], 0, utility([])
    while left:
        gains = [(utility([*chosen, r]) - now) / max(1, r[1]) if r[1] <= budget - spent else -1.0 for r in left]
        at = max(range(len(left)), key=lambda i: (gains[i], -i))
        if gains[at] <= 0:
            break
        chosen.append(left.pop(at))
        spent += chosen[-1][1]
        now = utility(chosen)
    return [c[0] for c in chosen]


def noisy_or(items: Column, budget: int, target: float = 0.85, floor: int = 200, ids: str = "bigint") -> Column:
    """items in order of value per token: array<struct<.., id, tokens, score>>. Takes what fits until the chance that
    all are wrong, each by 1 - 0.8 score, is under 1 - target. Struct<spent, chosen, wrong, done>; ids: the type of an id."""

    def step(a, x):
        n = F.greatest(F.lit(1), x["tokens"]).cast("long")
        take = ~a["done"] & (a["spent"] + n <= budget)
        spent, wrong = F.when(take, a["spent"] + n).otherwise(a["spent"]), F.when(take, a["wrong"] * (1 - x["score"] * 0.8)).otherwise(a["wrong"])
        return F.struct(spent.alias("spent"), F.when(take, F.concat(a["chosen"], F.array(x["id"]))).otherwise(a["chosen"]).alias("chosen"), wrong.alias("wrong"), (a["done"] | (take & (1 - wrong >= target) & (spent >= floor))).alias("done"))

    zero = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{ids}>").alias("chosen"), F.lit(1.0).alias("wrong"), F.lit(False).alias("done"))
    return F.aggregate(items, zero, step)


def spend(items: Column, most: float, reserve: float = 0.4) -> Column:
    """items in order: array<struct<.., cost, reserved>>; ordinary spending stops short of the reserves. Struct<spent, admitted, refused>."""

    def step(a, x):
        limit = F.when(x["reserved"], F.lit(most)).otherwise(F.lit(most * (1 - reserve)))
        ok = a["spent"] + x["cost"] <= limit
        return F.struct(F.when(ok, a["spent"] + x["cost"]).otherwise(a["spent"]).alias("spent"), (a["admitted"] + ok.cast("long")).alias("admitted"), (a["refused"] + (~ok).cast("long")).alias("refused"))

    return F.aggregate(items, F.struct(F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("admitted"), F.lit(0).cast("long").alias("refused")), step)


SELECTORS = {"value_of_information": value_of_information, "submodular": submodular, "lazy_greedy": lazy_greedy, "information_gain": information_gain}


def select_by(cands: DataFrame, group: str, budget: int, selector, columns: tuple[str, ...] = ()) -> DataFrame:
    """group, step, id: what a selector of Python picks in each group, in order.

    cands: group, id, tokens, score, words (array of distinct tokens) and `columns`; a group is the top-N of one query.
    """
    pick = SELECTORS[selector] if isinstance(selector, str) else selector

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        rows = [(int(r.id), int(r.tokens), float(r.score), frozenset(r.words), *(getattr(r, c) for c in columns)) for r in pdf.itertuples()]
        ids = pick(rows, budget)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(ids), "step": range(1, len(ids) + 1), "id": ids})

    kind = cands.schema[group].dataType.simpleString()
    return cands.select(group, "id", "tokens", "score", "words", *columns).groupBy(group).applyInPandas(run, f"{group} {kind}, step long, id long")
