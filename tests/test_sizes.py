"""What must not grow with the tables: no table of nodes goes through the driver, and no step holds all edges."""

import os
import random

import pytest

from millrace.operators import retrieval as V
from millrace.plans import retrieval
from millrace.registry import Tables

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_nodes_are_never_broadcast(spark, how):
    t = Tables(spark, DATA)
    few = spark.createDataFrame([(1,), (2,)], "id long")
    plan = few.join(retrieval._nodes(t).select("id", "path"), "id", how)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("few", [0, 2, 100])
def test_edges_that_touch(spark, monkeypatch, few):
    monkeypatch.setattr(V, "FEW", few)
    edges = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (4, 5, "d"), (2, 3, "b"), (6, 6, "e")], "src long, dst long, kind string")
    ids = spark.createDataFrame([(1,), (2,), (6,)], "id long")
    got = V.touching(edges, ids)
    assert sorted(set(map(tuple, got.collect()))) == [(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (6, 6, "e")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (few >= 3)


def test_repeated_edges_expand_as_distinct_ones(spark):
    nodes = spark.createDataFrame([(i, f"p{i % 3}/f{i}.go") for i in range(12)], "id long, path string")
    pairs = [(0, 3), (3, 5), (5, 7), (0, 7), (2, 9), (9, 10)]
    seeds = spark.createDataFrame([("x", 0, 1), ("x", 2, 2), ("y", 9, 1)], "task string, id long, place int")
    once, often = (V.expand(seeds, nodes, spark.createDataFrame(p, "src long, dst long")).collect() for p in (pairs, pairs * 3 + [(b, a) for a, b in pairs]))
    assert sorted(map(tuple, once)) == sorted(map(tuple, often)) and once


@pytest.mark.parametrize("known, wide", [(100_000, 1000), (3, 1000), (0, 20)])
def test_similar_sets_whatever_is_known(spark, monkeypatch, known, wide):
    from millrace.operators import ranking

    monkeypatch.setattr(ranking, "KNOWN", known)
    monkeypatch.setattr(ranking, "WIDE_FROM", wide)
    r = random.Random(5)
    base = [[f"w{min(int(r.paretovariate(0.6)), 400)}x{r.randrange(3)}" for _ in range(n)] for n in (3, 8, 30, 60, 200) for _ in range(6)]
    rows = [(r.choice(["x", "y", None]) if i % 9 == 0 else "x", i, sorted({w for w in b if r.random() > p} | {f"n{i}_{j}" for j in range(int(p * len(b) * 0.5))})) for i, (b, p) in enumerate((b, p) for b in base for p in (0, 0.05, 0.12, 0.2))]
    got = {(x["a"], x["b"]): round(x["jaccard"], 9) for x in ranking.similar_sets(spark.createDataFrame(rows, "g string, k long, t array<string>"), "g", "k", "t", 75).collect()}
    sets = [(g, k, set(t)) for g, k, t in rows if t and g]
    want = {(a[1], b[1]): round(len(a[2] & b[2]) / len(a[2] | b[2]), 9) for a in sets for b in sets if a[0] == b[0] and a[1] < b[1] and 100 * len(a[2] & b[2]) >= 75 * len(a[2] | b[2])}
    assert got == want and len(want) > 30


def test_only_nearly_similar_pairs_are_written(spark, monkeypatch):
    """Sets of 40 of 200 terms share some, but none is similar: hardly a pair may be verified on its terms."""
    from millrace.operators import ranking

    seen, write = {}, ranking.table
    monkeypatch.setattr(ranking, "table", lambda df, name="t": seen.__setitem__(name, write(df, name)) or seen[name])
    rows = [(1, i, [f"c{j}" for j in random.Random(i).sample(range(200), 40)]) for i in range(60)]
    assert ranking.similar_sets(spark.createDataFrame(rows, "g int, k long, t array<string>"), "g", "k", "t", 75).count() == 0
    assert seen["near"].count() < 60 * 59 / 2 / 10


@pytest.mark.parametrize("few", [0, 500_000])
def test_claims_that_share_a_word_are_not_read_whole(spark, monkeypatch, few):
    """Claims of 40 of 200 words share rare ones, but none meets another; two that do are found."""
    from millrace.operators import claims

    seen, write = {}, claims.table
    monkeypatch.setattr(claims, "table", lambda df, name="t": seen.__setitem__(name, write(df, name)) or seen[name])
    monkeypatch.setattr(claims, "FEW", few)
    sets = [[f"c{j}" for j in random.Random(i).sample(range(200), 40)] for i in range(60)]
    sets += [sets[0][:38] + ["x1", "x2"], sets[1] + ["x3"]]
    got = claims.merge(spark.createDataFrame([("s", i, " ".join(w), "e", 1) for i, w in enumerate(sets)], "scope string, ord long, claim string, evidence string, confidence int"))
    assert sorted(r["ord"] for r in got.where("claims = 2").collect()) == [0, 1] and got.count() == 60
    assert 2 <= seen["near"].count() < 60 * 59 / 2 / 10
