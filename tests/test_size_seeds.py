"""What must not grow with the texts when substrings are looked up: no text is shuffled for a gram that no pattern is looked up by."""

import random
from collections import Counter

import pytest

from millrace.operators import seeds as S


@pytest.mark.parametrize("few", [0, 3, 100_000])
def test_texts_go_nowhere_for_common_grams(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(4)
    texts = [(i, f"pkg{i % 5}/f{rng.randrange(300)}{rng.choice(['', '_test'])}.go") for i in range(120)] + [(7, "red"), (200, None), (201, "")]
    patterns = [(f"f{rng.randrange(300)}_test",) for _ in range(25)] + [("f7",), ("red",), ("_test",), ("nowhere",), ("p",)]
    got = S.holding(spark.createDataFrame(patterns, "pattern string"), spark.createDataFrame(texts, "id long, text string"))
    want = {(p, i) for (p,) in patterns for i, x in texts if x and p in x}
    assert {tuple(r) for r in got.collect()} == want and len(want) > 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (few < 100_000)


@pytest.mark.parametrize("few", [0, 100_000])
def test_pairs_that_nobody_asks_for_are_not_kept(spark, monkeypatch, few):
    seen, write = {}, S.table
    monkeypatch.setattr(S, "table", lambda df, name="t": seen.__setitem__(name, write(df, name)) or seen[name])
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(8)
    docs = [" ".join(rng.choice(["red", "red", *(f"w{j}" for j in range(30))]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "red", "red red"]
    tokens = [d.split() for d in docs]
    n, c = Counter(w for t in tokens for w in t), Counter(tuple(sorted(p)) for t in tokens for p in zip(t, t[1:]) if p[0] != p[1])
    near = sorted((-round(2 * v / (n[a] + n[b]), 9), b if a == "red" else a) for (a, b), v in c.items() if "red" in (a, b) and v >= 2)
    got = S.partners(spark.createDataFrame([(d,) for d in docs], "text string"), spark.createDataFrame([("red",), ("none",)], "term string"), 2, 5)
    assert {tuple(r) for r in got.collect()} == {("red", p, -d) for d, p in near[:5]} and len(near) > 10
    kept = seen["pairs"].where("a <> b").count()
    assert kept == (len(c) if few == 0 else sum("red" in p for p in c))
