"""Substrings, seeds and learned terms against plain readings."""

import random
import re
from collections import Counter

from millrace.operators import seeds as S


def test_holding(spark):
    rng = random.Random(2)
    word = lambda a, b: "".join(rng.choice("abc/") for _ in range(rng.randint(a, b)))
    texts = [(i, word(0, 9)) for i in range(60)] + [(60, None), (61, "aaaa"), (61, "bb")]
    patterns = [(word(1, 5),) for _ in range(30)] + [("",), (None,), ("aaa",), ("zzz",), ("ab",), ("c",), ("ab",)]
    want = {(p, i) for (p,) in patterns for i, x in texts if p and x is not None and p in x}
    got = [tuple(r) for r in S.holding(spark.createDataFrame(patterns, "pattern string"), spark.createDataFrame(texts, "id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_seeds(spark):
    rng = random.Random(9)
    names = ["Run", "run_all", "stop", "Parse", "go", "x"]
    nodes = [(i, rng.choice(names), f"{rng.choice(['src', 'lib/run'])}/{rng.choice(['a', 'stop', 'Parse'])}{i}.go") for i in range(25)] + [(30, None, "top.go"), (31, "run", None)]
    tasks = [(k, " ".join(rng.choice(["run", "Stop!", "parse", "go", "lib", "x"]) for _ in range(3))) for k in range(8)] + [(50, None)]
    changed = [(rng.randrange(8), rng.choice([nodes[3][2], nodes[4][2], "a1.go", "top.go", "deep/top.go"])) for _ in range(12)] + [(0, None), (0, "")]
    failures = [(rng.randrange(8), rng.choice(["STOP", "parse", "zz", "a"])) for _ in range(8)]
    want: dict = {}
    for k, text in tasks:
        tokens = set(re.findall("[a-z_][a-z0-9_]{2,}", (text or "").lower()))
        for i, name, path in nodes:
            n, p = (name or "").lower(), (path or "").lower()
            s = 1.0 if n in tokens else 0.5 if any(w in n or w in p for w in tokens) else 0.0
            s += 1.2 * len({f for t, f in changed if t == k and f and path and (path.endswith(f) or f.endswith(path))})
            s += 1.5 * len({f.lower() for t, f in failures if t == k and (f.lower() in n or f.lower() in p)})
            if s:
                want[k, i] = round(s, 6)
    got = S.seeds(spark.createDataFrame(tasks, "task long, text string"), spark.createDataFrame(nodes, "id long, name string, path string"), spark.createDataFrame(changed * 2, "task long, path string"), spark.createDataFrame(failures, "task long, name string"))
    assert {(r["task"], r["id"]): r["seed"] for r in got.collect()} == want and len(want) > 50


def test_partners_and_expand(spark):
    rng = random.Random(3)
    docs = [(" ".join(rng.choice(["red", "blue", "kafka", "outbox", "retry", "a"]) for _ in range(rng.randint(0, 30))),) for _ in range(40)] + [(None,), ("",), ("one",)]
    tokens = [[w for w in (d or "").split() if len(w) > 1] for (d,) in docs]
    n = Counter(w for t in tokens for w in t)
    c = Counter(tuple(sorted(p)) for t in tokens for p in zip(t, t[1:]) if p[0] != p[1])
    want = set()
    for term in ("red", "kafka"):
        near = [(-round(2 * v / (n[a] + n[b]), 9), b if a == term else a) for (a, b), v in c.items() if term in (a, b) and v >= 3]
        want |= {(term, p, -d) for d, p in sorted(near)[:2]}
    terms = spark.createDataFrame([("red",), ("kafka",), ("kafka",), ("unknown",)], "term string")
    learned = S.partners(spark.createDataFrame(docs, "text string"), terms, 3, 2)
    assert {tuple(r) for r in learned.collect()} == want and len(want) == 4
    fixed = spark.createDataFrame([("red", "blue", 0.5), ("red", "green", 0.4), ("kafka", "red", 0.3)], "term string, partner string, dice double")
    q = spark.createDataFrame([(1, "red kafka red"), (2, None), (3, "other")], "key long, text string")
    assert {tuple(r) for r in S.expand(q, fixed).collect()} == {(1, "red", 1.0), (1, "kafka", 1.0), (1, "blue", 0.65), (1, "green", 0.65), (3, "other", 1.0)}
