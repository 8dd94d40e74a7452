"""Manifests, changes and what rests on them, the memory log fed by changes, and the verbs that hand work on."""

import random

import pytest

from millrace.engine import Engine
from millrace.operators import changes as C
from millrace.operators import policy as P
from millrace.sources import manifest
from tests.test_engine import COLUMNS, ROWS


def test_manifest(spark, tmp_path):
    root = str(tmp_path / "m")
    a = spark.createDataFrame([("a.go", "1", 10), ("b.go", "2", 20)], "path string, hash string, size long")
    assert manifest.load(spark, root).count() == 0 and manifest.revision(spark, root) is None
    assert manifest.save(a, root, "r1") == 1 and manifest.save(a.where("path = 'a.go'"), root, "r2") == 2
    assert manifest.versions(spark, root) == [1, 2] and manifest.revision(spark, root) == "r2"
    assert [tuple(r)[:3] for r in manifest.load(spark, root).collect()] == [("a.go", "1", 10)]
    assert {tuple(r)[:3] for r in manifest.load(spark, root, 1).collect()} == {("a.go", "1", 10), ("b.go", "2", 20)}
    with pytest.raises(manifest.Conflict):  # a writer that read version 1 and was overtaken
        manifest.save(a, root, "r3", expected=1)
    assert manifest.versions(spark, root) == [1, 2] and manifest.load(spark, root).count() == 1
    with pytest.raises(ValueError):
        manifest.load(spark, root, 7)


def test_statuses(spark):
    s = "path string, hash string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None), ("e", "1"), ("e", "2")], s)
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", "4"), ("f", "1"), ("e", "2")], s)
    assert {tuple(r) for r in C.statuses(old, new).collect()} == {("a", "U"), ("b", "M"), ("c", "U"), ("d", "M"), ("e", "U"), ("f", "A")}
    assert {tuple(r) for r in C.statuses(old, new.limit(0)).collect()} == {(p, "D") for p in "abcde"}


def test_dependents(spark):
    rng = random.Random(4)
    for n in (6, 25):
        names = [f"f{i}" for i in range(n)]
        deps = [(rng.choice(names), rng.choice(names)) for _ in range(n)] + [("f0", "f1"), ("f1", "f2"), ("f2", "f0")]
        changes = [(x, rng.choice("AMDU")) for x in rng.sample(names, 3)]
        far = {p: 0 for p, s in changes if s != "U"}
        front = set(far)
        while front:
            front = {p for p, q in deps if q in front} - set(far)
            far |= dict.fromkeys(front, 1 + max(far.values()))
        got = C.dependents(spark.createDataFrame(changes, "path string, status string"), spark.createDataFrame(deps, "path string, needs string"))
        assert {(r["path"], r["distance"]) for r in got.collect()} == {(p, d) for p, d in far.items() if d}


def test_built_on(spark):
    rng = random.Random(6)
    parts = ["a", "b", "ab", "x.go", "ax.go", "go", ".go", "o"]
    path = lambda: "/".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    contexts = [(rng.randrange(60), path()) for _ in range(120)] + [(100, None), (101, ""), (102, "a/")]
    changed = [(path(),) for _ in range(6)] + [(None,), ("",), ("zzz/a/",)]
    want = {k for k, p in contexts for (f,) in changed if p and f and (p.endswith(f) or f.endswith(p))}
    got = [r["key"] for r in C.built_on(spark.createDataFrame(contexts, "key long, path string"), spark.createDataFrame(changed, "path string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 102 in want


def test_log_fed_by_changes(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    more = [(6, "retry waits", "code", "commit", 0.8, 0, "src/retry.go", "file", 5), (7, "the folder", "code", "source", 0.8, None, "src", "file", 5), (8, "apart", "code", "source", 0.8, 0, "srcs/x.go", "file", 5)]
    e.remember(spark.createDataFrame(ROWS + more, COLUMNS))
    rows = lambda: spark.read.parquet(f"{tmp_path}/memories").count()
    files = spark.createDataFrame([("src/retry.go", "1"), ("ui/a.ts", "1")], "path string, hash string")
    assert {r["status"] for r in e.sync(files, 5).collect()} == {"A"} and rows() == 8  # nothing was known before
    later = spark.createDataFrame([("src/retry.go", "2"), ("ui/a.ts", "1")], "path string, hash string")
    assert [tuple(r) for r in e.sync(later, 6).collect()] == [("src/retry.go", "M")]
    assert {r["id"] for r in e.memories().where("touched = 6").collect()} == {6, 7} and rows() == 10
    e.sync(later, 6), e.touch(spark.createDataFrame([("src/retry.go", "M")], "path string, status string"), 6)
    assert rows() == 10 and manifest.versions(spark, f"{tmp_path}/manifest") == [1, 2]
    e.invalidate([6], 7)
    e.touch(spark.createDataFrame([("src/retry.go", "D")], "path string, status string"), 8)
    assert {r["id"] for r in e.memories().where("touched = 8").collect()} == {7}
    uses = spark.createDataFrame([(1, "t1"), (1, "t1"), (7, "t1"), (None, "t1")], "id long, use string")
    e.reuse(uses), e.reuse(uses), e.reuse(spark.createDataFrame([(1, "t2")], "id long, use string"))
    e.invalidate([7], 9)  # a new version does not count the uses twice
    assert {r["id"]: r["reuse"] for r in e.memories().collect()} == {1: 5, 2: 0, 3: 0, 4: 0, 5: 9, 6: 0, 7: 1, 8: 0}


def test_handing_on(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.remember(spark.createDataFrame(ROWS, COLUMNS))
    assert e.resume().count() == 0
    h = e.handoff("Kafka, outbox!", "large", 100, 5).collect()
    plan = e.plan("Kafka, outbox!", 100, 5)
    rows = plan.orderBy("place").collect()
    assert len(h) == 1 and h[0]["target"] == "large" and h[0]["selected_tokens"] == sum(r["tokens"] for r in rows)
    assert [x["id"] for x in h[0]["stable_prefix"]] == [r["id"] for r in rows if r["part"] == "prefix"]
    assert [x["id"] for x in h[0]["variable_context"]] == [r["id"] for r in rows if r["part"] == "variable"]
    none = e.handoff("nothing like it", "large", 100, 5).collect()[0]
    assert none["selected_tokens"] == 0 and none["stable_prefix"] == [] == none["variable_context"]

    models = [P.Model("big", 0.9, 3.0, 15.0), P.Model("mini", 0.4, 0.1, 0.4)]
    x = e.execution_plan("fix the kafka outbox", models, 100, 5).collect()[0]
    assert x["model"] == "mini" and x["items"] and abs(x["dollars"] - (x["tokens"] * 0.1 + 500 * 0.4) / 1e6) < 1e-9

    ev = lambda *rows: spark.createDataFrame(rows, "repo string, event_id long, ts string, agent string, event_type string, text string").selectExpr("repo", "event_id", "cast(ts as timestamp) as ts", "agent", "event_type", "text")
    first = ev(("r", 1, "2024-01-01 10:00:00", "x", "UserPrompt", "mend the outbox"), ("r", 2, "2024-01-01 10:01:00", "x", "SessionEnd", ""), ("q", 1, "2024-01-01 09:00:00", "y", "Stop", ""))
    e.record(first), e.record(first), e.record(ev(("r", 3, "2024-01-01 11:00:00", "z", "Tool", "run")))
    e.trace("kafka", 100, plan)
    got = {r["repo"]: r for r in e.resume().collect()}
    assert set(got) == {"r", "q"} and (got["r"]["agent"], got["r"]["ended"], got["r"]["events"]) == ("z", None, 1)
    assert got["r"]["work_item"] is not None and got["r"]["trace"]["task"] == "kafka" and got["r"]["trace"]["selected"] == len(rows)


def test_compute_plan(spark):
    from pyspark.sql import functions as F

    models = [P.Model("big", 0.9, 3.0, 15.0), P.Model("mini", 0.4, 0.1, 0.4)]
    rows = [(0.1, "T1", 0.1, 1, "mini", 0), (0.5, "T3", 0.5, 6, "big", 3), (0.99, "T4", 0.8, 12, "big", 4), (0.9, "T0", 0.9, 0, None, 0), (0.4, "T2", 0.2, 3, "mini", 2)]
    d = spark.createDataFrame(rows, "difficulty double, class string, risk double, calls int, model string, level int")
    got = d.select("model", "level", P.compute_plan(F.struct("difficulty", "class", "risk", "calls"), F.lit(1000), models).alias("c"), "calls").collect()
    assert all(r["c"]["model"] == r["model"] and r["c"]["level"] == r["level"] for r in got)
    assert all(r["c"]["calls"] == (0 if r["model"] is None else r["calls"] + 5) for r in got)
    dear = d.select(P.compute_plan(F.struct("difficulty", "class", "risk", "calls"), F.lit(10**6), models).alias("c"), "class").collect()
    assert [r["c"]["level"] for r in dear if r["class"] == "T4"] == [2] and [r["c"]["left"] for r in dear if r["class"] == "T4"] == [0.0]
