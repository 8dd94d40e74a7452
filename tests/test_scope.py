"""Scopes against plain readings on small trees, units of a plan by hand."""

import posixpath
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import scope as S


def test_texts(spark):
    rows = [("see ./a/b.go, and a//c.py. no x.exe or v1.2", ["a/b.go", "a/c.py"], False), ("parseFile in Abc", [], True), ("Go is it", [], False), (None, [], False), ("", [], False), ("a.go a.go ...", ["a.go"], False)]
    d = spark.createDataFrame([(t,) for t, _, _ in rows], "t string")
    got = d.select("t", S.named_paths(F.col("t")), S.names_symbol(F.col("t"))).collect()
    assert [(r[0], r[1], r[2]) for r in got] == rows


def plain_scope(tasks, changed, recent, deps):
    members, sums = set(), {}
    for task, text, package, cwd in tasks:
        found = {}
        for p in text.split():
            if p.endswith(".go"):
                found.setdefault(p, set()).add("explicit_path")
                found.setdefault(posixpath.dirname(p), set()).add("explicit_path")
        for k, p in changed:
            if k == task:
                found.setdefault(p, set()).add("changed_files")
                found.setdefault(posixpath.dirname(p), set()).add("changed_files")
        if package or cwd:
            found.setdefault(package or cwd, set()).add("current_package" if package else "cwd_locality")
        found.pop("", None)
        primary = set(found)
        for k, p in recent:
            if k == task:
                found.setdefault(p, set()).add("recent_files")
        for a, b in deps:
            if a in primary and b not in primary:
                found.setdefault(b, set()).add("dep_neighborhood")
        members |= {(task, m, "primary" if m in primary else "secondary", ",".join(sorted(s))) for m, s in found.items()}
        said = {s for v in found.values() for s in v} | ({"exact_symbol"} if "Needle" in text else set())
        sums[task] = (round(max(0.1, min(1.0, sum(S.SIGNALS[s] for s in said))), 6), ",".join(sorted(said)), len(found))
    return members, sums


def test_infer(spark):
    rng = random.Random(5)
    folders = ["a", "a/b", "a/b/c", "d", "e/f"]
    files = [f"{d}/{n}.go" for d in folders for n in "xyz"] + ["top.go"]
    tasks = [(i, " ".join(["fix"] + rng.sample(files, rng.randint(0, 2)) + (["Needle"] if rng.random() < 0.3 else [])), rng.choice([None, "a/b"]), rng.choice([None, "d", ""])) for i in range(40)]
    tasks.append((99, "nothing", None, None))
    changed = [(rng.randrange(30), rng.choice(files)) for _ in range(25)] * 2 + [(1000, "a/x.go")]  # repeated rows, an unknown task
    recent = [(rng.randrange(40), rng.choice(files)) for _ in range(25)]
    deps = [("a/b", "d"), ("a/b", "a/b/c"), ("d", "a"), ("d", "a"), ("q", "r")]
    members, sums = S.infer(
        spark.createDataFrame(tasks, "task long, text string, package string, cwd string"),
        spark.createDataFrame(changed + [(3, None), (3, "")], "task long, path string"),
        spark.createDataFrame(recent, "task long, path string"),
        spark.createDataFrame(deps, "package string, dependency string"),
    )
    want, total = plain_scope(tasks, changed, recent, deps)
    got = [tuple(r) for r in members.select("task", "member", "tier", "signals").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r["task"]: (r["confidence"], r["signals"], r["members"]) for r in sums.collect()} == total
    assert total[99] == (0.1, "", 0)


def test_infer_of_nothing(spark):
    none = spark.createDataFrame([], "task long, path string")
    members, sums = S.infer(spark.createDataFrame([], "task long, text string, package string, cwd string"), none, none, spark.createDataFrame([], "package string, dependency string"))
    assert members.count() == 0 and sums.count() == 0


def walk(hits, share):
    """The descent that localize does without: into the child that holds enough, until none does."""
    total, at = sum(s for _, s in hits), ""
    while True:
        held = {}
        for p, s in hits:
            d = posixpath.dirname(p)
            if at == "" or d == at or d.startswith(at + "/"):
                rest = d[len(at):].lstrip("/")
                if rest:
                    child = (at + "/" if at else "") + rest.split("/")[0]
                    held[child] = held.get(child, 0) + s
        good = [c for c, s in held.items() if s > share * total]
        if not good:
            return at
        at = good[0]


def test_localize(spark):
    rng = random.Random(8)
    rows = []
    for task in range(30):
        heavy = "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
        for _ in range(rng.randint(1, 12)):
            d = heavy if rng.random() < 0.6 else "/".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
            rows.append((task, (d + "/" if d else "") + rng.choice("xyz") + ".go", float(rng.choice([0, 1, 2, 3]))))
    want = {}
    for task in range(30):
        hits = [(p, s) for k, p, s in rows if k == task and s > 0]
        if hits:
            want[task] = walk(hits, 0.5)
    got = S.localize(spark.createDataFrame(rows, "task long, path string, score double")).collect()
    assert {r["task"]: r["folder"] for r in got} == want and any(want.values())
    assert all(r["depth"] == len([x for x in r["folder"].split("/") if x]) for r in got)
    with pytest.raises(ValueError):
        S.localize(spark.createDataFrame(rows, "task long, path string, score double"), 0.3)


def test_units(spark):
    rows = [(1, 10, 1.0, "run", "func", "b.go", "func run(x)", "x" * 40), (1, 11, 0.5, "stop", "func", "a.go", "", None), (1, 12, 0.9, None, "func", "c.go", None, ""), (2, 13, 1.0, "big", "func", "d.go", None, "y" * 4000)]
    c = spark.createDataFrame(rows, "task long, id long, score double, name string, kind string, path string, signature string, content string")
    u = {(r["id"], r["unit"]): (r["tokens"], r["value"]) for r in S.units(c).collect()}
    assert u == {(10, "signature"): (3, 0.6), (10, "definition"): (10, 1.0), (11, "signature"): (3, 0.3), (13, "signature"): (2, 0.6), (13, "definition"): (1000, 1.0)}
    got = [(r["task"], r["id"], r["unit"], r["place"]) for r in S.plan_units(c, 100, 0.99, 0).orderBy("task", "place").collect()]
    assert got == [(1, 11, "signature", 1), (1, 10, "signature", 2), (1, 10, "definition", 3), (2, 13, "signature", 1)]
    tight = [(r["id"], r["unit"]) for r in S.plan_units(c.where("task = 1"), 5, 0.99, 0).collect()]
    assert tight == [(10, "signature")]


def test_members_are_dealt_by_task_alone(spark, monkeypatch):
    """Dependencies make many members of one: these are grouped where they are made, neither shuffled nor written."""
    monkeypatch.setattr(S, "TASKS", 3, raising=False)
    seen, write = {}, S.table
    monkeypatch.setattr(S, "table", lambda df, name="t": seen.setdefault(name, write(df, name)))
    tasks = spark.createDataFrame([(i, f"fix a/x{i}.go in Needle", f"p{i % 3}", None) for i in range(20)], "task long, text string, package string, cwd string")
    paths = spark.createDataFrame([(i, f"p{i % 4}/f.go") for i in range(25)], "task long, path string")
    deps = spark.createDataFrame([(f"p{i}", f"p{j}") for i in range(5) for j in range(30)], "package string, dependency string")
    members, sums = S.infer(tasks, paths, paths, deps)
    assert "scope" not in seen and "collect_set" not in members._jdf.queryExecution().toString()
    for d in (members, sums):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(task") == 2 and ", member#" not in "".join(x.split("hashpartitioning")[1] for x in plan.splitlines() if "hashpartitioning" in x)
    assert members.count() == sum(r["members"] for r in sums.collect()) == 20 * 33 and members.distinct().count() == 20 * 33
