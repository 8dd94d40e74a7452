"""The engine's verbs, file sources and embeddings on small inputs."""

import json

import numpy as np
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.functions import embedding
from millrace.sources import files

ROWS = [
    (1, "we decided to use kafka for the outbox", "decision", "user", 0.9, 3, "src/outbox.go", "file", 5),
    (2, "kafka outbox retries failed in the test", "failure", "test", 0.8, 0, "src/retry.go", "file", 5),
    (3, "the outbox is polled, says a guess", "fact", "inference", 0.5, 0, "src/poll.go", "file", 5),
    (4, "unrelated note on colours", "note", "user", 0.9, 0, "ui/a.ts", "file", 5),
    (5, "kafka topics are named by team, the outbox too", "constraint", "source", 0.7, 9, "", "repository", 5),
]
COLUMNS = "id long, content string, kind string, authority string, confidence double, reuse long, location string, scope string, valid_from long"


def test_plan(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.remember(spark.createDataFrame(ROWS, COLUMNS))
    assert {r["id"] for r in e.retrieve("kafka outbox", 2).collect()} == {1, 2}
    plan = e.plan("Kafka, outbox!", 100, 5).collect()
    assert [r["id"] for r in plan if r["part"] == "prefix"] and {r["id"] for r in plan} == {1, 2, 5}
    assert [r["part"] for r in plan] == sorted(r["part"] for r in plan)
    small = e.plan("kafka outbox", 12, 5).collect()
    assert 1 <= len(small) and sum(r["tokens"] for r in small) <= 12
    gone = spark.createDataFrame([("src/outbox.go", "D")], "path string, status string")
    assert 1 not in {r["id"] for r in e.plan("kafka outbox", 100, 6, gone).collect()}
    e.invalidate([2], 6)
    assert 2 not in {r["id"] for r in e.plan("kafka outbox", 100, 6).collect()} and e.memories().count() == 5
    e.validate([2], 7)
    assert 2 in {r["id"] for r in e.plan("kafka outbox", 100, 7).collect()}
    assert e.plan("nothing like it", 100, 5).count() == 0
    assert e.prune(0).count() == 5 and {r["kind"]: r["n"] for r in e.stats().collect()}["fact"] == 1


def test_embeddings(spark):
    d = spark.createDataFrame([("Kafka kafka outbox",), (None,)], "t string")
    got = d.select(embedding.embedding(embedding.bag_vector, 128)("t"), embedding.embedding(embedding.positional_vector, 256)("t")).collect()
    assert abs(np.linalg.norm(got[0][0]) - 1) < 1e-5 and abs(np.linalg.norm(got[0][1]) - 1) < 1e-5 and not any(got[1][0])
    assert embedding.fnv64("a") == 0xAF63DC4C8601EC8C and embedding.fnv32("foobar") == 0xBF9CF968


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "x long").agg(F.sum("x")).collect()[0][0] == 3
    for n in (3, 4):
        files.append_json_lines(spark.createDataFrame([(n,)], "x long"), str(tmp_path / "lines"))
    assert files.read_json_lines(spark, str(tmp_path / "lines"), "x long").count() == 2
    tree = tmp_path / "tree"
    for name, text in {"src/main.go": "package a\nfunc Run() {}\n", "docs/x.md": "text", "vendor/v.go": "x", "a.log": "x", ".cursor/worktrees/w/m.go": "x", "src/pb.go": "// Code generated by hand. DO NOT EDIT\n"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    f = files.scan_tree(spark, str(tree))
    assert {(r["path"], r["class"], r["admission"]["eligible"]) for r in f.collect()} == {("src/main.go", "authoritative", True), ("docs/x.md", "documentation", True), ("src/pb.go", "generated", False)}
    assert files.audit(f).agg(F.sum("n")).collect()[0][0] == 3
    before = f.where("path <> 'src/main.go'").withColumn("hash", F.when(F.col("path") == "docs/x.md", "old").otherwise(F.col("hash")))
    assert {tuple(r) for r in files.changed_files(before, f.where("path <> 'src/pb.go'")).select("path", "status").collect()} == {("src/main.go", "A"), ("docs/x.md", "M"), ("src/pb.go", "D")}
    spark.range(5).write.parquet(str(tmp_path / "t"))
    assert files.migrate(spark, {"t": str(tmp_path / "t")}, str(tmp_path / "to")) == [("t", 5, 5)]


def test_generated_and_worktrees(spark):
    from millrace.operators import evidence as E

    rows = [("a.go", "x" * 4090 + "# @generated", False, False), (".aider/worktrees", "", False, True), (".aider/worktreesx/a.go", None, False, False), ("x/.aider/worktrees/a.go", "/* @generated */", True, False), (None, None, False, False)]
    d = spark.createDataFrame([r[:2] for r in rows], "p string, t string")
    assert [tuple(r) for r in d.select(E.is_generated(F.col("t")), E.is_worktree(F.col("p"))).collect()] == [r[2:] for r in rows]


def test_power_sizes(spark):
    from millrace.operators import statistics as S

    d = spark.createDataFrame([(0.1,), (0.25,), (0.5,), (0.0,), (None,)], "s double")
    assert [r[0] for r in d.select(S.power_sizes(F.lit(0.05), F.col("s"))).collect()] == [S.power_size(0.05, x) for x in (0.1, 0.25, 0.5, 0.0)] + [None]
    assert [r[0] for r in d.where("s > 0").select(S.power_sizes(F.lit(0.05), F.col("s"), 0.01, 0.9)).collect()] == [S.power_size(0.05, x, 0.01, 0.9) for x in (0.1, 0.25, 0.5)]
