"""What is sorted whole is dealt by counted rows, and nodes are looked up where they are read."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval as V
from millrace.plans import assess, retrieval
from millrace.registry import Tables
from millrace.sources import work

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@needs_data
def test_lines_of_orders_are_dealt_by_their_number(spark, monkeypatch):
    """Four shuffle partitions would hold 1,500 lines each and more."""
    monkeypatch.setattr(work, "ROWS", 250, raising=False)
    t = Tables(spark, DATA)
    per = retrieval._links(t).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per < t.lineitem.count() / 10


@needs_data
def test_nodes_of_one_file_are_not_one_tasks_sort(spark, monkeypatch):
    """The first of each text are taken from dealt nodes, not by a sort of what a task reads."""
    monkeypatch.setattr(work, "ROWS", 50, raising=False)
    seen, write = {}, V.table
    monkeypatch.setattr(V, "table", lambda df, name="t": seen.__setitem__(name, df._jdf.queryExecution().toString()) or write(df, name))
    nodes = retrieval._nodes(Tables(spark, DATA)).coalesce(1)
    got = V._by_text(nodes, 25)
    assert "REPARTITION_BY_NUM" in seen["texts"]
    assert got.count() == nodes.groupBy("name", "content").count().agg(F.sum(F.least("count", F.lit(25)))).first()[0]


def test_nodes_are_not_shuffled_for_what_is_reached(spark, monkeypatch):
    seen, write = {}, V.table
    monkeypatch.setattr(V, "table", lambda df, name="t": seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and write(df, name))
    nodes = work.shuffled(spark.createDataFrame([(i, f"p{i % 3}/f{i // 2}{'_test' if i % 2 else ''}.go") for i in range(12)], "id long, path string"))
    edges = spark.createDataFrame([(0, 3), (3, 5), (5, 7), (0, 40), (2, 9), (9, 10)], "src long, dst long")
    seeds = spark.createDataFrame([("x", 0, 1), ("x", 2, 2), ("y", 9, 1)], "task string, id long, place int")
    few = sorted(map(tuple, V.expand(seeds, nodes, edges).collect()))
    assert not any("SortMergeJoin" in seen.get(k, "SortMergeJoin") for k in ("here", "known"))
    monkeypatch.setattr(V, "sent", work.shuffled)
    assert few == sorted(map(tuple, V.expand(seeds, nodes, edges).collect())) and few


@needs_data
def test_required_paths_whatever_way(spark, monkeypatch):
    t = Tables(spark, DATA)
    n, links = retrieval._nodes(t), work.table(retrieval._links(t), "edges")
    few = sorted(set(map(tuple, assess._required(t, n, links).collect())))
    monkeypatch.setattr(assess, "sent", work.shuffled)
    assert few == sorted(set(map(tuple, assess._required(t, n, links).collect()))) and few
    newest = {r["name"]: r["id"] for r in n.groupBy("name").agg(F.max("id").alias("id")).collect()}
    at = {r["id"]: (r["path"], r["name"]) for r in n.collect()}
    calls = {(r["src"], r["dst"]) for r in links.where("kind = 'call'").collect()}
    assert few == sorted({(k, *at[d]) for k, i in newest.items() for s, d in calls if s == i})
