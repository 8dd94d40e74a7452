"""The store of SQLite files: round trips, partitions, pushed filters, failed writes."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.sources import store

COLUMNS = "id long, name string, score double, ok boolean, raw binary"


@pytest.fixture
def kept(spark, tmp_path):
    store.register(spark)
    rows = [(i, None if i % 7 == 0 else f"n{i % 5}", i / 4, None if i % 3 == 0 else i % 2 == 0, bytes([i % 256])) for i in range(1000)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    path = str(tmp_path / "store")
    df.write.format(store.FORMAT).mode("append").save(path)
    return path, rows


def test_round_trip_and_partitions(spark, kept):
    path, rows = kept
    got = spark.read.format(store.FORMAT).option("rows", 100).load(path)
    assert got.schema.simpleString() == "struct<id:bigint,name:string,score:double,ok:boolean,raw:binary>"
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == rows
    assert len(os.listdir(path)) == 3 and got.rdd.getNumPartitions() >= 10
    spark.createDataFrame(rows[:5], COLUMNS).write.format(store.FORMAT).mode("append").save(path)
    assert spark.read.format(store.FORMAT).load(path).count() == 1005
    spark.createDataFrame(rows[:5], COLUMNS).write.format(store.FORMAT).mode("overwrite").save(path)
    assert sorted(r["id"] for r in spark.read.format(store.FORMAT).load(path).collect()) == [0, 1, 2, 3, 4]


def test_filters_are_pushed(spark, kept):
    path, rows = kept
    df = spark.read.format(store.FORMAT).load(path)
    some = df.where((F.col("id") >= 10) & (F.col("id") < 60) & F.col("name").isin("n1", "n2") & (F.length("name") == 2))
    assert sorted(r["id"] for r in some.collect()) == [r[0] for r in rows if 10 <= r[0] < 60 and r[1] in ("n1", "n2")]
    assert df.where("name is null").count() == sum(r[1] is None for r in rows)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "length(" in plan and "id" not in plan.split("Filter", 1)[1].split("BatchScan")[0].split("length(")[0].split("(", 1)[0]
    reader = store.Reader(df.schema, {"path": path})
    assert list(reader.pushFilters([store.GreaterThan(("id",), 990), store.EqualTo(("ok",), True), store.In(("name",), ("n1", "n3"))])) == [store.EqualTo(("ok",), True)]
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == [r[0] for r in rows if r[0] > 990 and r[1] in ("n1", "n3")]


def test_a_failed_write_adds_nothing(spark, kept):
    path, _ = kept
    before = sorted(os.listdir(path))
    bad = spark.range(100).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise("x").alias("name"))
    with pytest.raises(Exception):
        bad.repartition(4).write.format(store.FORMAT).mode("append").save(path)
    assert sorted(f for f in os.listdir(path) if not f.startswith(".")) == before
    assert spark.read.format(store.FORMAT).load(path).count() == 1000
    with pytest.raises(Exception, match="cannot be stored"):
        spark.range(2).select(F.array("id").alias("a")).write.format(store.FORMAT).mode("append").save(path)
