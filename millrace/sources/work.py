"""The shared working folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, which is set to a local one only where it is unset and the master is local, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return conf or got.get()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a shared folder for intermediate tables")
        conf = "file://" + tempfile.mkdtemp(prefix="millrace-")  # one machine: tests and examples
    spark.sparkContext.setCheckpointDir(conf)
    return conf


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that no executor and no driver ever holds whole. Spark judges a table by the size of its files, and
    one of a few MB of well-packed Parquet may be a million rows, which it would send through the driver."""
    return df.hint("merge")


def sent(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df as the small side of a join: whole to every task where its rows are counted to be few, else by a shuffle."""
    return df.hint("broadcast") if df.limit(most + 1).count() <= most else shuffled(df)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as there are cores, where it is read from fewer files than that; else as it is. For columns
    that are costly to work on: a table of one file and one row group would be one task's."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


#: A task is dealt about so many rows of a table that is sorted whole.
ROWS = 1_500_000


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by the columns `by` to as many tasks as its rows, which are counted, need at ROWS a task, and to one for each core at
    least. For what is sorted whole: the memory of a task then follows neither how files are cut into row groups nor the
    session's number of shuffle partitions, and tasks of rows that pack well are not joined into a large one by their bytes."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(n, *by)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hold Arrow batches of this session to a few thousand rows: documents are long, and a batch is held several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is written within has Arrow batches of so many rows at most; after it they are as they were."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
