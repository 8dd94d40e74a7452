"""Files as tables: JSON arrays, JSON lines, JDBC, source trees, and the move of a catalog from one place to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evidence

MAX_FILE = 2 << 20


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file (or folder of files) that each hold one JSON array; with a schema nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options) -> DataFrame:
    """A table over JDBC; with a key and (low, high, parts) it is read in parallel."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2])
    return r.load()


def scan_tree(spark: SparkSession, root: str, tracked: bool = True) -> DataFrame:
    """path (below root), hash, lines, content, class and admission of the files of a tree that are not excluded or too large.
    As with every file source of Spark, files and folders whose names begin with a dot or an underscore are not seen."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    path = F.expr("substring(p, length(base) + 2)")
    f = f.where(F.col("length") <= MAX_FILE).withColumn("base", base).withColumn("p", F.regexp_replace("path", "^file:/*", "/")).withColumn("path", path)
    f = f.where(~evidence.is_excluded(F.col("path"))).withColumn("text", F.decode("content", "UTF-8"))
    cls = evidence.classify(F.col("path"), F.col("text"))
    return f.select("path", F.sha2("content", 256).alias("hash"), F.size(F.split("text", "\n")).alias("lines"), "text", cls.alias("class"), evidence.admit(cls, F.lit(tracked)).alias("admission"))


def audit(files: DataFrame) -> DataFrame:
    """Files by class and reason."""
    return files.groupBy("class", "admission.reason").agg(F.count("*").alias("n"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status between two scans, by hash."""
    from millrace.operators.graph import delta

    return delta(old.select("path", "hash"), new.select("path", "hash"), ["path"], "hash")


def migrate(spark: SparkSession, tables: dict[str, str], target: str, fmt: str = "parquet") -> list[tuple[str, int, int]]:
    """Copy tables (name: path) below target; (name, rows read, rows there) of each."""
    report = []
    for name, path in tables.items():
        df = spark.read.parquet(path)
        out = f"{target.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(out)
        report.append((name, df.count(), spark.read.format(fmt).load(out).count()))
    return report
