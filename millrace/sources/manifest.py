"""Manifests of a source tree as versioned snapshots: a folder for each version, and a marker that commits it.

A save writes its rows into a new folder first and then creates the marker of the next version, which fails where another
writer was faster; so readers see whole versions only, and what a lost writer left is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, hash string, size long, language string, symbol_hash string, dependency_hash string"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first: a marker each, so the list grows with the saves and not with the tree."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/_commits")
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))


def _marker(spark: SparkSession, root: str, version: int) -> dict:
    fs, p = _fs(spark, f"{root.rstrip('/')}/_commits/{version}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def save(files: DataFrame, root: str, revision: str, expected: int | None = None) -> int:
    """Commit files (columns of SCHEMA, missing ones null) as the version after `expected` (by default the newest)."""
    from pyspark.sql import functions as F

    spark, root = files.sparkSession, root.rstrip("/")
    last = expected if expected is not None else max(versions(spark, root), default=0)
    names = [c.split() for c in SCHEMA.split(", ")]
    folder = f"v{last + 1}-{uuid.uuid4().hex}"
    files.select(*[(F.col(n) if n in files.columns else F.lit(None)).cast(t).alias(n) for n, t in names]).write.parquet(f"{root}/{folder}")
    fs, p = _fs(spark, f"{root}/_commits/{last + 1}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:  # the file system's own kinds of "is there already"
        if fs.exists(p):
            raise Conflict(f"version {last + 1} is committed already") from e
        raise
    try:
        out.write(bytearray(json.dumps({"folder": folder, "revision": revision}).encode()))
    finally:
        out.close()
    return last + 1


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files of a version, by default the newest; none where nothing is committed."""
    known = versions(spark, root)
    if version is None and not known:
        return spark.createDataFrame([], SCHEMA)
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"no version {version}")
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/{_marker(spark, root, version)['folder']}")


def revision(spark: SparkSession, root: str) -> str | None:
    known = versions(spark, root)
    return _marker(spark, root, known[-1])["revision"] if known else None
