"""A store of SQLite files as a data source: spark.read.format("sqlite_store"), df.write.format("sqlite_store").

A store is a folder that all machines see, with a file for each task that wrote to it. A read plans a partition for each
range of rows of each file and pushes comparisons with constants into SQLite; a write leaves a file for each task under
a hidden name, and only the commit, which gives them their names, makes them part of the store: a task that runs twice, or
a job that fails, adds nothing. `register(spark)` makes the format known to a session and turns pushing on.

Options: path (the folder), table (default rows), rows (of a partition, 100,000). Columns may be booleans, whole numbers,
doubles, strings and bytes; other types raise an error when written.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT, TABLE, ROWS = "sqlite_store", "rows", 100_000
KINDS = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.BooleanType: "BOOLEAN", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
OF_KIND = {"INTEGER": T.LongType(), "BOOLEAN": T.BooleanType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db") and not f.startswith("."))


class Rows(InputPartition):
    """Rows of one file with first < rowid <= last."""

    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.fields, self.options = [(f.name, isinstance(f.dataType, T.BooleanType)) for f in schema.fields], dict(options)
        self.table = self.options.get("table", TABLE)
        self.clauses: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what SQLite decides as Spark does, and gives back the rest."""
        for f in filters:
            column = _quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            plain = lambda v: isinstance(v, (int, str)) and not isinstance(v, bool)
            if column and type(f) in COMPARISONS and plain(f.value):
                self.clauses.append((f"{column} {COMPARISONS[type(f)]} ?", [f.value]))
            elif column and isinstance(f, In) and f.value and all(map(plain, f.value)) and len(f.value) <= 500:
                self.clauses.append((f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif column and isinstance(f, (IsNotNull, IsNull)):
                self.clauses.append((f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        step, out = int(self.options.get("rows", ROWS)), []
        for file in _files(self.options["path"]):
            with closing(_open(file)) as c:
                last = c.execute(f"SELECT max(rowid) FROM {_quoted(self.table)}").fetchone()[0] or 0
            out += [Rows(file, z, min(z + step, last)) for z in range(0, last, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        if not partition.file:
            return
        where = " AND ".join(["rowid > ?", "rowid <= ?", *(c for c, _ in self.clauses)])
        values = [partition.first, partition.last, *(v for _, vs in self.clauses for v in vs)]
        with closing(_open(partition.file)) as c:
            for row in c.execute(f"SELECT {', '.join(_quoted(n) for n, _ in self.fields)} FROM {_quoted(self.table)} WHERE {where}", values):
                yield tuple(bool(v) if flag and v is not None else v for v, (_, flag) in zip(row, self.fields, strict=True))


class Written(WriterCommitMessage):
    def __init__(self, file: str):
        self.file = file


class Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options, overwrite: bool):
        self.columns = []
        for f in schema.fields:
            if type(f.dataType) not in KINDS:
                raise ValueError(f"column {f.name}: {f.dataType.simpleString()} cannot be stored")
            self.columns.append((f.name, KINDS[type(f.dataType)]))
        self.path, self.table, self.overwrite = options["path"], options.get("table", TABLE), overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        file = os.path.join(self.path, f".{uuid.uuid4().hex}.db")
        with closing(sqlite3.connect(file)) as c:
            c.execute(f"CREATE TABLE {_quoted(self.table)} ({', '.join(f'{_quoted(n)} {k}' for n, k in self.columns)})")
            c.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.columns))})", (tuple(r) for r in rows))
            c.commit()
        return Written(file)

    def commit(self, messages) -> None:
        before = _files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.replace(m.file, os.path.join(self.path, os.path.basename(m.file)[1:]))
        for f in before:
            os.remove(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.remove(m.file)


class Store(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        for file in _files(self.options["path"]):
            with closing(_open(file)) as c:
                columns = c.execute(f"PRAGMA table_info({_quoted(self.options.get('table', TABLE))})").fetchall()
            return T.StructType([T.StructField(r[1], OF_KIND[r[2]]) for r in columns])
        raise ValueError(f"the store {self.options['path']} is empty: give a schema")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Store)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
