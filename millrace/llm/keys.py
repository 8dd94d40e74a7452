"""Row keys, checked broadcasts and shared folders for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.sources.work import table, work_dir

__all__ = ["fresh", "table", "text_key", "work_dir"]


def fresh(df_columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (case-blind)."""
    taken = {c.lower() for c in df_columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(text: Column) -> Column:
    """A 64-bit value of a text; with the document's id it names a row (rows equal in both are alike)."""
    return F.xxhash64(text)
