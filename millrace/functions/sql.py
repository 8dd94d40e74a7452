"""Functions of the engine for SQL: registered as SQL functions of a session, so their bodies are planned like Columns."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "mill_tokens(x STRING) RETURNS ARRAY<STRING>": "filter(split(regexp_replace(lower(x), '[^a-z0-9_]+', ' '), ' '), t -> length(t) >= 2)",
    "mill_overlap(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_distinct(a)) END",
    "mill_words(x STRING) RETURNS INT": "size(filter(split(x, '[ \\\\t\\\\n\\\\r\\\\f]+'), w -> w <> ''))",
}


def register(spark: SparkSession, functions: dict[str, str] | None = None) -> list[str]:
    """Names of the functions that SQL of this session can call from now on; users pass their own in the same form."""
    for head, body in (FUNCTIONS if functions is None else functions).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in (FUNCTIONS if functions is None else functions)]
