"""Structured Streaming over the events: windowed aggregates, sessions, running usage, ingest with derived memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """window, event_type, n, total; rows later than the watermark are dropped by Spark."""
    e = events.withWatermark("ts", watermark)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_windows(events: DataFrame, gap: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    e = events.withWatermark("ts", watermark)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))


def running_usage(events: DataFrame) -> DataFrame:
    """Totals by user and month, for update mode."""
    return events.groupBy("user_id", F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def quota_alerts(usage: DataFrame, quota: float, share: float = 0.8) -> DataFrame:
    return usage.where(F.col("total") >= share * quota)


def normalise(raw: DataFrame, payload: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns out of a JSON payload: for each name the first alias that is there and not empty."""
    for name, keys in aliases.items():
        raw = raw.withColumn(name, F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in keys]))
    return raw


def derived_memories(events: DataFrame, text: str = "text", kind: str = "event_type") -> DataFrame:
    """A failure or an observation out of each event with text, cut to their lengths."""
    failed = F.col(kind).isin("error", "failure", "tool_failure")
    return events.where(F.length(F.trim(F.col(text))) > 0).select("*", F.when(failed, "failure").otherwise("observation").alias("kind"), F.when(failed, F.substring(text, 1, 800)).otherwise(F.substring(text, 1, 500)).alias("content"))


def ingest(events: DataFrame, path: str, checkpoint: str, text: str = "text"):
    """Append events and the memories derived from them, batch by batch; ends when the input at hand is read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{path}/events")
        derived_memories(batch, text).write.mode("append").parquet(f"{path}/memories")

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
