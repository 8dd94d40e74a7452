"""Token buckets: a fold for batches, and a stateful operator for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_fold(events: Column, rate: float, burst: float, cost: float = 1.0) -> Column:
    """events: array<struct<s: seconds, ..>> in order. Struct<tokens, last, allowed, refused>."""

    def step(a, e):
        now = F.least(F.lit(burst), a["tokens"] + F.coalesce(e["s"] - a["last"], F.lit(0.0)) * rate)
        ok = now >= cost
        return F.struct(F.when(ok, now - cost).otherwise(now).alias("tokens"), e["s"].alias("last"), (a["allowed"] + ok.cast("long")).alias("allowed"), (a["refused"] + (~ok).cast("long")).alias("refused"))

    zero = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("refused"))
    return F.aggregate(events, zero, step)


def allow(tokens: float, last: float | None, now: float, rate: float, burst: float, cost: float = 1.0) -> tuple[bool, float, float]:
    """(allowed, tokens left, seconds to wait)."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate) if last is not None else tokens
    if tokens >= cost:
        return True, tokens - cost, 0.0
    return False, tokens, max(0.001, (cost - tokens) / rate)


def limit_stream(events: DataFrame, key: str, seconds: str, rate: float, burst: float) -> DataFrame:
    """key, s, allowed, remaining, retry_after for a stream of (key, seconds): one bucket of state for each key."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        for pdf in frames:
            out = []
            for s in sorted(pdf[seconds]):
                ok, tokens, wait = allow(tokens, last, s, rate, burst)
                last = s if last is None else max(last, s)
                out.append((k[0], s, ok, int(tokens), wait))
            yield pd.DataFrame(out, columns=[key, "s", "allowed", "remaining", "retry_after"])
        state.update((tokens, last))

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, s double, allowed boolean, remaining long, retry_after double", "tokens double, last double", "append", "NoTimeout")
