"""Event-time counts and deduplication with watermarks. Session time zone UTC is assumed."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on a wall-clock column (watermarks need an instant)."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def daily_changes(stream: DataFrame, delay: str, ts="ts") -> DataFrame:
    """History points per day; append mode emits a day once the watermark passes its end.

    ``delay`` is how late a row may come after a newer one; later rows do not count.
    """
    return (with_event_time(stream, ts, delay).groupBy(F.window(ts, "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"))


def snapshot_dedup(stream: DataFrame, keys: Sequence[str], delay: str, ts="ts") -> DataFrame:
    """First arrival of every key; a repeat that comes more than ``delay`` after it passes again."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))
