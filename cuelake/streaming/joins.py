"""Streams that meet other streams, or themselves. Watermarks bound what a query has to keep; all work on batches too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_within(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first of the events with equal keys that come within the watermark of each other; on a batch, the first of all."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def near_pairs(left: DataFrame, right: DataFrame, key: str, within: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of both streams (key, ts, value) with equal keys, the right one at most ``within`` after the left. The bound on time lets the state of
    both sides be dropped."""
    a = left.withWatermark("ts", late).select(F.col(key), F.col("ts").alias("left_ts"), F.col("value").alias("left_value"))
    b = right.withWatermark("ts", late).select(F.col(key).alias("__key"), F.col("ts").alias("right_ts"), F.col("value").alias("right_value"))
    timely = (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & timely).drop("__key")
