"""Queries of the dialect over streams: the rendered SQL is plain Spark SQL, so streaming frames may stand in the scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Events by window and key of a batch or stream; ``late``: how long a stream waits for late events."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    spans = F.window(time, size, slide) if slide else F.window(time, size)
    return stamped.groupBy(spans.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late) if events.isStreaming else stamped


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """start, end, key and n of each session: events of a key with less than ``gap`` between neighbours."""
    spans = F.session_window(time, gap).alias("w")
    counted = _timed(events, time, late).groupBy(spans, key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def without_repeats(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One event of each key; a stream forgets a key after ``late``."""
    stamped = _timed(events, time, late)
    return stamped.dropDuplicatesWithinWatermark(keys) if events.isStreaming else stamped.dropDuplicates(keys)


def joined_within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str = "0 seconds") -> DataFrame:
    """Pairs of a key whose right event is at most ``within`` after the left one; other column names must differ. Streams keep only what can still match."""
    a, b = _timed(left, left_time, late), _timed(right, right_time, late).withColumnRenamed(key, "_key")
    near = F.col(right_time).between(F.col(left_time), F.col(left_time) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col("_key")) & near).drop("_key")
