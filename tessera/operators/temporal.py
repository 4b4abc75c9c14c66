"""Joins on time and ranges without pairing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its ``by`` at or before its ``on``.

    Both sides go through one sort: a running last value over their union."""
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(by, on, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    order = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = both.unionByName(other, allowMissingColumns=True).withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(order))
    return joined.where("_side = 1").drop("_side", "_v")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): both sides are cut into buckets of ``width`` and joined on the bucket."""
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    met = points.withColumn("_bucket", bucket(F.col(at))).join(spread, "_bucket")
    return met.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def sessions(events: DataFrame, gap_minutes: int = 30, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions of a key: gaps of ``gap_minutes`` or more start a new one."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    seconds: Column = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    new = (seconds.isNull() | (seconds >= gap_minutes * 60_000_000)).cast("int")
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(order))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
