"""Broadcasting behind a size check, and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST_ROWS, MOST_BROADCAST_BYTES = 100_000, 32 << 20
_FALLBACK: list[str] = []


def is_small(df: DataFrame, most: int = MOST_BROADCAST_ROWS, most_bytes: int = MOST_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``most`` rows and these, written out, at most ``most_bytes``."""
    size = df.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")).first()
    return size["n"] <= most and size["bytes"] <= most_bytes


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is, for a shuffled join.

    ``df`` is run for the check and again in the join: give what is read from a table, not what costs."""
    return F.broadcast(df) if is_small(df, most) else df


def spread(df: DataFrame, most: int = 32) -> DataFrame:
    """A table of fewer parts than there are cores dealt anew, each part over at most ``most``; one of many parts as it is.

    For work on texts that costs far more than their shuffle."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, most * parts)) if 0 < parts < cores else df


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own only on a local master, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="tessera-"))
        base = _FALLBACK[0]
    return base.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """Written and read back: cuts the lineage and survives the loss of executors."""
    path = f"{scratch(df.sparkSession)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
