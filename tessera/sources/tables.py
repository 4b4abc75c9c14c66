"""Parquet tables in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Schemas of the tables that streams read, where a schema must be known beforehand.
SCHEMAS = {
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; filters and column choices made on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write Parquet, with a folder for each value of ``partition_by``.

    Rows are rebalanced by these columns first, so a value gets few files and a frequent one several."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Write a table of the catalog under ``path``, in ``buckets`` buckets of ``by`` that are sorted by it, and give it back.

    Tables of equal buckets join on ``by`` without a shuffle of either. Rows are dealt to the buckets
    first, so each is one file."""
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def stream(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The table as a stream of the files in its folder, or of the one file.

    A file source needs a pattern to take a single file; this one fits the exact name only."""
    return spark.readStream.schema(schema or SCHEMAS[name]).parquet(f"{folder}/{name}.parque[t]")
