"""Count-min sketches (Cormode and Muthukrishnan 2005): counts of any key from a table of fixed size, never too low."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1  # fixed value of the sketch's hash


def count_min(rows: DataFrame, key: str, error: float = 0.0001, confidence: float = 0.99, seed: int = 7) -> bytes:
    """The sketch of a long column. Its size follows from ``error`` and ``confidence`` only; tasks make sketches that are then added up."""
    return bytes(rows.agg(F.count_min_sketch(F.col(key).cast("long"), F.lit(error), F.lit(confidence), F.lit(seed)).alias("s")).first()["s"])


def opened(sketch: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows counted, the factors of its hashes, and its table."""
    _, total, depth, width = struct.unpack(">iqii", sketch[:20])
    numbers = np.frombuffer(sketch, ">i8", offset=20).astype(np.int64)
    return total, numbers[:depth], numbers[depth : depth + depth * width].reshape(depth, width)


def estimates(sketch: bytes, keys: np.ndarray) -> np.ndarray:
    return np.take_along_axis(opened(sketch)[2], _cells(sketch, keys), axis=1).min(axis=0)


def _cells(sketch: bytes, keys: np.ndarray) -> np.ndarray:
    """The cell of each key (columns) in each row of the table."""
    _, factors, table = opened(sketch)
    with np.errstate(over="ignore"):
        hashed = factors[:, None] * keys.astype(np.int64)[None, :]
        hashed = (hashed + (hashed >> 32)) & PRIME
    return hashed % table.shape[1]


def count_min_estimate(key: Column, sketch: bytes) -> Column:
    """The sketch's count of each key, at least the true one and beyond it by ``error`` times all rows at most, with ``confidence``; null for null."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            known = keys.notna().to_numpy()
            yield pd.Series(estimates(sketch, keys.fillna(0).to_numpy().astype(np.int64)), dtype="Int64").where(known)

    return run(key.cast("long"))


def count_min_exact(keys: DataFrame, rows: DataFrame, key: str, sketch: bytes) -> DataFrame:
    """key (long, not null), n: the true count in ``rows`` of each of ``keys``, from the sketch of ``rows``.

    The sketch is right for a key that has one of its cells for itself among all keys of either table. Those
    that meet others in all their cells, which are few as long as the sketch is fine for the keys, are counted in the
    rows themselves."""

    @F.pandas_udf("array<int>")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(_cells(sketch, b.to_numpy()).T.astype(np.int32)), dtype=object)

    own = lambda df, name: df.select(F.col(name).cast("long").alias("key")).where("key is not null")
    name = keys.columns[0]
    every = own(keys, name).unionAll(own(rows, key)).distinct()
    at = every.select("key", F.posexplode(cells("key")).alias("row", "cell"))
    alone = at.groupBy("row", "cell").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("key").distinct()
    asked = own(keys, name).distinct()
    sure = asked.join(alone, "key", "left_semi").select("key", count_min_estimate(F.col("key"), sketch).alias("n"))
    rest = asked.join(alone, "key", "left_anti")
    counted = own(rows, key).join(rest, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    return sure.unionByName(rest.join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
