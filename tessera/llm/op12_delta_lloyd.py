"""Codes of vectors by product quantization, trained by a delta-maintained Lloyd iteration.

A vector's components become integers floor(scale * x); the vector is cut into ``PARTS`` equal
consecutive parts, and each part position has a codebook of ``ENTRIES`` entries, which starts as that
part of the rows with the smallest ids. A round assigns every part to its nearest entry (squared
distance, ties to the lower index) and writes the rows with their codes, old and new. Only rows whose
code changed are read again: their parts go out of the sum of the entry they left and into that of
the entry they came to, netted in the task, so what is shuffled is at most a few thousand numbers a
task and little once assignments settle. The running sums and counts of all entries are a table that
each round's changes are added to; an entry becomes floor(sum / count), unused entries stay. All of it
is integer arithmetic, so results don't depend on the order of rows or tasks.

Defined results: vectors that are null or hold null or non-finite components are left out; the width
is that of the widest vector, rounded up to a multiple of ``PARTS``, and shorter ones count as padded
with zeros; components stop at +-2**27 after scaling, below which everything is exact for widths up
to 128; null ids come last in the choice of first entries; rows that repeat an id come in the order
of their vectors there; each row gives a row; null labels are one label; with fewer rows than
``ENTRIES`` codebooks are shorter; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import read, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256.0
MOST = 1 << 27
EXACT = 1 << 52  # whole numbers up to here are exact in double, whatever is added to them
#: Sums by label are broadcast up to this many rows; more are joined by a shuffle.
BROADCAST_LABELS = 100_000


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v, the scaled whole components of the rows that are kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bound = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * scale))
    return rows.where(F.col("x").isNotNull() & whole).select("vec_id", "label", F.transform("x", lambda x: F.floor(bound(x)).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it, for each row; exact."""
    largest = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    if x.shape[1] * largest * largest < EXACT:
        away = (x * x).sum(axis=1)[:, None] - 2.0 * (x.astype(float) @ entries.T.astype(float)) + (entries * entries).sum(axis=1)
    else:
        away = np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)
    at = away.argmin(axis=1)
    return at, away[np.arange(len(x)), at].astype(np.int64)


def assigned(state: DataFrame, book: np.ndarray) -> DataFrame:
    """Stored rows with v, was (the codes before), codes and error, the squared distances summed over parts."""
    parts, _, size = book.shape
    out = state.select("vec_id", "label", "v", F.col("codes").alias("was"))
    schema = T.StructType([*out.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), parts * size)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if len(x) else 0):
                codes[:, p], away = nearest(x[:, p * size : (p + 1) * size], book[p])
                error += away
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * parts).astype(np.int32).tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns, packed, pa.array(error)], names=[*b.schema.names, "codes", "error"])

    return stored(out.mapInArrow(run, schema), "assigned")


def changes(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, at, n, total: what the rows whose codes changed add to counts and sums, netted in each task."""
    parts, entries, size = shape
    ddl = "part int, entry int, at int, n long, total long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
        for b in batches:
            x = matrix(b.column("v"), parts * size)
            new = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            fresh = np.array(b.column("was").is_null())
            old = np.frombuffer(b"".join(w or bytes(parts) for w in b.column("was").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                moved = fresh | (old[:, p] != new[:, p])
                part = x[moved, p * size : (p + 1) * size]
                np.add.at(n[p], new[moved, p], 1)
                np.add.at(total[p], new[moved, p], part)
                left = ~fresh[moved]
                np.subtract.at(n[p], old[moved, p][left], 1)
                np.subtract.at(total[p], old[moved, p][left], part[left])
        part, entry, at = np.nonzero((total != 0) | (n != 0)[:, :, None])
        columns = [part.astype(np.int32), entry.astype(np.int32), at.astype(np.int32), n[part, entry], total[part, entry, at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "at", "n", "total"])

    return state.where("was is null or was != codes").select("v", "was", "codes").mapInArrow(run, ddl)


def first_book(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, position) made of the rows with the smallest ids; a few rows come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    size = max(1, -(-(rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 1) // parts))
    book = np.zeros((len(first), parts * size), np.int64)
    for i, r in enumerate(first):
        book[i, : len(r["v"])] = r["v"]
    return book.reshape(len(first), parts, size).transpose(1, 0, 2)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, v, codes, error) under the final codebooks, and these."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries must be 1 to 256")
    state = stored(integer_vectors(vectors, scale, id_col, vector_col, label_col), "vectors").withColumn("codes", F.lit(None).cast("binary"))
    book, sums = first_book(state, parts, entries), None
    for _ in range(rounds):
        state = assigned(state, book)
        delta = changes(state, book.shape)
        running = delta if sums is None else sums.unionByName(delta)
        sums = stored(running.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
        # parts x entries x size numbers: the model, whatever the number of vectors
        new = book.copy()
        for r in sums.where("n > 0").collect():
            new[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        book = new
    return assigned(state, book).select("vec_id", "label", "v", "codes", "error"), book


def vector_codes(vectors: DataFrame, **options: object) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256: one row for each vector that is kept."""
    rows, book = trained(vectors, **options)
    told = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    by_label = stored(rows.groupBy(F.col("label").alias("its")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "labels")
    few = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    met = rows.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("its")))
    return met.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", F.expr("try_cast(total as bigint)").alias("label_error"), F.lit(told).alias("codebooks_sha256"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings"))


def _assigned_sql(i: int) -> str:
    return f"""a{i} AS (SELECT r, p, arg_min(e, away * 64 + e) AS e, min(away) AS away FROM (SELECT t.r, p, b.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(t.x, b.x)])::BIGINT AS away
  FROM parts t JOIN b{i} b USING (p)) GROUP BY r, p)"""


def _book_sql(i: int) -> str:
    return f"""m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n
  FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i - 1} JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
b{i} AS (SELECT p, b.e, coalesce(m.x, b.x) AS x FROM b{i - 1} b LEFT JOIN m{i} m USING (p, e))"""


ORACLE = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
parts AS (SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
b0 AS (SELECT p, e, x FROM (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept) JOIN parts USING (r) WHERE e < 64),
{_assigned_sql(0)}, {_book_sql(1)}, {_assigned_sql(1)}, {_book_sql(2)}, {_assigned_sql(2)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(away)::BIGINT AS error FROM a2 GROUP BY r),
book AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS told FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, told AS codebooks_sha256 FROM kept JOIN coded USING (r), book
"""
