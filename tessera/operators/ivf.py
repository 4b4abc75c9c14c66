"""A stored vector index: coarse cells as partitions, codes of residuals, exact scores of what is left.

``build`` fits cell centres and, for each of ``parts`` parts of the residuals, a codebook on a bounded
sample (``sample`` rows, by a hash of their ids; this fits a model only); every row is then put into the partition of its nearest centre,
with its codes and its vector. ``search`` reads the partitions that some query probes and no others, of
these the codes only, deals their rows in pieces of about ``PIECE`` and keeps the best of each piece by
the coded score q.c + sum of q.r by part; the ``keep`` best of a query are then scored exactly from their vectors.

Vectors that are null, hold null or non-finite components, or have no id take no part, nor do those of
another width than the first of the sample; an id that repeats is a row for each of its vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.tables import save
from .lexical import best
from .sizes import materialized, scratch
from .vector import finite

SAMPLE, MOST_CELLS, CODES = 16_384, 1_024, 64
PIECE = 65_536


@dataclass(frozen=True)
class VectorIndex:
    """Where the rows lie, and the model: cell centres (cells, width) and codebooks (parts, codes, width / parts)."""

    path: str
    centres: np.ndarray
    codebooks: np.ndarray
    kind: str  # of the stored vectors

    def rows(self, spark: SparkSession) -> DataFrame:
        """cell (the partition), vec_id, codes, embedding."""
        return spark.read.schema(f"vec_id long, codes binary, embedding {self.kind}, cell int").parquet(f"{self.path}/rows")


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres of a few points; unused centres stay where they were."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def encoded(residuals: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    size = codebooks.shape[2]
    return np.stack([nearest(residuals[:, p * size : (p + 1) * size], b) for p, b in enumerate(codebooks)], axis=1).astype(np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, parts: int = 16, sample: int = SAMPLE) -> VectorIndex:
    """The index of all vectors, in a new folder of the scratch space or under ``path``. ``cells`` is about the square root of their number, at most ``MOST_CELLS``, unless it is given."""
    spark = vectors.sparkSession
    path = path or f"{scratch(spark)}/tessera/vectors-{uuid.uuid4().hex}"
    rows, kind = finite(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), vectors.schema["embedding"].dataType.simpleString()
    some = [r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    width = len(some[0]) if some else parts
    points = np.array([x for x in some if len(x) == width], np.float64).reshape(-1, width)
    cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
    parts = next(p for p in range(min(parts, width), 0, -1) if width % p == 0)
    centres = lloyd(points, cells)
    residuals = points - centres[nearest(points, centres)]
    size = width // parts
    codebooks = [lloyd(residuals[:, p * size : (p + 1) * size], CODES) for p in range(parts)]
    codebooks = np.stack([np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in codebooks])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"), width)
            at = nearest(x, centres)
            codes = encoded(x - centres[at], codebooks)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("embedding"), pa.array(at.astype(np.int32))], names=["vec_id", "codes", "embedding", "cell"])

    placed = rows.where(F.size("embedding") == width).mapInArrow(place, f"vec_id long, codes binary, embedding {kind}, cell int")
    save(placed, f"{path}/rows", ["cell"])
    model = [(kind, width, parts, len(centres), centres.ravel().tolist(), codebooks.ravel().tolist())]
    spark.createDataFrame(model, "kind string, width int, parts int, cells int, centres array<double>, codebooks array<double>").coalesce(1).write.parquet(f"{path}/model")
    return VectorIndex(path, centres, codebooks, kind)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was built before."""
    m = spark.read.parquet(f"{path}/model").first()
    return VectorIndex(path, np.array(m["centres"]).reshape(m["cells"], m["width"]), np.array(m["codebooks"]).reshape(m["parts"], CODES, -1), m["kind"])


def probed(queries: DataFrame, index: VectorIndex, probes: int) -> DataFrame:
    """query_id, q, cell: the ``probes`` cells whose centres have the largest inner products with each query."""
    centres, width = index.centres, index.centres.shape[1]
    ddl = f"query_id long, q {index.kind}, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("q"), width)
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            row = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(row), b.column("q").take(row), pa.array(near.ravel().astype(np.int32))], names=["query_id", "q", "cell"])

    asked = finite(queries).where(F.size("embedding") == width).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast(index.kind).alias("q"))
    return asked.mapInArrow(run, ddl)


def candidates(queries: DataFrame, index: VectorIndex, probes: int, keep: int) -> DataFrame:
    """query_id, q, cell, vec_id, score: the ``keep`` best of each query by coded scores, and some more."""
    spark, centres, codebooks = queries.sparkSession, index.centres, index.codebooks
    parts, _, size = codebooks.shape
    wanted = materialized(probed(queries, index, probes))
    cells = [r["cell"] for r in wanted.select("cell").distinct().collect()]  # at most the number of cells
    rows = index.rows(spark).where(F.col("cell").isin(cells)).select("cell", "vec_id", "codes")
    pieces = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(float(PIECE))).alias("pieces"))
    dealt = rows.join(F.broadcast(pieces), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "pieces").alias("piece"), "vec_id", "codes")
    asked = wanted.join(F.broadcast(pieces), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "query_id", "q")
    ddl = "query_id long, cell int, vec_id long, score double"

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("cell", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not held.num_rows or not asking.num_rows:
            return schema.empty_table()
        cell, ids = held.column("cell")[0].as_py(), held.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        out = []
        for query, q in zip(asking.column("query_id").to_pylist(), asking.column("q").to_pylist(), strict=True):
            q = np.array(q)
            scores = np.full(len(ids), q @ centres[cell])
            for p in range(parts):
                scores += (codebooks[p] @ q[p * size : (p + 1) * size])[codes[:, p]]
            top = np.argpartition(-scores, keep)[:keep] if len(ids) > keep else np.arange(len(ids))
            out.append(pa.table([pa.array([query] * len(top), pa.int64()), pa.array([cell] * len(top), pa.int32()), pa.array(ids[top]), pa.array(scores[top])], schema=schema))
        return pa.concat_tables(out)

    found = asked.groupBy("cell", "piece").cogroup(dealt.groupBy("cell", "piece")).applyInArrow(lambda a, b: run(b, a), ddl)
    return found.where("vec_id != query_id")


def search(queries: DataFrame, index: VectorIndex, k: int, probes: int, keep: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: approximately the k largest inner products, scores exact to nine places; a query's own id is left out, ties go to the smaller id."""
    spark = queries.sparkSession
    keep = keep or 20 * k
    few = materialized(best(candidates(queries, index, probes, keep + 1).select("query_id", F.struct("vec_id", "cell").alias("row"), "score"), keep, "query_id", "row").select("query_id", "row.vec_id", "row.cell").distinct())
    cells = [r["cell"] for r in few.select("cell").distinct().collect()]
    vectors = index.rows(spark).where(F.col("cell").isin(cells)).select("cell", "vec_id", "embedding")
    asked = finite(queries).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    scored = few.join(vectors, ["cell", "vec_id"]).join(asked, "query_id").select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("embedding")), 9).alias("score"))
    return best(scored.where("score is not null"), k, "query_id", "vec_id")
