"""Packing along a space-filling curve.

A document's vector is its hashed token counts; a random projection takes it to ``DIMENSIONS``
numbers, of which only the direction counts. The point's index on a Hilbert curve orders the
documents: neighbours on the curve lie close together. Documents, in the order (Hilbert key, row),
form one long line of tokens that is cut every ``length`` tokens, so only the last sequence is not
full and documents share a sequence with their neighbours on the curve.

The ids are encoded once and stored. Only key, row and token count are sorted by range; each range
gets a running sum, and the ranges' totals (one number each) give where a range starts. The starts
go back to the ids by an equi-join on the row, whose key is unique.

Defined results: null and empty texts have only the end id; repeated rows and ids are packed as
often as they occur, next to each other, as equal texts have equal keys; an empty table gives no
piece; other columns of the input are not read. Every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import default_path, library, with_end, word_memo
from .shared import arrow_of, id_and_text, read, slices, stored

DIMENSIONS, BITS = 4, 12
BUCKETS = 1024
LENGTH = 4096
SLICE_BYTES = 1 << 20


def projection(n_ids: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """What one occurrence of each id adds to the projected vector: its bucket's row, with a hashed sign."""
    ids = np.arange(n_ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket, sign = (ids >> np.uint64(20)) % np.uint64(BUCKETS), np.where((ids >> np.uint64(63)) == 1, -1, 1)
    rows = np.random.default_rng(7).standard_normal((BUCKETS, dimensions))
    return (rows[bucket.astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points (n, d) with ``bits``-bit coordinates (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document; ``sizes`` are at least 1."""
    sums = np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
    norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    unit = sums / np.where(norm > 0, norm, 1)
    return hilbert_key(np.clip(((unit + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """row (unique), doc_id, n_tokens, curve key and little-endian ids of each document, stored; two bytes an id where the vocabulary allows."""
    ddl = "row long, doc_id long, n_tokens long, key long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, schema, table = word_memo(path), arrow_of(ddl), projection(library(path).get_vocab_size() + end + 1)
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        for b in slices(batches, "text", SLICE_BYTES):
            flat, sizes = with_end(*memo.ids(b.column("text").to_pylist()), end)
            raw = np.ascontiguousarray(flat, flat.dtype.newbyteorder("<"))
            offsets = np.concatenate([[0], np.cumsum(raw.itemsize * sizes)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
            yield pa.record_batch([pa.array(np.arange(row, row + len(sizes))), b.column("doc_id"), pa.array(sizes), pa.array(curve_keys(flat, sizes, table)), ids], schema=schema)
            row += len(sizes)

    return stored(id_and_text(docs).mapInArrow(run, ddl), "encoded")


def line_starts(keys: DataFrame) -> DataFrame:
    """Where each row's tokens start on the line that the order (key, row) makes of all rows."""
    ddl = "row long, range int, inside long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, before = arrow_of(ddl), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.record_batch([b.column("row"), b.column("range"), pa.array(ends - n), b.column("n_tokens")], schema=schema)
            before = int(ends[-1]) if len(ends) else before

    ordered = keys.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    ranges = stored(ordered.select("row", "n_tokens", F.spark_partition_id().alias("range")).mapInArrow(run, ddl), "ranges")
    # one row a range, so one small task and a broadcast that grows with the number of ranges only
    totals = ranges.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    firsts = totals.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return ranges.join(F.broadcast(firsts), "range").select("row", (F.col("first") + F.col("inside")).alias("at"))


def pack_documents(docs: DataFrame, path: str, end: int = 2, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, ids."""
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    table = encoded(docs, path, end)
    # a sort-merge join at every size: the starts are as many as the documents
    placed = table.drop("key").join(line_starts(table.select("row", "key", "n_tokens")).hint("merge"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_of(ddl)
        for b in slices(batches, "ids", 2 * SLICE_BYTES):
            out: list[tuple] = []
            for doc, n, raw, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "at")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for sequence in range(at // length, (at + n - 1) // length + 1):
                    a, z = max(at, sequence * length) - at, min(at + n, (sequence + 1) * length) - at
                    out.append((doc, a, z - a, zlib.crc32(ids[a:z].tobytes()), n, sequence, at + a - sequence * length, *([ids[a:z].astype(np.int32)] * with_ids)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return placed.select("doc_id", "n_tokens", "ids", "at").mapInArrow(run, ddl)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ids in order and the documents they come from; a group has at most ``length`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_path(), with_ids=False)
