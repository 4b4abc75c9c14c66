"""What the operators of this subpackage share: scratch tables, columns and bounded slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only on a local master, where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="tessera-"))
        base = _FALLBACK[0]
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 32) -> DataFrame:
    """A table of fewer parts than there are cores dealt anew, each part over at most ``most``; one of many parts as it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, most * parts)) if 0 < parts < cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; the documents are spread, so that a small file of them is not one task's."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator needs, null texts as empty; other columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out_fold(column) -> object:
    """True where crc32 of the id's decimal text leaves remainder 1 modulo 3."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``most_bytes`` in each; one long text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, size = 0, 0
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            n = 0 if n != n else int(n)
            if size and size + n > most_bytes:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        yield batch.slice(at)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arrow_of(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string with the plain types used here, for code that runs in tasks."""
    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, plain[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(", "))])
