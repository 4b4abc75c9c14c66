"""Runs a stream over what there is now and gives the rows that its sink holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators import live
from ..operators.sizes import scratch


#: Settings of a stream with state of its own kind.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] = lambda batch: batch, arrivals: Sequence[Callable[[], None]] = (lambda: None,), settings: Mapping[str, str] | None = None) -> DataFrame:
    """Rows the stream has written when its sources are used up.

    append and update write each batch once, whatever is retried; complete keeps the last batch only.
    ``each`` makes of a batch what is written. The stream runs after each of ``arrivals``, going on
    from its checkpoint, so these can add to its sources. ``settings`` hold for the session while it runs."""
    spark = stream.sparkSession
    base = f"{scratch(spark)}/tessera/stream-{uuid.uuid4().hex}"

    written: list[int] = []  # numbers of batches, on the driver

    def put(batch: DataFrame, number: int) -> None:
        written.append(number)
        each(batch).write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        for arrive in arrivals:
            arrive()
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    path = f"{base}/out/all" if mode == "complete" else f"{base}/out"
    if not written:  # no batch came
        return each(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(path).drop("batch")


def indexed(documents: DataFrame, path: str, merge_at: int = 8, shard: int = live.SHARD) -> None:
    """Adds what has come of a stream of documents (doc_id, text) to the live index in ``path``, a segment for each batch.

    The stream goes on from its checkpoint, which lies with the index, so each call adds only what is new; a batch that is
    run again takes the place of its first run. When there are ``merge_at`` small segments they are merged."""
    spark = documents.sparkSession
    live.create(spark, path)

    def put(batch: DataFrame, number: int) -> None:
        live.add(path, batch, f"batch-{number:09}", shard)
        if live.small_segments(spark, path, shard).count() >= merge_at:
            live.merge(spark, path, shard, shard)

    documents.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
