"""Incremental keyed merge on Structured Streaming.

``incremental_merge`` (T1): landed files -> ``foreachBatch`` -> per-batch dedupe
and upsert into a date-partitioned table. A batch's rows are stored beside the table, and waiting
batches are merged together after 16, 64, 256 ... of them, and
when the drain ends, also if it fails: what is written grows with what has landed, not with the
table times the batches. Only the partitions that waiting rows touch are rewritten, and the merge
compares load versions (``order_proof``), so files
arriving out of load order, a retried batch or a batch replayed after a driver
restart all leave the same table. ``trigger(availableNow=True)`` drains what has
landed and stops, which is how a daily job runs it. A batch is written once and read from
there, so its source is scanned once. Rows that a source sends again, whole pages as a rule,
can be dropped by state before the merge (``resent_within``).

``latest_state_stream`` (T2): a streaming aggregate keeps the latest row per key
in the state store (``max_by`` over the version order) and emits changed keys
in update mode; each micro-batch upserts them as above. State grows with the number of
keys. Unless the session names a ``spark.sql.streaming.stateStore.providerClass``, it is kept in
RocksDB, which spills and writes only what a batch changes; it is dealt into as many
partitions as the landed files call for, at most ``spark.sql.shuffle.partitions``, since each
writes a file per batch. ``state_delay`` bounds it
(event-day watermark) when very late loads may be dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerline.operators.latest import OrderTerm, _check_order
from ledgerline.operators.merge import dedupe_batch
from ledgerline.session import checkpoint_root
from ledgerline.sources.sinks import add_pending, landed_bytes, merge_pending

#: Batches that wait before they are merged for the first time.
FIRST_MERGE = 16
#: Landed bytes per partition of the state.
STATE_BYTES = 64 << 20
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def _upsert_batch(batch: DataFrame, target_path: str, keys, order, stream: str, batch_id: int) -> None:
    """Upsert one micro-batch: its rows wait beside the table until ``_Merges`` merges them."""
    add_pending(dedupe_batch(batch, list(keys), list(order)), target_path, stream, batch_id)


class _Merges:
    """The merges of the waiting batches of one drain."""

    def __init__(self, spark: SparkSession, target_path: str, keys, order, partition_col: str):
        self.table = spark, target_path, list(keys), list(order), partition_col
        self.added, self.next = 0, FIRST_MERGE

    def added_one(self) -> None:
        self.added += 1
        if self.added >= self.next:
            merge_pending(*self.table)
            self.next = 4 * self.added

    def drain(self, start: Callable[[], StreamingQuery]) -> None:
        """Run a query to its end; what it has stored is merged even if it fails."""
        query = start()
        try:
            query.awaitTermination()
        finally:
            merge_pending(*self.table)


def _stream_name(checkpoint_path: str) -> str:
    """What tells the batches of a stream from those of others into the same table."""
    return "s" + hashlib.sha256(checkpoint_path.encode()).hexdigest()[:16]


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """Session settings for a query that is started inside (it keeps a copy), put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _state_settings(spark: SparkSession, source_path: str) -> dict[str, str]:
    wanted = max(spark.sparkContext.defaultParallelism, -(-landed_bytes(spark, source_path) // STATE_BYTES))
    settings = {"spark.sql.shuffle.partitions": str(min(wanted, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    named = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    return settings | {k: v for k, v in ROCKSDB.items() if named is None and spark.conf.get(k, None) is None}


def without_resent(stream: DataFrame, event_col: str, within: str) -> DataFrame:
    """``stream`` without rows that came before, all columns alike, with an event time of at most
    ``within`` ago. State holds 128 bits of hashes per row of that time and no more. As with any
    watermark, rows older than the newest event time less ``within`` are left out as well."""
    cols = [F.col(f"`{c}`") for c in stream.columns]
    digests = {"__digest_1": F.xxhash64(*cols), "__digest_2": F.xxhash64(F.lit(1), *cols)}
    return (stream.withColumn("__event", F.col(f"`{event_col}`").cast("timestamp")).withColumns(digests)
                  .withWatermark("__event", within).dropDuplicatesWithinWatermark(list(digests))
                  .drop("__event", *digests))


def incremental_merge(spark: SparkSession, source_path: str, schema: StructType, target_path: str,
                      keys: Sequence[str], order: Sequence[OrderTerm], partition_col: str,
                      checkpoint_path: str, max_files_per_trigger: int | None = None,
                      transform=None, resent_within: str | None = None) -> None:
    """Drain the landed files at ``source_path`` into the table at ``target_path``. With
    ``resent_within`` (e.g. ``"3 days"``) rows sent again in that time are dropped before the merge;
    without it they are merged, with the same result, and no late row is lost."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_path)
    if transform is not None:
        stream = transform(stream)

    if resent_within is not None:
        stream = without_resent(stream, partition_col, resent_within)

    merges, name = _Merges(spark, target_path, keys, order, partition_col), _stream_name(checkpoint_path)

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        checkpoint_root(spark)
        _upsert_batch(batch.checkpoint(), target_path, keys, order, name, batch_id)
        merges.added_one()

    merges.drain(stream.writeStream.foreachBatch(merge_batch)
                       .option("checkpointLocation", checkpoint_path)
                       .trigger(availableNow=True)
                       .start)


def latest_state_stream(spark: SparkSession, source_path: str, schema: StructType, target_path: str,
                        keys: Sequence[str], order: Sequence[OrderTerm], partition_col: str,
                        checkpoint_path: str, max_files_per_trigger: int | None = None,
                        state_delay: str | None = None, transform=None) -> None:
    """Keep the latest row per key in streaming state and upsert changed keys each batch.

    ``state_delay`` (e.g. ``"3 days"``) bounds the state: the day of ``partition_col`` becomes
    an event-time grouping key with that watermark, so state of days older than the newest
    day seen minus the delay is dropped, and rows arriving later than that for those days are
    ignored. Without it no row is ever dropped and state grows with the keys.
    """
    _check_order(order)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_path)
    if transform is not None:
        stream = transform(stream)
    cols = stream.columns
    group = list(keys)
    if state_delay is not None:
        # event time in the grouping keys is what lets the watermark evict state
        stream = (stream.withColumn("__event_day", F.col(partition_col).cast("timestamp"))
                        .withWatermark("__event_day", state_delay))
        group = group + ["__event_day"]
    payload = [c for c in cols if c not in keys]
    ordering = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, (c, _) in enumerate(order)])
    latest = (stream.groupBy(*group)
                    .agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in payload]), ordering).alias("__row"))
                    .select(*keys, *[F.col("__row").getField(c).alias(c) for c in payload]))

    merges, name = _Merges(spark, target_path, keys, order, partition_col), _stream_name(checkpoint_path)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # read once, so the state update runs once
        _upsert_batch(batch, target_path, keys, order, name, batch_id)
        merges.added_one()

    with _settings(spark, _state_settings(spark, source_path)):
        started = (latest.writeStream.outputMode("update").foreachBatch(upsert)
                         .option("checkpointLocation", checkpoint_path)
                         .trigger(availableNow=True)
                         .start())
    merges.drain(lambda: started)
