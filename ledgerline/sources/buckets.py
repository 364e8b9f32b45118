"""Keyed tables in hash buckets: a merge writes what it brings, reads pick the latest.

A table's rows lie in folders ``_bucket=<n>``, chosen by a hash of the key. ``merge`` appends a
batch's rows as delta files to the buckets of their keys; nothing that is stored is read or
rewritten for it, so a merge costs its batch, however large the table is. ``read`` keeps the
latest row per key, by the same order in which batches compare, so a batch that is merged twice,
or an older one after a newer, changes nothing. A bucket that has gathered more than
``most_files`` files is compacted: read, reduced to one row per key, and replaced; others are
left as they are.

``insert`` is the other way to write a declared table: it adds rows under a primary key, and a
key that is NULL, comes twice or is there already fails the job before anything is stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.latest import OrderTerm, latest_per_key
from ledgerline.operators.merge import dedupe_batch
from ledgerline.schemas import conform
from ledgerline.sources.sinks import children, fresh_read, overwrite_partitions

BUCKET = "_bucket"
#: Buckets of a table and files that a bucket gathers before it is compacted. A bucket should
#: fit a few tasks: a table of more than a few terabytes is declared with more of them.
BUCKETS, MOST_FILES = 32, 8


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    return any(c.startswith(f"{BUCKET}=") for c in children(spark, path))


def read(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[OrderTerm]) -> DataFrame:
    """The table: the latest row of each key."""
    return latest_per_key(fresh_read(spark, path).drop(BUCKET), keys, order)


def merge(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence[OrderTerm],
          buckets: int = BUCKETS, most_files: int = MOST_FILES) -> list[int]:
    """Upsert a batch; tells which buckets were compacted."""
    rows = dedupe_batch(incoming, keys, order).withColumn(BUCKET, bucket_of(keys, buckets))
    rows.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    return compact(incoming.sparkSession, path, keys, order, most_files)


def files(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Data files of each bucket. One listing per bucket, no job."""
    return {int(c.removeprefix(f"{BUCKET}=")): sorted(x for x in children(spark, f"{path.rstrip('/')}/{c}") if not x.startswith(("_", ".")))
            for c in children(spark, path) if c.startswith(f"{BUCKET}=")}


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[OrderTerm],
            most_files: int = MOST_FILES) -> list[int]:
    """Rewrite the buckets that hold more than ``most_files`` files, one row per key."""
    full = sorted(b for b, names in files(spark, path).items() if len(names) > most_files)
    if full:
        rows = fresh_read(spark, path).filter(F.col(BUCKET).isin(full))
        # a key lies in one bucket, so the bucket may be part of what is grouped by
        overwrite_partitions(latest_per_key(rows, [BUCKET, *keys], order), path, BUCKET)
    return full


def insert(spark: SparkSession, rows: DataFrame, path: str, schema: StructType, key: Sequence[str],
           buckets: int = BUCKETS) -> None:
    """Add rows to a table declared with ``schema`` and the primary key ``key``. The check runs in
    the job that writes: its shuffle is the one by bucket and key, and stored keys are read from
    the touched buckets only."""
    key = list(key)
    new = conform(rows, schema).withColumn(BUCKET, bucket_of(key, buckets))
    times = F.count(F.lit(1)).over(Window.partitionBy(BUCKET, *[F.col(f"`{k}`") for k in key]))
    marked = new.withColumn("__bad", (times > 1) | F.greatest(*[F.col(f"`{k}`").isNull() for k in key], F.lit(False)))
    if exists(spark, path):
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]   # at most one per bucket
        there = (fresh_read(spark, path).filter(F.col(BUCKET).isin(touched))
                 .select(BUCKET, *[F.col(f"`{k}`") for k in key]).distinct().withColumn("__there", F.lit(True)))
        marked = marked.join(there, [BUCKET, *key], "left").withColumn("__bad", F.col("__bad") | F.coalesce("__there", F.lit(False)))
    told = F.concat(F.lit(f"primary key ({', '.join(key)}) violated: "),
                    F.to_json(F.struct(*[F.col(f"`{k}`") for k in key]), {"ignoreNullFields": "false"}))
    first = F.when(F.col("__bad"), F.raise_error(told).cast(schema[key[0]].dataType)).otherwise(F.col(f"`{key[0]}`"))
    out = marked.withColumn(key[0], first).select(*[F.col(f"`{f.name}`") for f in schema.fields], BUCKET)
    out.write.mode("append").partitionBy(BUCKET).parquet(path)
