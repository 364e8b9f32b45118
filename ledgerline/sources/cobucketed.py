"""Tables bucketed alike by their key, which join without a shuffle.

Two tables that are read together again and again (loans and their newest balances) are written
with the same number of buckets on the key and sorted by it. Each later join pairs bucket with
bucket where it lies. ``write`` shuffles once, when the table is made; ``upsert`` shuffles only
the batch and leaves the stored side in place.

Tables are external ones of the session's catalog, their files under a folder that the caller
names. A version is a table of its own: readers of the old one are not disturbed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.latest import OrderTerm
from ledgerline.operators.merge import dedupe_batch

#: A bucket is one task of every later join: give large tables more, and both sides as many.
BUCKETS = 32


def _save(df: DataFrame, table: str, path: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    df.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def write(df: DataFrame, table: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Store ``df``. Rows are dealt by the hash that buckets go by, so a bucket is one file."""
    return _save(df.repartition(buckets, F.col(f"`{key}`")), table, path, key, buckets)


def upsert(spark: SparkSession, stored: str, incoming: DataFrame, table: str, path: str, key: str,
           order: Sequence[OrderTerm], buckets: int = BUCKETS) -> DataFrame:
    """``stored`` (one row per key) with the batch's newer rows, as the table ``table``.

    Of a key's rows the greatest by ``order`` (descending, NULLs last) stays, the batch's one on a
    tie. The stored side is read bucket by bucket; a NULL key is a key like any other.
    """
    old, cols = spark.table(stored), spark.table(stored).columns
    new = dedupe_batch(incoming.select(*cols), [key], order)
    named = F.col(f"`{key}`").isNotNull()
    # a task of the join holds one bucket and writes it: the stored rows are not dealt anew
    _save(newer(old.filter(named), new.filter(named), key, order), table, path, key, buckets)
    nameless = dedupe_batch(old.filter(~named).withColumn("__side", F.lit(0)).unionByName(new.filter(~named).withColumn("__side", F.lit(1))),
                            [key], [*order, ("__side", "desc")]).drop("__side")      # one row at most
    _save(nameless, table, path, key, buckets, mode="append")
    return spark.table(table)


def newer(old: DataFrame, new: DataFrame, key: str, order: Sequence[OrderTerm]) -> DataFrame:
    """The greater row of each key that is not NULL; both sides have one row per key."""
    cols = old.columns
    as_row = lambda df, name: df.select(F.col(f"`{key}`").alias(f"__{name}_key"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias(name))
    both = as_row(old, "old").join(as_row(new, "new"), F.col("__old_key") == F.col("__new_key"), "full_outer")
    # structs compare field by field, NULL lowest: the order of ``latest_per_key``
    rank = lambda name: F.struct(*[F.col(name).getField(c) for c, _ in order])
    take = F.col("old").isNull() | (F.col("new").isNotNull() & (rank("new") >= rank("old")))
    return both.select(F.when(take, F.col("new")).otherwise(F.col("old")).alias("row")).select("row.*")
