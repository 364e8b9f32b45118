"""Sinks: JSON rows, versioned tables on plain files, date-partitioned upserts.

Plain parquet has no MERGE, so two write paths keep re-runs idempotent:

* ``write_version`` – a whole new table version in its own folder
  (``version=<n>``); the caller chooses ``n`` (the run number or the stream batch
  id), so a retried run rewrites the same folder instead of adding one;
* ``upsert_partitions`` – for large time-partitioned facts: only partitions that
  appear in the incoming rows are merged and rewritten (dynamic partition
  overwrite). Spark writes the new files beside the table and replaces the
  partitions when the whole job has succeeded, so the rows are written once and a
  failing job leaves the table as it was. Many small batches wait as they are
  (``add_pending``) and are merged together (``merge_pending``), so that a table is not
  rewritten for each.

Whether a table exists is asked of the file system. An error while reading one
that does exist always ends the write.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.merge import dedupe_batch, merge_by_key


def rows_to_json(df: DataFrame, col_name: str = "json") -> DataFrame:
    """Each row as one JSON object text; NULL fields are written as ``null``."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(col_name))


def fresh_read(spark: SparkSession, path: str) -> DataFrame:
    """Read a table this engine rewrites in place: drop the session's cached file
    listing for the path first, so files replaced by an earlier overwrite are not
    looked up again."""
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if the folder does not exist. One listing, no job."""
    fs, p = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def landed_bytes(spark: SparkSession, pattern: str) -> int:
    """Bytes of the files in the folders that ``pattern`` names. No job."""
    fs, p = _folder(spark, pattern)
    return sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p) or [])


def _version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={int(version):012d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were written to the end, oldest first."""
    named = [c for c in children(spark, root) if c.startswith("version=")]
    return sorted(int(c.removeprefix("version=")) for c in named
                  if "_SUCCESS" in children(spark, f"{root.rstrip('/')}/{c}"))


def write_version(df: DataFrame, root: str, version: int, keep: int | None = None) -> str:
    """Write one version. With ``keep``, versions older than the newest ``keep`` are deleted."""
    path = _version_path(root, version)
    df.write.mode("overwrite").parquet(path)
    if keep is not None:
        spark = df.sparkSession
        for old in versions(spark, root)[:-keep]:
            fs, p = _folder(spark, _version_path(root, old))
            fs.delete(p, True)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return fresh_read(spark, _version_path(root, version))


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a versioned table (below ``before`` if given), or None.

    Passing ``before`` = the version being written makes a retried write start
    from the same base as the first attempt.
    """
    found = [v for v in versions(spark, root) if before is None or v < before]
    return read_version(spark, root, found[-1]) if found else None


def touched_target(spark: SparkSession, path: str, incoming: DataFrame, partition_col: str) -> DataFrame:
    """The target rows in the partitions that ``incoming`` touches.

    One plan at every size: the incoming first and last value bound the listing
    (static partition pruning by two scalars), a semi-join keeps the touched
    partitions in between. The NULL partition is touched by a NULL value.
    """
    target, value = fresh_read(spark, path), F.col(partition_col)
    seen = incoming.agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count_if(value.isNull()).alias("nulls")).first()
    touched = incoming.select(partition_col).filter(value.isNotNull()).distinct()
    rows = target.filter(value.between(F.lit(seen["first"]), F.lit(seen["last"]))).join(touched, partition_col, "left_semi")
    return rows.unionByName(target.filter(value.isNull())) if seen["nulls"] else rows


def upsert_partitions(spark: SparkSession, incoming: DataFrame, path: str, keys: list[str],
                      order: list, partition_col: str, order_proof: bool = False, arrival: str | None = None) -> None:
    """Merge ``incoming`` into the table at ``path`` partitioned by ``partition_col``.

    Only the partitions touched by ``incoming`` are read and rewritten, each row
    once: the merged rows are rebalanced by partition, so a partition is a few
    files of even size however the rows were dealt, and a hot one is split.
    ``arrival``: a column of ``incoming`` that is not stored; of equal versions its greatest stays.
    """
    order = list(order) + ([(arrival, "desc")] if arrival else [])
    if any(c.startswith(f"{partition_col}=") for c in children(spark, path)):
        target = touched_target(spark, path, incoming, partition_col)
        merged = merge_by_key(target, incoming, keys, order, order_proof=order_proof)
    else:
        merged = dedupe_batch(incoming, keys, order)
    if arrival:
        merged = merged.drop(arrival)
    overwrite_partitions(merged, path, partition_col, [k for k in keys if k != partition_col])


#: Folder of the batches that wait to be merged, in that of their table. Readers of the table skip it.
PENDING = "_pending"
_STREAM, _BATCH = "__stream", "__batch"


def _pending(spark: SparkSession, path: str) -> list[str]:
    """Folders of the waiting batches that were written to the end."""
    root = f"{path.rstrip('/')}/{PENDING}"
    found = [f"{root}/{s}/{b}" for s in children(spark, root) for b in children(spark, f"{root}/{s}")]
    return sorted(f for f in found if "_SUCCESS" in children(spark, f))


def add_pending(batch: DataFrame, path: str, stream: str, batch_id: int) -> None:
    """Store a batch beside the table at ``path``, to be merged later. A batch that is tried again
    replaces what the first try left, so it costs its own rows however large the table is."""
    batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{PENDING}/{_STREAM}={stream}/{_BATCH}={int(batch_id)}")


def merge_pending(spark: SparkSession, path: str, keys: list[str], order: list, partition_col: str) -> None:
    """Merge all batches that wait into the table by version, a later batch's row on a tie. They are
    deleted afterwards; one that is merged once more changes nothing."""
    waiting = _pending(spark, path)
    if not waiting:
        return
    rows = spark.read.option("basePath", f"{path.rstrip('/')}/{PENDING}").parquet(*waiting).drop(_STREAM)
    upsert_partitions(spark, rows, path, keys, order, partition_col, order_proof=True, arrival=_BATCH)
    for folder in waiting:
        fs, p = _folder(spark, folder)
        fs.delete(p, True)


def overwrite_partitions(df: DataFrame, path: str, partition_col: str, cluster_by: Sequence[str] = ()) -> None:
    """Replace the partitions that ``df`` has rows of.

    ``cluster_by``: columns that a partition's files are sorted by, the first of which also gets
    Bloom filters. A reader that asks for one of its values skips the row groups whose range
    does not hold it, and those whose range does by chance.
    """
    rows = df.hint("rebalance", partition_col)
    writer_options = {"partitionOverwriteMode": "dynamic"}
    if cluster_by:
        rows = rows.sortWithinPartitions(partition_col, *[F.col(f"`{c}`") for c in cluster_by])
        # sized by the values that a row group holds
        writer_options |= {f"parquet.bloom.filter.enabled#{cluster_by[0]}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    rows.write.mode("overwrite").options(**writer_options).partitionBy(partition_col).parquet(path)
