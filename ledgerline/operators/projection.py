"""Account-by-date spines: one row per account becomes one row per day in the task that
holds it (``explode`` of a sequence), never a join of all accounts with all days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_spine(df: DataFrame, key: str = "account_id", date_col: str = "snapshot_date") -> DataFrame:
    """One row per key per calendar day from its first to its last observed date.

    The per-key range is a partial aggregate (one shuffle of one row per key per
    task); the days are generated on the executor that holds the range.
    """
    ranges = df.groupBy(key).agg(F.min(date_col).alias("_d0"), F.max(date_col).alias("_d1"))
    days = ranges.select(key, F.explode(F.sequence("_d0", "_d1")).alias("snapshot_date"))
    return days.select(
        key, "snapshot_date",
        F.col("snapshot_date").cast("timestamp_ntz").alias("snapshot_at"),
        F.dayofmonth("snapshot_date").alias("day_of_month"),
    )
