"""Snapshot ingest: nested account records -> balance rows and ingest metrics.

Both are row-parallel projections / partial aggregates over the record
DataFrame; a record never leaves its executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import LOCAL_ZONE, blank_to_null, iso_instant, local_date
from ledgerline.sources.landed import RAW, keyed_records

BALANCE_FIELDS = ("currency", "current", "available", "limit", "overdrawn")


def balance_snapshot(records: DataFrame, as_of: str, zone: str = LOCAL_ZONE, extra: Sequence[str] = ()) -> DataFrame:
    """One balance row per keyed record for a run at instant ``as_of`` (text with offset).

    ``snapshot_at`` is the run instant, ``snapshot_date`` its calendar date in
    ``zone``; a missing ``balance`` / ``connection`` / ``refreshed`` struct gives
    NULL fields. Of records that carry what was sent (``landed.RAW``), the balance is
    kept as it was sent, whatever fields it has (``{}`` when missing).
    ``extra``: columns to carry along.
    """
    rec = keyed_records(records)
    at = F.lit(as_of).cast("timestamp")
    bal = F.col("balance")
    sent = F.col(RAW).getField("balance") if RAW in records.columns else F.to_json(bal, {"ignoreNullFields": "false"})
    return rec.select(
        F.col("_id").alias("account_id"),
        at.alias("snapshot_at"),
        local_date(at, zone, naive_is_utc=False).alias("snapshot_date"),
        F.col("name").alias("account_name"),
        F.col("type").alias("account_type"),
        F.col("connection").getField("name").alias("connection_name"),
        F.col("status"),
        *[bal.getField(n).alias(n) for n in BALANCE_FIELDS],
        F.col("refreshed").getField("balance").alias("refreshed_balance_at"),
        F.coalesce(sent, F.lit("{}")).alias("raw_balance"),
        *extra,
    )


def ingest_metrics(records: DataFrame) -> DataFrame:
    """Record count and the latest ``refreshed.balance``.

    Latest = the ISO time of the greatest instant, with the offset it was sent with,
    else the greatest non-empty raw text, else NULL. One partial aggregate per task.
    """
    raw = records.select(blank_to_null(F.col("refreshed").getField("balance")).alias("raw"))
    agg = raw.select("raw", iso_instant("raw").alias("parsed")).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.max("parsed").alias("_parsed"),
        F.bool_or(~F.col("parsed.naive")).alias("_offsets"),
        F.max("raw").alias("_raw"),
    )
    # a time without offset among times with one is told as the UTC time it was compared as
    utc = F.when(F.col("_parsed.naive") & F.col("_offsets"), F.lit("+00:00")).otherwise(F.lit(""))
    return agg.select("record_count", F.coalesce(F.concat("_parsed.text", utc), F.col("_raw")).alias("latest_refreshed"))
