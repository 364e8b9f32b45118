"""T1 incremental merge: out-of-order files and replays converge to the batch table."""
import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.plans import models, registry
from ledgerline.sources.sinks import fresh_read
from ledgerline.streaming.merge_stream import incremental_merge

ORDER = [("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")]
KEYS = ["account_id", "snapshot_date"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def staged(spark):
    return registry.stg_b(spark, SF_SMALL).withColumnRenamed("snapshot_at", "last_snapshot_at") \
        .select(*models.DAILY_COLUMNS)


def test_out_of_order_files_and_replay(spark, tmp_path):
    stg = staged(spark)
    src = str(tmp_path / "landed")
    # land the newest loads first: file modification order is the reverse of load order
    halves = [stg.filter(F.col("snapshot_date") >= "2024-01-16"), stg.filter(F.col("snapshot_date") < "2024-01-16"),
              stg.filter(F.col("_dlt_load_id") >= "20240110")]       # a third file re-sends loads already seen
    for i, part in enumerate(halves):
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
        time.sleep(1.1)
    target = str(tmp_path / "daily")
    expected = rows(registry.daily_b(spark, SF_SMALL))
    common = dict(schema=stg.schema, target_path=target, keys=KEYS, order=ORDER, partition_col="snapshot_date",
                  max_files_per_trigger=1)
    incremental_merge(spark, src + "/*", checkpoint_path=str(tmp_path / "ck1"), **common)
    first = rows(fresh_read(spark, target).select(*models.DAILY_COLUMNS))
    assert first == expected
    # replaying every file into the same table (a fresh checkpoint) changes nothing
    incremental_merge(spark, src + "/*", checkpoint_path=str(tmp_path / "ck2"), **common)
    assert rows(fresh_read(spark, target).select(*models.DAILY_COLUMNS)) == expected


def test_stateful_stream_with_bounded_state(spark, tmp_path):
    from ledgerline.streaming.merge_stream import latest_state_stream
    stg = staged(spark)
    src = str(tmp_path / "landed")
    stg.repartition(4, "snapshot_date").write.parquet(src)
    target = str(tmp_path / "daily")
    # a delay longer than the data's span drops nothing: the result is the batch table
    latest_state_stream(spark, src, stg.schema, target, KEYS, ORDER, "snapshot_date", str(tmp_path / "ck"),
                        max_files_per_trigger=2, state_delay="400 days")
    got = rows(fresh_read(spark, target).select(*models.DAILY_COLUMNS))
    assert got == rows(registry.daily_b(spark, SF_SMALL))


def test_upsert_reads_only_touched_partitions(spark, tmp_path):
    from ledgerline.sources.sinks import touched_target, upsert_partitions
    stg = staged(spark)
    path = str(tmp_path / "daily")
    upsert_partitions(spark, stg, path, KEYS, ORDER, "snapshot_date")
    day = stg.filter(F.col("snapshot_date") == "2024-01-05")
    target = touched_target(spark, path, day, "snapshot_date")
    plan = target._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "2024-01-05" in plan
    assert {str(r.snapshot_date) for r in target.select("snapshot_date").distinct().collect()} == {"2024-01-05"}
    upsert_partitions(spark, day, path, KEYS, ORDER, "snapshot_date")   # re-merge of one day
    assert rows(fresh_read(spark, path).select(*models.DAILY_COLUMNS)) == rows(registry.daily_b(spark, SF_SMALL))


def test_resent_rows_do_not_reach_the_merge(spark, tmp_path, monkeypatch):
    from ledgerline.streaming import merge_stream
    stg = staged(spark)
    src, seen, plans = str(tmp_path / "landed"), [], []
    again = stg.filter(F.col("snapshot_date") >= "2024-01-16")
    for i, part in enumerate([stg, again, again.limit(7)]):
        part.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
        time.sleep(1.1)
    upsert = merge_stream._upsert_batch

    def watched(batch, *args):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        seen.append(batch.count())
        upsert(batch, *args)

    monkeypatch.setattr(merge_stream, "_upsert_batch", watched)
    target = str(tmp_path / "daily")
    incremental_merge(spark, src + "/*", stg.schema, target, KEYS, ORDER, "snapshot_date", str(tmp_path / "ck"),
                      max_files_per_trigger=1, resent_within="400 days")
    assert sum(seen) == stg.distinct().count()
    # the merge reads what was written of the batch, not its source
    assert all("ExistingRDD" in p and "parquet" not in p.lower() for p in plans)
    assert rows(fresh_read(spark, target).select(*models.DAILY_COLUMNS)) == rows(registry.daily_b(spark, SF_SMALL))


def balance_files(spark, src, n):
    """``n`` files, each with a newer balance of account ``a`` and a balance of an account of its own."""
    schema = "account_id string, snapshot_date date, current long, _dlt_load_id string"
    for i in range(n):
        spark.sql("SELECT 'a' AS account_id, DATE '2024-01-01' AS snapshot_date, CAST({i} AS BIGINT) AS current, '{l}' AS _dlt_load_id "
                  "UNION ALL SELECT 'k{i}', DATE '2024-01-0{d}', CAST({i} AS BIGINT), '{l}'".format(i=i, l=f"{i:03d}", d=1 + i % 3)) \
            .coalesce(1).write.parquet(os.path.join(src, f"part{i:03d}"))
    return spark.createDataFrame([], schema).schema


def expected_balances(n):
    return sorted([("a", "2024-01-01", n - 1)] + [(f"k{i}", f"2024-01-0{1 + i % 3}", i) for i in range(n)])


def stored_balances(spark, target):
    return sorted((r.account_id, str(r.snapshot_date), r.current) for r in fresh_read(spark, target).collect())


def test_a_table_is_not_rewritten_for_each_batch(spark, tmp_path, monkeypatch):
    from ledgerline.sources import sinks
    from ledgerline.streaming.merge_stream import latest_state_stream
    src, n, rewrites = str(tmp_path / "landed"), 18, []
    schema = balance_files(spark, src, n)
    overwrite = sinks.overwrite_partitions
    monkeypatch.setattr(sinks, "overwrite_partitions", lambda *a, **k: (rewrites.append(a[1]), overwrite(*a, **k)))
    for run in (incremental_merge, latest_state_stream):
        target = str(tmp_path / run.__name__)
        run(spark, src + "/*", schema, target, KEYS, [("_dlt_load_id", "desc")], "snapshot_date", target + "-ck", max_files_per_trigger=1)
        assert rewrites.count(target) == 2            # after 16 batches and at the end
        assert stored_balances(spark, target) == expected_balances(n)
        assert not [b for s in os.listdir(target + "/_pending") for b in os.listdir(f"{target}/_pending/{s}") if not b.startswith(".")]


def test_a_later_batch_wins_on_a_tie(spark, tmp_path):
    src, target = str(tmp_path / "landed"), str(tmp_path / "daily")
    schema = balance_files(spark, src, 1)
    for i in (7, 5):
        time.sleep(1.1)
        spark.read.schema(schema).parquet(src + "/*").filter("account_id = 'k0'").withColumn("current", F.lit(i).cast("long")) \
            .coalesce(1).write.parquet(os.path.join(src, f"again{i}"))
    incremental_merge(spark, src + "/*", schema, target, KEYS, [("_dlt_load_id", "desc")], "snapshot_date", str(tmp_path / "ck"),
                      max_files_per_trigger=1)
    assert stored_balances(spark, target) == [("a", "2024-01-01", 0), ("k0", "2024-01-01", 5)]


def test_stored_batches_reach_the_table_when_a_drain_fails(spark, tmp_path, monkeypatch):
    import pytest

    from ledgerline.streaming import merge_stream
    src, target = str(tmp_path / "landed"), str(tmp_path / "daily")
    schema = balance_files(spark, src, 3)
    upsert, go = merge_stream._upsert_batch, lambda: incremental_merge(
        spark, src + "/*", schema, target, KEYS, [("_dlt_load_id", "desc")], "snapshot_date", str(tmp_path / "ck"), max_files_per_trigger=1)

    def failing(batch, *args):
        if args[-1] == 2:
            raise RuntimeError("batch 2")
        upsert(batch, *args)

    monkeypatch.setattr(merge_stream, "_upsert_batch", failing)
    with pytest.raises(Exception, match="batch 2"):
        go()
    assert len(stored_balances(spark, target)) == 3
    monkeypatch.setattr(merge_stream, "_upsert_batch", upsert)
    go()
    assert stored_balances(spark, target) == expected_balances(3)


def test_state_lies_in_rocksdb_in_partitions_by_landed_bytes(spark, tmp_path):
    from ledgerline.streaming.merge_stream import latest_state_stream
    src, target, ck = str(tmp_path / "landed"), str(tmp_path / "daily"), tmp_path / "ck"
    schema = balance_files(spark, src, 2)
    shuffles = "spark.sql.shuffle.partitions"
    before = spark.conf.get(shuffles)
    spark.conf.set(shuffles, "50")
    try:
        latest_state_stream(spark, src + "/*", schema, target, KEYS, [("_dlt_load_id", "desc")], "snapshot_date", str(ck))
        assert spark.conf.get(shuffles) == "50"
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None
    finally:
        spark.conf.set(shuffles, before)
    settings = (ck / "offsets" / "0").read_text()
    assert "RocksDBStateStoreProvider" in settings
    assert f'"{shuffles}":"{spark.sparkContext.defaultParallelism}"' in settings
    assert stored_balances(spark, target) == expected_balances(2)
