"""Physical-plan properties of every registered query, and skew behaviour of top-1 per key."""
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerline.operators.latest import latest_per_key
from ledgerline.plans.registry import queries

# queries that run jobs (streams, writes) while being built; their plans read stored files
WRITES = {"stream_merge_balances", "stream_latest_balances", "daily_run", "portfolio_maintained", "loan_kpis_bucketed"}
QUERIES = queries()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    df = QUERIES["account_history"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "props" not in plan                       # unused column never read
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(ts)]" in plan


@pytest.mark.parametrize("strategy", ["window", "agg"])
def test_top1_with_a_third_of_rows_on_one_key(spark, strategy):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 1000).cast("string")).alias("k"),
        F.lpad(F.col("id").cast("string"), 8, "0").alias("load"),
        F.col("id").alias("v"))
    out = latest_per_key(df.repartition(8), ["k"], [("load", "desc")], strategy)
    got = {r.k: r.v for r in out.collect()}
    assert got["hot"] == max(i for i in range(n) if i % 3 == 0)
    assert len(got) == 1 + 1000
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the reduction happens before the shuffle as well as after it
    assert ("WindowGroupLimit" in plan and "Partial" in plan) if strategy == "window" else "partial_max_by" in plan


def test_one_shuffle_for_a_merge(spark):
    plan = QUERIES["merge_balances"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    on_keys = [x for x in plan.split("Exchange hashpartitioning(")[1:] if x.startswith("account_id") and "snapshot_date" in x[:60]]
    assert len(on_keys) == 1


def test_no_window_over_all_rows(spark):
    from ledgerline.plans import marts
    mot = spark.createDataFrame([("2024-01-31", 1), ("2024-02-01", 2)], "snapshot_date string, total_net_debt int") \
        .withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    out = marts.prev_month_end(mot)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert [str(x) for x in out.first()] == ["2024-02-01", "2024-01-31"]
    assert list(marts.prev_month_end(mot.limit(0)).first()) == [None, None]


def test_tables_are_read_anew(spark, tmp_path):
    src = f"{SF_SMALL}/events.parquet"
    spark.read.parquet(src).write.parquet(f"{tmp_path}/events.parquet")
    n = QUERIES["money_round"](spark, str(tmp_path)).count()
    spark.read.parquet(src).limit(n // 2).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["money_round"](spark, str(tmp_path)).count() == n // 2


PYTHON_OPS = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES))
def test_no_python_in_plans(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(op in plan for op in PYTHON_OPS)


def test_co_bucketed_tables_join_without_a_shuffle(spark):
    from ledgerline.plans import marts, registry
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as for large tables
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        dim, newest = registry.co_bucketed_loans(spark, SF_SMALL)
        joined = marts.loan_balance_join(dim, newest.select("account_id", "current_balance"))
        assert joined.count() > 0
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
