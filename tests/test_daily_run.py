"""The daily run end to end on landed JSON pages: idempotent per run, incremental per day."""
import json

from ledgerline.plans.daily import model_frames, register_views, run_daily


def account(_id, type_, current, rate="4.5"):
    return {"_id": _id, "name": f"acc {_id}", "type": type_, "status": "ACTIVE",
            "connection": {"name": "Bank"},
            "balance": {"currency": "NZD", "current": current, "available": None, "limit": None, "overdrawn": False},
            "refreshed": {"balance": "2024-07-01T00:00:00Z"},
            "meta": {"loan_details": {"interest": {"rate": rate}}}}


def land(tmp_path, name, pages):
    d = tmp_path / name
    d.mkdir()
    for i, page in enumerate(pages):
        (d / f"page{i}.json").write_text(json.dumps(page))
    return str(d)


def snapshot(spark, out):
    m = model_frames(spark, out)
    return {k: sorted(tuple(r) for r in v.collect()) for k, v in m.items()}


def test_daily_run(spark, tmp_path):
    out = str(tmp_path / "out")
    day1 = land(tmp_path, "day1", [{"items": [account("m1", "LOAN", -500000.0), account("c1", "CREDITCARD", -50.0)]},
                                   [account("s1", "SAVINGS", 900.0), {"_id": ""}]])
    checks = run_daily(spark, day1, out, "2024-07-01T01:00:00Z", "1719795600", 1)
    assert {r.failures for r in checks.filter("check_name = 'not_null'").collect()} == {0}
    first = snapshot(spark, out)
    # re-running the same day leaves the same tables
    run_daily(spark, day1, out, "2024-07-01T01:00:00Z", "1719795600", 1)
    assert snapshot(spark, out) == first
    # a later intraday load replaces the day's snapshot; the next day adds a partition
    day1b = land(tmp_path, "day1b", [[account("m1", "LOAN", -499000.0)]])
    run_daily(spark, day1b, out, "2024-07-01T05:00:00Z", "1719810000", 2)
    day2 = land(tmp_path, "day2", [[account("m1", "LOAN", -498000.0, rate="5.0")]])
    run_daily(spark, day2, out, "2024-07-02T01:00:00Z", "1719882000", 3)
    m = model_frames(spark, out)
    series = {str(r.snapshot_date): r for r in m["portfolio_daily"].collect()}
    assert sorted(series) == ["2024-07-01", "2024-07-02"]
    assert float(series["2024-07-01"].total_mortgage_balance) == -499000.0
    assert float(series["2024-07-01"].total_net_debt) == -499000.0 - 50.0 + 900.0
    dim = {r.account_id: r for r in m["dim_loans"].collect()}
    assert set(dim) == {"m1"} and float(dim["m1"].loan_interest_rate) == 5.0
    # the stored models are queryable by name with SQL
    assert register_views(spark, out) == ["daily_balances", "dim_loans", "portfolio_daily", "stg_accounts",
                                          "stg_balances"]
    latest = spark.sql("SELECT CAST(max(snapshot_date) AS STRING) AS d FROM portfolio_daily").first().d
    assert latest == "2024-07-02"
    hist = spark.sql("SELECT snapshot_date, current_balance FROM daily_balances WHERE account_id = :id "
                     "ORDER BY snapshot_date", args={"id": "m1"}).collect()
    assert [float(r.current_balance) for r in hist] == [-499000.0, -498000.0]


def test_daily_job_entry_point(spark, tmp_path):
    from ledgerline.plans.daily import main
    landed_dir = land(tmp_path, "fetch", [{"items": [account("m1", "LOAN", -1000.0)]}])
    out = str(tmp_path / "tables")
    args = ["--landed", landed_dir, "--out", out, "--as-of", "2024-07-01T01:00:00Z", "--load-id", "1", "--run-no", "1"]
    assert main(args) == 0
    assert main(args) == 0          # re-run of the same run number
    assert {r.account_id for r in model_frames(spark, out)["dim_loans"].collect()} == {"m1"}


def test_versions_are_picked_before_records_are_built(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerline.operators.merge import dedupe_batch
    from ledgerline.sources import fixtures
    from ledgerline.sources.tables import SCHEMAS
    d = str(tmp_path)
    spark.createDataFrame([(1, "one", 3, 10.0, "BUILDING"), (2, None, 4, -5.5, None), (2, None, 4, -5.5, None), (3, "three", None, None, "HOUSEHOLD")],
                          SCHEMAS["customer"]).write.parquet(f"{d}/customer.parquet")
    spark.sql("SELECT * FROM VALUES (9L, 1L, 'O', 1.5D, TIMESTAMP_NTZ'2024-01-01', '1-URGENT'), (10L, 1L, 'F', 2.5D, TIMESTAMP_NTZ'2024-01-02', NULL), "
              "(100L, 2L, NULL, NULL, NULL, '5-LOW'), (20L, 2L, 'O', 7.5D, TIMESTAMP_NTZ'2024-01-03', '3-MEDIUM'), (20L, 2L, 'O', 7.5D, TIMESTAMP_NTZ'2024-01-03', '3-MEDIUM'), "
              "(7L, 3L, 'F', 3.25D, TIMESTAMP_NTZ'2024-01-04', '2-HIGH'), (8L, NULL, 'F', 1D, NULL, NULL)"
              " AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{d}/orders.parquet")
    rec = fixtures.api_records(spark, d, faults=False)
    whole = F.struct(*[F.col(f"`{c}`") for c in rec.columns])
    wanted = {"first": rec.groupBy("_id").agg(F.min_by(whole, "_dlt_load_id").alias("r")).select("r.*"),
              "newest": dedupe_batch(rec, ["_id"], [("_dlt_load_id", "desc")])}
    for name, pick in (("first", fixtures.first_versions), ("newest", fixtures.newest_versions)):
        got = fixtures.api_records(spark, d, faults=False, versions=pick)
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(got) == rows(wanted[name]) and got.count() == 3
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Bank ") < plan.index("min_by" if name == "first" else "row_number")     # built above the pick
