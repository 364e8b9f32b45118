"""Hand-made edge rows for the semantic rules and traps of the models."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.functions import exprs
from ledgerline.operators import staging
from ledgerline.operators.latest import latest_per_key
from ledgerline.plans import marts, models
from ledgerline.schemas import RAW_ACCOUNTS

STRATEGIES = ["agg", "window"]

BAL_COLS = ["account_id", "snapshot_at", "snapshot_date", "account_name", "account_type", "connection_name",
            "status", "currency", "current", "available", "limit", "overdrawn", "refreshed_balance_at",
            "raw_balance", "_dlt_load_id"]
BAL_SCHEMA = ("account_id string, snapshot_at string, snapshot_date date, account_name string, account_type string, "
              "connection_name string, status string, currency string, current string, available string, "
              "`limit` string, overdrawn boolean, refreshed_balance_at string, raw_balance string, _dlt_load_id string")


def bal(account_id, day, load, at=None, current="1", type_="LOAN", name="n"):
    return (account_id, at, dt.date(2024, 1, day), name, type_, "Bank", "ACTIVE", "NZD", current, None, None,
            False, None, None, load)


def accounts(spark, rows):
    """rows: dicts with a subset of the landed accounts columns."""
    full = [{f.name: r.get(f.name) for f in RAW_ACCOUNTS.fields} for r in rows]
    return spark.createDataFrame([Row(**r) for r in full], RAW_ACCOUNTS)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_latest_load_wins_and_nulls_last(spark, strategy):
    # Later load wins; with equal load ids the non-NULL snapshot_at wins (DESC NULLS LAST)
    rows = [bal("a", 1, "2", "2024-01-01 10:00:00Z", "10"), bal("a", 1, "3", None, "20"),
            bal("a", 1, "3", "2024-01-01 09:00:00Z", "30"),
            bal("b", 1, "5", None, "40"), bal("b", 1, "5", "2024-01-01 08:00:00Z", "50")]
    raw = spark.createDataFrame(rows, BAL_SCHEMA)
    out = models.daily_balances(staging.stg_balances(raw), strategy)
    got = {r.account_id: r.current_balance for r in out.collect()}
    assert got == {"a": Decimal("30.000"), "b": Decimal("50.000")}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_load_id_is_text_ordered(spark, strategy):
    # E2: '9' > '10' as text
    raw = spark.createDataFrame([bal("a", 1, "9", None, "9"), bal("a", 1, "10", None, "10")], BAL_SCHEMA)
    out = models.daily_balances(staging.stg_balances(raw), strategy).collect()
    assert [r.current_balance for r in out] == [Decimal("9.000")]


def test_type_normalisation_and_flags(spark):
    # E3 + traps 6, 7
    types = ["LOAN", "Loan", " loan ", "CreditCard", "LOAN CARD", "", None]
    raw = accounts(spark, [{"_id": str(i), "type": t, "_dlt_load_id": "1"} for i, t in enumerate(types)])
    stg = {r.account_id: r for r in staging.stg_accounts(raw).collect()}
    assert [stg[str(i)].account_type for i in range(7)] == ["LOAN", "LOAN", "LOAN", "CREDITCARD", "LOAN CARD", "", ""]
    assert [stg[str(i)].is_credit_card for i in range(7)] == [False, False, False, True, True, False, False]
    dim_ids = sorted(r.account_id for r in models.dim_loans(staging.stg_accounts(raw)).collect())
    assert dim_ids == ["0", "1", "2"]          # ' loan ' is trimmed upstream -> a loan in the dim
    # in the facts the type is not trimmed: ' loan ' is not a loan
    rows = [bal(str(i), 1, "1", None, "100", type_=t) for i, t in enumerate(types)]
    daily = models.daily_balances(staging.stg_balances(spark.createDataFrame(rows, BAL_SCHEMA)))
    mot = models.portfolio_daily(daily).collect()[0]
    assert mot.total_mortgage_balance == Decimal("200.000")   # LOAN, Loan
    assert mot.total_creditcard_balance == Decimal("200.000")  # CreditCard, LOAN CARD
    assert mot.total_net_debt == Decimal("700.000")


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_retyped_account_dim_vs_latest_balance(spark, strategy):
    # E4 / trap 5: the dim filters after the pick, the KPI balance before it
    raw = accounts(spark, [{"_id": "x", "type": "LOAN", "_dlt_load_id": "1"},
                           {"_id": "x", "type": "SAVINGS", "_dlt_load_id": "2"}])
    assert models.dim_loans(staging.stg_accounts(raw), strategy).count() == 0
    rows = [bal("x", 1, "1", None, "100", type_="LOAN"), bal("x", 2, "2", None, "5", type_="SAVINGS")]
    daily = models.daily_balances(staging.stg_balances(spark.createDataFrame(rows, BAL_SCHEMA)), strategy)
    got = marts.latest_loan_balance(daily, strategy).collect()
    assert [(r.account_id, r.current_balance) for r in got] == [("x", Decimal("100.000"))]


def test_amount_casts_strict_and_lenient(spark):
    # E5
    df = spark.createDataFrame([("",), (None,), (" 12 ",), ("1e3",)], "v string")
    got = [r.x for r in df.select(exprs.to_numeric("v").alias("x")).collect()]
    assert got == [None, None, Decimal("12.000"), Decimal("1000.000")]
    bad = spark.createDataFrame([("abc",)], "v string")
    with pytest.raises(PySparkException):
        bad.select(exprs.to_numeric("v")).collect()
    assert bad.select(exprs.to_numeric("v", strict=False).alias("x")).collect()[0].x is None


def test_text_to_int_rounds_once(spark):
    # Round half away from zero, on the exact decimal value
    df = spark.createDataFrame([("30",), ("30.7",), ("30.4996",), ("-30.5",), ("25.5",), ("",)], "v string")
    assert [r.x for r in df.select(exprs.text_to_int("v").alias("x")).collect()] == [30, 31, 30, -31, 26, None]


def test_variant_coalesce(spark):
    # Text first, the double variant only when the text is blank/NULL
    df = spark.createDataFrame([(None, 3000.0), ("", 12.5), ("10.25", 99.0), (None, None)], "t string, v double")
    got = [r.x for r in df.select(staging.variant_coalesce(F.col("t"), F.col("v")).alias("x")).collect()]
    assert got == [Decimal("3000.000"), Decimal("12.500"), Decimal("10.250"), None]


def test_weighted_rate_null_rate_and_zero_balances(spark):
    # E8 / trap 4: a NULL rate drops from the numerator only; zero exposure -> NULL
    j = spark.createDataFrame([("a", Decimal("5.000"), Decimal("100.000")), ("b", None, Decimal("-100.000"))],
                              "account_id string, loan_interest_rate decimal(18,3), current_balance decimal(18,3)")
    r = marts.weighted_rate(j).collect()[0]
    assert r.total_balance_pos == Decimal("200.000") and r.weighted_rate == Decimal("2.500000000")
    z = spark.createDataFrame([("a", Decimal("5.000"), Decimal("0.000"))],
                              "account_id string, loan_interest_rate decimal(18,3), current_balance decimal(18,3)")
    assert marts.weighted_rate(z).collect()[0].weighted_rate is None


def _kpis(spark, rows, acc_rows):
    daily = models.daily_balances(staging.stg_balances(spark.createDataFrame(rows, BAL_SCHEMA)))
    dim = models.dim_loans(staging.stg_accounts(accounts(spark, acc_rows)))
    return marts.loan_kpis(models.portfolio_daily(daily), dim, daily).collect()[0]


def test_kpis_single_month_negative_and_empty(spark):
    # E9 / trap 3: no previous month -> change = whole debt; abs drops the sign; empty -> zeros
    acc = [{"_id": "a", "type": "LOAN", "meta__loan_details__interest__rate": "4.5", "_dlt_load_id": "1"}]
    k = _kpis(spark, [bal("a", 3, "1", None, "-250.5"), bal("a", 5, "2", None, "-200")], acc)
    assert k.total_net_debt == Decimal("200.000") and k.monthly_change == Decimal("200.000")
    assert k.weighted_interest_rate == Decimal("4.500000000")
    empty = _kpis(spark, [], acc)
    assert empty.total_net_debt == Decimal("0.000") and empty.monthly_change == Decimal("0.000")
    assert empty.weighted_interest_rate is None


def test_kpis_previous_month(spark):
    acc = [{"_id": "a", "type": "LOAN", "_dlt_load_id": "1"}]
    rows = [bal("a", 1, "1", None, "300")]
    rows = [r[:2] + (dt.date(2023, 12, 30),) + r[3:] for r in rows] + [bal("a", 20, "2", None, "250")]
    k = _kpis(spark, rows, acc)
    assert k.total_net_debt == Decimal("250.000") and k.monthly_change == Decimal("-50.000")


def test_local_date_auckland(spark):
    # DST-aware local calendar date of a UTC instant
    df = spark.createDataFrame([("2024-07-01 11:59:59",), ("2024-07-01 12:00:00",), ("2024-01-01 11:00:00",)],
                               "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r.d for r in df.select(exprs.local_date("t").alias("d")).collect()]
    assert got == [dt.date(2024, 7, 1), dt.date(2024, 7, 2), dt.date(2024, 1, 2)]


def test_accounts_latest_orders_null_names_last(spark):
    # E16 / D1
    raw = accounts(spark, [{"_id": "1", "name": None, "_dlt_load_id": "1"},
                           {"_id": "2", "name": "b", "_dlt_load_id": "1"},
                           {"_id": "3", "name": "a", "_dlt_load_id": "1"}])
    got = [r.account_id for r in marts.accounts_latest(staging.stg_accounts(raw)).collect()]
    assert got == ["3", "2", "1"]


def test_lenient_balances_keep_overdrawn_and_try_cast(spark):
    rows = [bal("a", 1, "1", None, "abc"), bal("a", 1, "2", None, "5")]
    rows = [r[:11] + (None,) + r[12:] for r in rows]
    out = staging.daily_balances_lenient(spark.createDataFrame(rows, BAL_SCHEMA)).collect()
    assert sorted(r.current_balance or 0 for r in out) == [0, 5.0]
    assert all(r.overdrawn is False for r in out)


def test_latest_per_key_rejects_ascending(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError):
        latest_per_key(df, ["k"], [("v", "asc")])


def test_available_and_limit_loans_only_vs_all_accounts(spark):
    # trap 2: the model sums available/limit over loans only, the development form over all accounts
    rows = [bal("l", 1, "1", None, "10", type_="LOAN"), bal("s", 1, "1", None, "20", type_="SAVINGS")]
    rows = [r[:9] + ("100",) + ("7",) + r[11:] for r in rows]
    raw = spark.createDataFrame(rows, BAL_SCHEMA)
    strict = models.portfolio_daily(models.daily_balances(staging.stg_balances(raw))).collect()[0]
    lenient = models.portfolio_daily_lenient(raw).collect()[0]
    assert (strict.total_available, strict.total_limit) == (Decimal("100.000"), Decimal("7.000"))
    assert (lenient.total_available, lenient.total_limit) == (Decimal("200.00"), Decimal("14.00"))
    assert strict.total_net_debt == Decimal("30.000") and lenient.total_net_debt == Decimal("30.00")
