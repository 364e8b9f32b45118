"""Read-side marts: account list, balance history, portfolio series, freshness, loan KPIs.

The KPI is one row: totals from the daily portfolio table by partial aggregates, and the
weighted rate from the loan dimension joined with each loan's latest balance. Marts read
stored facts (``daily.model_frames``) or, as here registered, facts derived on the fly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import SUM_NUMERIC, loan_pred
from ledgerline.operators.latest import latest_per_key
from ledgerline.plans.models import latest_accounts

RATE_TYPE = "decimal(38,9)"   # weighted rate, rounded so every engine agrees on the digits
SERIES_COLUMNS = ["snapshot_date", "total_mortgage_balance", "total_creditcard_balance",
                  "total_net_debt", "total_available", "total_limit"]
LATEST_LOAN_ORDER = [("snapshot_date", "desc"), ("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")]


def accounts_latest(stg_acc: DataFrame, strategy: str = "window") -> DataFrame:
    """All accounts (any type) at their latest version, by name with NULL names last."""
    cols = [c for c in stg_acc.columns if c != "_dlt_load_id"]
    # the id settles equal names, so no name (or its absence) has to sort in one task
    return latest_accounts(stg_acc, strategy).select(*cols).orderBy(F.col("account_name").asc_nulls_last(), "account_id")


def account_history(daily: DataFrame, account_id: str) -> DataFrame:
    """Daily balances of one account; the key predicate reaches both scans of the fact."""
    return (daily.filter(F.col("account_id") == F.lit(account_id))
                 .select("snapshot_date", "current_balance", "available_balance", "credit_limit", "currency")
                 .orderBy("snapshot_date"))


def portfolio_series(mot: DataFrame) -> DataFrame:
    return mot.select(*SERIES_COLUMNS).orderBy("snapshot_date")


def latest_snapshot(mot: DataFrame) -> DataFrame:
    """Freshness probe: newest snapshot date as text (NULL when the table is empty)."""
    return mot.agg(F.max("snapshot_date").cast("string").alias("latest_snapshot_date"))


def prev_month_end(mot: DataFrame) -> DataFrame:
    """Latest snapshot date and the last snapshot date before its month (NULLs when empty): the
    days are summed up by month (a partial aggregate), and the two newest months are read off."""
    months = mot.groupBy(F.trunc("snapshot_date", "MM").alias("month")).agg(F.max("snapshot_date").alias("last"))
    two = F.sort_array(F.collect_list("last"), asc=False)  # one date per month
    return months.agg(two.alias("d")).select(F.get("d", F.lit(0)).alias("latest_date"), F.get("d", F.lit(1)).alias("prev_date"))


def loan_balances(daily: DataFrame) -> DataFrame:
    """Balances of loan-typed rows with what their order goes by."""
    return daily.filter(loan_pred("account_type", "is_credit_card")).select(
        "account_id", "snapshot_date", "_dlt_load_id", "last_snapshot_at", "current_balance")


def latest_loan_balance(daily: DataFrame, strategy: str = "window") -> DataFrame:
    """Latest loan-typed row per account; the type filter runs *before* the pick."""
    return latest_per_key(loan_balances(daily), ["account_id"], LATEST_LOAN_ORDER, strategy).select("account_id", "current_balance")


def loan_balance_join(dim: DataFrame, latest_bal: DataFrame) -> DataFrame:
    """Inner equi-join on account_id. Both sides are one row per account; AQE broadcasts a
    side only when its measured size is under the threshold, else it stays a sort-merge join."""
    return dim.select("account_id", "loan_interest_rate").join(latest_bal, "account_id")


def weighted_rate(joined: DataFrame) -> DataFrame:
    """Σ(rate·|bal|) / Σ|bal|; NULL unless the denominator is > 0. A NULL rate drops out of
    the numerator but its balance stays in the denominator."""
    den = F.sum(F.abs("current_balance"))
    num = F.sum(F.col("loan_interest_rate") * F.abs("current_balance"))
    return joined.agg(
        den.cast(SUM_NUMERIC).alias("total_balance_pos"),
        F.when(den > 0, num.cast("double") / den.cast("double")).cast(RATE_TYPE).alias("weighted_rate"),
    )


def loan_kpis(mot: DataFrame, dim: DataFrame, daily: DataFrame, strategy: str = "window") -> DataFrame:
    """One row: |latest total|, change against the last snapshot before this month, weighted rate.

    ``mot`` (one row per day) is summed up to the last day of each month, of which the two
    newest are read off; the weighted rate is a scalar subquery over ``daily``. Over stored
    facts (``daily.model_frames``) each is read once.
    """
    return kpi_row(mot, loan_balance_join(dim, latest_loan_balance(daily, strategy)))


def kpi_row(mot: DataFrame, joined: DataFrame) -> DataFrame:
    """The KPIs from the daily totals and from loans joined with their newest balances, as derived
    here or stored side by side (``sources.cobucketed``)."""
    months = (mot.groupBy(F.trunc("snapshot_date", "MM").alias("month"))
                 .agg(F.max(F.struct("snapshot_date", "total_net_debt")).alias("last")))
    two = months.agg(F.sort_array(F.collect_list("last"), asc=False).alias("d"))
    weighted = weighted_rate(joined)
    debt = lambda i: F.abs(F.coalesce(F.get("d", F.lit(i)).getField("total_net_debt"), F.lit(0)))
    return two.select(
        debt(0).cast(SUM_NUMERIC).alias("total_net_debt"),
        (debt(0) - debt(1)).cast(SUM_NUMERIC).alias("monthly_change"),
        weighted.select("weighted_rate").scalar().alias("weighted_interest_rate"),
    )
