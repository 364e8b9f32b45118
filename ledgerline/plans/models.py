"""The model graph: staging -> dimension / facts.

``dim_loans``        latest version per account, then the loan filter (a loan
                     re-typed in a later load disappears)
``daily_balances``   latest snapshot per account and day
``portfolio_daily``  per-day sums over the daily fact

Physical plan: the daily fact shuffles on (account_id, snapshot_date); the
portfolio sums shuffle on snapshot_date after a partial aggregate, so the second
exchange carries at most one row per day per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import SUM_NUMERIC, credit_flag, credit_pred, loan_pred, sum_if, zero_if_null
from ledgerline.operators.changes import SIGN
from ledgerline.operators.latest import latest_per_key
from ledgerline.operators.staging import lenient_amount

DIM_COLUMNS = [
    "account_id", "account_name", "account_type", "status", "loan_interest_rate", "loan_interest_type",
    "loan_interest_expires_at", "is_interest_only", "term_years", "term_months", "loan_matures_at",
    "loan_initial_principal", "repayment_frequency", "repayment_next_date", "repayment_next_amount",
]
DAILY_COLUMNS = [
    "account_id", "snapshot_date", "account_name", "account_type", "is_credit_card", "connection_name",
    "status", "currency", "current_balance", "available_balance", "credit_limit", "refreshed_balance_at",
    "last_snapshot_at", "_dlt_load_id",
]
AMOUNTS = ["current_balance", "available_balance", "credit_limit"]
ACCOUNT_VERSION_ORDER = [("_dlt_load_id", "desc")]
DAILY_ORDER = [("_dlt_load_id", "desc"), ("snapshot_at", "desc")]
DAILY_KEY, STORED_ORDER = ["account_id", "snapshot_date"], [("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")]


def latest_accounts(stg_acc: DataFrame, strategy: str = "window") -> DataFrame:
    """Latest version of every account (any type)."""
    return latest_per_key(stg_acc, ["account_id"], ACCOUNT_VERSION_ORDER, strategy)


def dim_loans(stg_acc: DataFrame, strategy: str = "window") -> DataFrame:
    """Loan dimension: latest version per account, kept only if that version is a loan."""
    latest = latest_accounts(stg_acc, strategy)
    return latest.filter(loan_pred("account_type", "is_credit_card")).select(*DIM_COLUMNS)


def daily_balances(stg_bal: DataFrame, strategy: str = "window") -> DataFrame:
    """Last load of the day per account: by load id, then latest snapshot time (NULLs last)."""
    cols = [c for c in DAILY_COLUMNS if c != "last_snapshot_at"] + ["snapshot_at"]
    latest = latest_per_key(stg_bal.select(*cols), ["account_id", "snapshot_date"], DAILY_ORDER, strategy)
    return latest.withColumnRenamed("snapshot_at", "last_snapshot_at").select(*DAILY_COLUMNS)


def _totals() -> list[Column]:
    loan = loan_pred("account_type", "is_credit_card")
    return [
        sum_if(loan, "current_balance").alias("total_mortgage_balance"),
        sum_if(credit_pred("is_credit_card"), "current_balance").alias("total_creditcard_balance"),
        F.sum(zero_if_null("current_balance")).cast(SUM_NUMERIC).alias("total_net_debt"),
        sum_if(loan, "available_balance").alias("total_available"),
        sum_if(loan, "credit_limit").alias("total_limit"),
    ]


def portfolio_daily(daily: DataFrame) -> DataFrame:
    """Per day: loan, credit-card and all-account totals (signed), loan available and limit."""
    return daily.groupBy("snapshot_date").agg(*_totals())


def portfolio_delta(changes: DataFrame) -> DataFrame:
    """What changes of the daily fact (``operators.changes``) add to each day's totals, and to its
    number of rows (``n_rows``): amounts of rows that leave count with the other sign."""
    signed = changes.withColumns({c: F.when(F.col(SIGN) < 0, -F.col(c)).otherwise(F.col(c)) for c in AMOUNTS})
    return signed.groupBy("snapshot_date").agg(*_totals(), F.sum(SIGN).alias("n_rows"))


def portfolio_add(totals: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals (with ``n_rows``) after a delta. Sums are exact decimals, so nothing drifts; a day that
    has no row left is gone."""
    sums = [F.sum(c).cast(totals.schema[c].dataType).alias(c) for c in totals.columns if c != "snapshot_date"]
    return totals.unionByName(delta).groupBy("snapshot_date").agg(*sums).filter("n_rows > 0")


def portfolio_daily_lenient(raw_bal: DataFrame) -> DataFrame:
    """Development form: on landed rows without dedupe, double amounts, available/limit over all.

    Doubles are added as exact decimals and turned back at the end, so the totals do not
    depend on the order in which tasks finish.
    """
    t = F.coalesce(F.col("account_type"), F.lit(""))
    is_loan = F.upper(t) == F.lit("LOAN")

    def total(amount, pred=None):
        exact = F.coalesce(lenient_amount(amount), F.lit(0.0)).cast("decimal(28,8)")
        return F.sum(exact if pred is None else F.when(pred, exact).otherwise(F.lit(0))).cast("double")

    return raw_bal.groupBy("snapshot_date").agg(
        total("current", is_loan).alias("total_mortgage_balance"),
        total("current", credit_flag("account_type")).alias("total_creditcard_balance"),
        total("current").alias("total_net_debt"),
        total("available").alias("total_available"),
        total("limit").alias("total_limit"),
    )


def dim_loans_lenient(stg_lenient: DataFrame) -> DataFrame:
    """Development form: every version of a LOAN-typed account, its rate cast to double (text
    that is no number raises, an empty one too)."""
    return stg_lenient.filter(F.upper(F.coalesce(F.col("account_type"), F.lit(""))) == "LOAN").select(
        "account_id", F.col("loan_interest_rate").cast("double").alias("loan_interest_rate"))
