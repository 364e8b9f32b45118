"""Typed staging of the loosely typed landed tables.

Strict variants pin every non-text column with ANSI casts (bad text raises, an
empty string is NULL); lenient variants mirror the development views: no
normalisation, ``try_cast`` instead of ``cast``, no key filter. All are pure
projections + filters, so the parquet scan receives the pruned column set and
the pushed-down key predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import (
    NUMERIC, blank_to_null, credit_flag, normalise_type, text_to_int, to_bool, to_instant, to_numeric,
)

LOAN = "meta__loan_details__"


#: Columns that only later loads have: the number-typed variant of a field first sent as text.
EVOLVED = (LOAN + "repayment__next_amount__v_double",)


def _get(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """A column of the landed table. One that is known to evolve is NULL in loads that lack it;
    any other must be there."""
    if name in df.columns:
        return F.col(f"`{name}`")
    if name in EVOLVED:
        return F.lit(None).cast(dtype)
    raise ValueError(f"landed table lacks column {name}")


def variant_coalesce(text_col: Column, variant_col: Column, strict: bool = True) -> Column:
    """A field landed under two types: the text form if non-blank, else the typed variant."""
    first = to_numeric(text_col, strict)
    second = variant_col.cast(NUMERIC) if strict else variant_col.try_cast(NUMERIC)
    return F.coalesce(first, second)


def stg_accounts(raw: DataFrame) -> DataFrame:
    """17 columns; type upper/trimmed, credit flag, 9 typed loan fields; rows with a key only."""
    g = lambda n, t="string": _get(raw, n, t)
    return raw.filter(F.col("_id").isNotNull()).select(
        F.col("_id").alias("account_id"),
        g("name").alias("account_name"),
        normalise_type(g("type")).alias("account_type"),
        credit_flag(g("type")).alias("is_credit_card"),
        g("status").alias("status"),
        to_numeric(g(LOAN + "interest__rate")).alias("loan_interest_rate"),
        g(LOAN + "interest__type").alias("loan_interest_type"),
        to_instant(g(LOAN + "interest__expires_at")).alias("loan_interest_expires_at"),
        to_bool(g(LOAN + "is_interest_only")).alias("is_interest_only"),
        text_to_int(g(LOAN + "term__years")).alias("term_years"),
        text_to_int(g(LOAN + "term__months")).alias("term_months"),
        to_instant(g(LOAN + "matures_at")).alias("loan_matures_at"),
        to_numeric(g(LOAN + "initial_principal")).alias("loan_initial_principal"),
        g(LOAN + "repayment__frequency").alias("repayment_frequency"),
        to_instant(g(LOAN + "repayment__next_date")).alias("repayment_next_date"),
        variant_coalesce(g(LOAN + "repayment__next_amount"),
                         g(LOAN + "repayment__next_amount__v_double", "double")).alias("repayment_next_amount"),
        g("_dlt_load_id").alias("_dlt_load_id"),
    )


def stg_accounts_lenient(raw: DataFrame) -> DataFrame:
    """Development form: renames only, type as landed, no casts, no key filter."""
    g = lambda n, t="string": _get(raw, n, t)
    return raw.select(
        g("_id").alias("account_id"),
        g("name").alias("account_name"),
        g("type").alias("account_type"),
        credit_flag(g("type")).alias("is_credit_card"),
        g("status").alias("status"),
        g(LOAN + "interest__rate").alias("loan_interest_rate"),
        g(LOAN + "interest__type").alias("loan_interest_type"),
        g(LOAN + "interest__expires_at").alias("loan_interest_expires_at"),
        g(LOAN + "is_interest_only").alias("is_interest_only"),
        g(LOAN + "term__years").alias("term_years"),
        g(LOAN + "term__months").alias("term_months"),
        g(LOAN + "matures_at").alias("loan_matures_at"),
        g(LOAN + "initial_principal").alias("loan_initial_principal"),
        g(LOAN + "repayment__frequency").alias("repayment_frequency"),
        g(LOAN + "repayment__next_date").alias("repayment_next_date"),
        g(LOAN + "repayment__next_amount").alias("repayment_next_amount"),
        g("_dlt_load_id").alias("_dlt_load_id"),
    )


def stg_balances(raw: DataFrame) -> DataFrame:
    """15 columns. ``account_type`` is kept as landed (not trimmed or upper-cased)."""
    g = lambda n, t="string": _get(raw, n, t)
    return raw.filter(F.col("account_id").isNotNull() & F.col("snapshot_date").isNotNull()).select(
        F.col("account_id"),
        F.col("snapshot_date").cast("date").alias("snapshot_date"),
        g("snapshot_at").cast("timestamp").alias("snapshot_at"),
        g("account_name").alias("account_name"),
        g("account_type").alias("account_type"),
        credit_flag(g("account_type")).alias("is_credit_card"),
        g("connection_name").alias("connection_name"),
        g("status").alias("status"),
        g("currency").alias("currency"),
        to_numeric(g("current")).alias("current_balance"),
        to_numeric(g("available")).alias("available_balance"),
        to_numeric(g("limit")).alias("credit_limit"),
        g("overdrawn", "boolean").cast("boolean").alias("overdrawn"),
        g("refreshed_balance_at").cast("timestamp").alias("refreshed_balance_at"),
        g("_dlt_load_id").alias("_dlt_load_id"),
    )


def daily_balances_lenient(raw: DataFrame) -> DataFrame:
    """Development form of the daily fact: straight projection, ``try_cast``, no dedupe."""
    g = lambda n, t="string": _get(raw, n, t)
    return raw.select(
        g("account_id").alias("account_id"),
        g("snapshot_date").cast("date").alias("snapshot_date"),
        g("current").try_cast("double").alias("current_balance"),
        g("available").try_cast("double").alias("available_balance"),
        g("limit").try_cast("double").alias("credit_limit"),
        g("currency").alias("currency"),
        credit_flag(g("account_type")).alias("is_credit_card"),
        g("account_type").alias("account_type"),
        F.coalesce(g("overdrawn", "boolean"), F.lit(False)).alias("overdrawn"),
        g("_dlt_load_id").alias("_dlt_load_id"),
        g("snapshot_at").try_cast("timestamp_ntz").alias("last_snapshot_at"),
    )


def lenient_amount(c) -> Column:
    return blank_to_null(c).try_cast("double")
