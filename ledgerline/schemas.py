"""Declared schemas: the nested API account record and the two landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, StringType, StructField, StructType, TimestampType,
)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


S, D = StringType(), DoubleType()

BALANCE = _s(("currency", S), ("current", D), ("available", D), ("limit", D), ("overdrawn", BooleanType()))

LOAN_DETAILS = _s(
    ("interest", _s(("rate", S), ("type", S), ("expires_at", S))),
    ("is_interest_only", S),
    ("term", _s(("years", S), ("months", S))),
    ("matures_at", S),
    ("initial_principal", S),
    ("repayment", _s(("frequency", S), ("next_date", S), ("next_amount", S), ("next_amount__v_double", D))),
)

# One account as the accounts endpoint returns it.
ACCOUNT_RECORD = _s(
    ("_id", S), ("name", S), ("type", S), ("status", S),
    ("connection", _s(("name", S))),
    ("balance", BALANCE),
    ("refreshed", _s(("balance", S))),
    ("meta", _s(("loan_details", LOAN_DETAILS))),
)

# Landed accounts table: flattened record + load id (key: _id).
RAW_ACCOUNTS = _s(
    ("_id", S), ("name", S), ("type", S), ("status", S),
    ("meta__loan_details__interest__rate", S), ("meta__loan_details__interest__type", S),
    ("meta__loan_details__interest__expires_at", S), ("meta__loan_details__is_interest_only", S),
    ("meta__loan_details__term__years", S), ("meta__loan_details__term__months", S),
    ("meta__loan_details__matures_at", S), ("meta__loan_details__initial_principal", S),
    ("meta__loan_details__repayment__frequency", S), ("meta__loan_details__repayment__next_date", S),
    ("meta__loan_details__repayment__next_amount", S), ("meta__loan_details__repayment__next_amount__v_double", D),
    ("_dlt_load_id", S),
)

# Landed balance snapshots (key: account_id, snapshot_date).
RAW_BALANCES = _s(
    ("account_id", S), ("snapshot_at", TimestampType()), ("snapshot_date", DateType()),
    ("account_name", S), ("account_type", S), ("connection_name", S), ("status", S), ("currency", S),
    ("current", D), ("available", D), ("limit", D), ("overdrawn", BooleanType()),
    ("refreshed_balance_at", S), ("raw_balance", S), ("_dlt_load_id", S),
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` in the declared columns and types of a landed table: a declared column that is
    missing, or one that is not declared, is an error."""
    names = [f.name for f in schema.fields]
    if set(names) != set(df.columns):
        raise ValueError(f"columns differ from the declared table: {sorted(set(names) ^ set(df.columns))}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
