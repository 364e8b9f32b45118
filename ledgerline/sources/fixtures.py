"""Account-shaped inputs derived from the driver tables.

The driver ships TPC-H-like tables, not bank accounts, so three adapters give the
engine account data whose size grows with the driver tables:

* ``api_records``   customer ⋈ orders -> nested account records as an accounts API
                    returns them (one record per order = one version of the account)
* ``raw_accounts``  (A) the landed, flattened accounts table: ``flatten(records)``
* ``raw_balances_intraday`` (B) events ⋈ customer -> many snapshots per account-day
* ``raw_balances_history``  (O) orders ⋈ customer -> multi-year daily balances

All values are loosely typed text where the landed tables are text, so the strict
staging casts are exercised. Every rule below is a deterministic function of the
row, so the DuckDB oracle in ``plans.oracle`` rebuilds the same rows with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.latest import latest_per_key
from ledgerline.sources.tables import read_table

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]

# Fixed adapter values: market segment -> account type text as an API would send it.
SEGMENT_TYPES = [
    ("BUILDING", "LOAN"),
    ("MACHINERY", " loan "),
    ("HOUSEHOLD", "CreditCard"),
    ("AUTOMOBILE", "SAVINGS"),
]
# Other segments by c_custkey % 4: 0 -> 'Loan', 1 -> '', 2 -> NULL, 3 -> 'LOAN CARD'.


def segment_type(seg: Column, custkey: Column) -> Column:
    expr = F
    for segment, type_text in SEGMENT_TYPES:
        expr = expr.when(seg == segment, F.lit(type_text))
    return (expr.when(custkey % 4 == 0, F.lit("Loan"))
                .when(custkey % 4 == 1, F.lit(""))
                .when(custkey % 4 == 3, F.lit("LOAN CARD")))


def version_type(orderkey: Column, seg: Column, custkey: Column) -> Column:
    """Every 7th version re-types the account to SAVINGS (a later load may drop a loan)."""
    return F.when(orderkey % 7 == 0, F.lit("SAVINGS")).otherwise(segment_type(seg, custkey))


def account_name(custkey: Column, name: Column) -> Column:
    return F.when(custkey % 13 == 0, F.lit(None).cast("string")).otherwise(name)


def _ts_text(ts: Column, days: int) -> Column:
    """Naive timestamp + days as '<yyyy-MM-dd HH:mm:ss>Z' (UTC instant text)."""
    shifted = ts + F.make_dt_interval(days=F.lit(days))
    return F.concat(shifted.cast("string"), F.lit("Z"))


def _dec_text(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(18,{scale})").cast("string")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer", CUSTOMER_COLS)


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders", ORDER_COLS)
    return c.join(o, c.c_custkey == o.o_custkey)


def first_versions(j: DataFrame) -> DataFrame:
    """Of customer ⋈ orders, each customer's row of the least load id."""
    whole = F.struct(*[F.col(f"`{c}`") for c in j.columns])
    return j.groupBy("c_custkey").agg(F.min_by(whole, F.col("o_orderkey").cast("string")).alias("r")).select("r.*")


def newest_versions(j: DataFrame) -> DataFrame:
    """Of customer ⋈ orders, each customer's row of the greatest load id."""
    return latest_per_key(j.withColumn("__load", F.col("o_orderkey").cast("string")), ["c_custkey"], [("__load", "desc")]).drop("__load")


def _account_tree(k: Column, ck: Column, ts: Column, faults: bool) -> dict:
    """The account record as a tree of columns (dict = struct), in API field order."""
    acct_id = ck.cast("string")
    if faults:
        acct_id = (F.when(k % 50 == 7, F.lit(""))
                    .when(k % 50 == 8, F.lit(None).cast("string"))
                    .otherwise(acct_id))
    refreshed_at = F.date_format(
        ts + F.make_dt_interval(secs=(k % 86400).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if faults:
        refreshed_at = (F.when(k % 13 == 0, F.lit("pending"))
                         .when(k % 17 == 0, F.lit(""))
                         .otherwise(refreshed_at))
    return {
        "_id": acct_id,
        "name": account_name(ck, F.col("c_name")),
        "type": version_type(k, F.col("c_mktsegment"), ck),
        "status": F.when(F.col("o_orderstatus") == "F", F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")),
        "connection": ({"name": F.concat(F.lit("Bank "), F.col("c_nationkey").cast("string"))},
                       (k % 23 == 0) if faults else None),
        "balance": ({
            "currency": F.lit("NZD"),
            "current": F.col("o_totalprice"),
            "available": F.col("c_acctbal"),
            "limit": F.when(F.col("o_orderstatus") == "O", F.lit(600000.0)),
            "overdrawn": F.col("c_acctbal") < 0,
        }, (k % 19 == 0) if faults else None),
        "refreshed": ({"balance": refreshed_at}, (k % 29 == 0) if faults else None),
        "meta": {"loan_details": {
            "interest": {
                "rate": F.when(ck % 5 == 0, F.lit(""))
                         .otherwise(((k % 400 + 200) / F.lit(100.0)).cast("decimal(18,3)").cast("string")),
                "type": F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), F.lit("floating"))
                         .otherwise(F.lit("fixed")),
                "expires_at": _ts_text(ts, 1095),
            },
            "is_interest_only": F.when(k % 3 == 0, F.lit("true")).when(k % 3 == 1, F.lit("false"))
                                 .otherwise(F.lit("")),
            "term": {
                "years": F.when(k % 5 == 0, F.lit("30")).when(k % 5 == 1, F.lit("25.5"))
                          .when(k % 5 == 2, F.lit("")).when(k % 5 == 3, F.lit("30.4996"))
                          .otherwise(F.concat((k % 21 + 10).cast("string"), F.lit(".7"))),
                "months": (k % 12).cast("string"),
            },
            "matures_at": _ts_text(ts, 10950),
            "initial_principal": F.when(k % 9 == 0, F.lit(""))
                                  .otherwise((F.col("o_totalprice").cast("decimal(18,2)") * 4).cast("string")),
            "repayment": {
                "frequency": F.when(k % 2 == 0, F.lit("monthly")).otherwise(F.lit("fortnightly")),
                "next_date": _ts_text(ts, 30),
                "next_amount": F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(None).cast("string"))
                                .otherwise(F.concat((k % 5000).cast("string"), F.lit(".25"))),
                "next_amount__v_double": F.when(k % 2 == 0, F.col("o_totalprice")),
            },
        }},
    }


def _nested(node) -> Column:
    """Tree -> struct column; a (tree, missing) pair gives NULL where ``missing`` holds."""
    if isinstance(node, tuple):
        tree, missing = node
        built = _nested(tree)
        return built if missing is None else F.when(missing, F.lit(None)).otherwise(built)
    if isinstance(node, dict):
        return F.struct(*[_nested(v).alias(name) for name, v in node.items()])
    return node


def _flat(node, prefix: str = "", missing=None):
    """Tree -> flat ``a__b__c`` columns, the same values ``flatten_struct(_nested(tree))`` gives."""
    if isinstance(node, tuple):
        tree, miss = node
        both = miss if missing is None else (missing if miss is None else (missing | miss))
        yield from _flat(tree, prefix, both)
    elif isinstance(node, dict):
        for name, v in node.items():
            yield from _flat(v, f"{prefix}{name}" if not prefix else f"{prefix}__{name}", missing)
    else:
        yield (node if missing is None else F.when(missing, F.lit(None)).otherwise(node)).alias(prefix)


def api_records(spark: SparkSession, sf_dir: str, faults: bool = True, with_load_date: bool = False,
                versions: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nested account records (one per order), plus ``_dlt_load_id`` = order key text.

    ``faults`` injects records an API may send: ``_id`` '' or NULL, missing
    ``balance`` / ``connection`` / ``refreshed`` structs, unparseable refresh times.
    ``versions`` picks the rows of customer ⋈ orders that records are built of.
    """
    j = customer_orders(spark, sf_dir)
    if versions is not None:
        j = versions(j)
    k, ck, ts = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_orderdate")
    tree = _account_tree(k, ck, ts, faults)
    return j.select(
        *[_nested(v).alias(name) for name, v in tree.items()],
        k.cast("string").alias("_dlt_load_id"),
        *([ts.cast("date").alias("_load_date")] if with_load_date else []),
    )


def raw_accounts(spark: SparkSession, sf_dir: str, with_load_date: bool = False) -> DataFrame:
    """(A) landed accounts table: key, name, type, status, flattened ``meta`` and load id.

    Equal to ``flatten_struct`` of the record's key, name, type, status and meta
    (see the tests), built flat so no struct is materialised per row.
    ``with_load_date`` adds ``_load_date`` (the order date), the day the version landed.
    """
    j = customer_orders(spark, sf_dir)
    k, ck, ts = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_orderdate")
    tree = _account_tree(k, ck, ts, faults=False)
    keep = {n: tree[n] for n in ("_id", "name", "type", "status", "meta")}
    return j.select(
        *_flat(keep),
        k.cast("string").alias("_dlt_load_id"),
        *([ts.cast("date").alias("_load_date")] if with_load_date else []),
    )


def raw_balances_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(B) landed balance snapshots: one per event, ~2 per account-day; each snapshot is its own
    load, so the load id (the event time as fixed-width text) orders the day's versions."""
    e = read_table(spark, sf_dir, "events", EVENT_COLS)
    c = _customers(spark, sf_dir)
    j = e.join(c, e.user_id == c.c_custkey)
    eid, ts = F.col("event_id"), F.col("ts")
    return j.select(
        F.col("user_id").cast("string").alias("account_id"),
        F.when(eid % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(ts.cast("string"), F.lit("Z"))).alias("snapshot_at"),
        ts.cast("date").alias("snapshot_date"),
        account_name(F.col("c_custkey"), F.col("c_name")).alias("account_name"),
        segment_type(F.col("c_mktsegment"), F.col("c_custkey")).alias("account_type"),
        F.concat(F.lit("Bank "), F.col("c_nationkey").cast("string")).alias("connection_name"),
        F.when(F.col("event_type") == "error", F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.lit("NZD").alias("currency"),
        F.when(eid % 11 == 0, F.lit("")).otherwise(_dec_text(F.col("value"))).alias("current"),
        F.when(eid % 3 == 0, F.lit(None).cast("string")).otherwise(_dec_text(F.col("c_acctbal"))).alias("available"),
        F.when(F.col("event_type") == "click", F.lit("5000")).alias("limit"),
        (F.col("value") < 5).alias("overdrawn"),
        F.concat(ts.cast("string"), F.lit("Z")).alias("refreshed_balance_at"),
        F.col("props").alias("raw_balance"),
        F.date_format(ts, "yyyyMMddHHmmss.SSSSSS").alias("_dlt_load_id"),
    )


def raw_balances_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(O) landed balances spanning years: one per order, load id = order key text."""
    j = customer_orders(spark, sf_dir)
    k, ts = F.col("o_orderkey"), F.col("o_orderdate")
    return j.select(
        F.col("o_custkey").cast("string").alias("account_id"),
        F.concat(ts.cast("string"), F.lit("Z")).alias("snapshot_at"),
        ts.cast("date").alias("snapshot_date"),
        account_name(F.col("c_custkey"), F.col("c_name")).alias("account_name"),
        version_type(k, F.col("c_mktsegment"), F.col("c_custkey")).alias("account_type"),
        F.concat(F.lit("Bank "), F.col("c_nationkey").cast("string")).alias("connection_name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.lit("NZD").alias("currency"),
        _dec_text(F.col("o_totalprice")).alias("current"),
        _dec_text(F.col("c_acctbal")).alias("available"),
        F.when(F.col("o_orderstatus") == "O", F.lit("600000")).alias("limit"),
        (F.col("c_acctbal") < 0).alias("overdrawn"),
        F.concat(ts.cast("string"), F.lit("Z")).alias("refreshed_balance_at"),
        F.lit(None).cast("string").alias("raw_balance"),
        k.cast("string").alias("_dlt_load_id"),
    )
