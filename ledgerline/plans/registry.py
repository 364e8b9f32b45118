"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the adapters in ``sources.fixtures``
and runs the engine's operators on the whole tables. At the output edge instants
are given as naive UTC timestamps so results compare across engines and sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ledgerline.functions import exprs
from ledgerline.functions.exprs import naive_utc
from ledgerline.operators import ingest, projection, quality, staging
from ledgerline.operators.merge import dedupe_batch, merge_by_key
from ledgerline.plans import marts, models
from ledgerline.session import prepare
from ledgerline.sources import cobucketed, fixtures, landed, maintained, sinks
from ledgerline.sources.tables import read_table, resolve_table, table_exists

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return edge(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def edge(df: DataFrame) -> DataFrame:
    """Instants -> naive UTC wall clock; everything else unchanged."""
    if not any(isinstance(f.dataType, TimestampType) for f in df.schema.fields):
        return df
    return df.select(*[
        naive_utc(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# --- model inputs (lazy DataFrames; nothing is computed here) ----------------

def raw_a(spark, d):
    return fixtures.raw_accounts(spark, d)


def raw_b(spark, d):
    return fixtures.raw_balances_intraday(spark, d)


def raw_o(spark, d):
    return fixtures.raw_balances_history(spark, d)


def records(spark, d):
    return fixtures.api_records(spark, d, faults=True)


def raw_a_dated(spark, d):
    return fixtures.raw_accounts(spark, d, with_load_date=True)


def stg_a(spark, d):
    return staging.stg_accounts(raw_a(spark, d))


def stg_b(spark, d):
    return staging.stg_balances(raw_b(spark, d))


def stg_o(spark, d):
    return staging.stg_balances(raw_o(spark, d))


def daily_b(spark, d):
    return models.daily_balances(stg_b(spark, d))


def daily_o(spark, d):
    return models.daily_balances(stg_o(spark, d))


def dim_a(spark, d):
    return models.dim_loans(stg_a(spark, d))


def mot_b(spark, d):
    return models.portfolio_daily(daily_b(spark, d))


# --- staging, models ---------------------------------------------------------

@register("stg_accounts")
def q_stg_accounts(spark, d):
    """Typed accounts staging (A)."""
    return stg_a(spark, d)


@register("stg_balances")
def q_stg_balances(spark, d):
    """Typed balance staging (B)."""
    return stg_b(spark, d)


@register("daily_balances")
def q_daily_balances(spark, d):
    """Last snapshot per account and day (B)."""
    return daily_b(spark, d)


@register("portfolio_daily")
def q_portfolio_daily(spark, d):
    """Daily portfolio totals (B)."""
    return mot_b(spark, d)


@register("dim_loans")
def q_dim_loans(spark, d):
    """Loan dimension: latest version, then the loan filter (A)."""
    return dim_a(spark, d)


# --- marts and KPIs ----------------------------------------------------------

HISTORY_ACCOUNT = "7"   # the account whose balance history the history query returns


def mot_o(spark, d):
    return models.portfolio_daily(daily_o(spark, d))


@register("accounts_latest")
def q_accounts_latest(spark, d):
    """Every account at its latest version, ordered by name, NULL names last (A)."""
    return marts.accounts_latest(stg_a(spark, d))


@register("account_history")
def q_account_history(spark, d):
    """Daily balance history of one account (B)."""
    return marts.account_history(daily_b(spark, d), HISTORY_ACCOUNT)


@register("portfolio_series")
def q_portfolio_series(spark, d):
    """Multi-year daily portfolio series (O)."""
    return marts.portfolio_series(mot_o(spark, d))


@register("latest_snapshot")
def q_latest_snapshot(spark, d):
    """Freshness probe: newest snapshot date as text (O)."""
    return marts.latest_snapshot(mot_o(spark, d))


@register("prev_month_end")
def q_prev_month_end(spark, d):
    """Latest date and the last date before its month (O)."""
    return marts.prev_month_end(mot_o(spark, d))


@register("latest_loan_balance")
def q_latest_loan_balance(spark, d):
    """Latest loan-typed balance per account, type filter before the pick (O)."""
    return marts.latest_loan_balance(daily_o(spark, d))


@register("loan_balance_join")
def q_loan_balance_join(spark, d):
    """Loan dimension joined with each loan's latest balance (A x O)."""
    return marts.loan_balance_join(dim_a(spark, d), marts.latest_loan_balance(daily_o(spark, d)))


@register("weighted_rate")
def q_weighted_rate(spark, d):
    """Balance-weighted interest rate and total exposure (A x O)."""
    return marts.weighted_rate(marts.loan_balance_join(dim_a(spark, d), marts.latest_loan_balance(daily_o(spark, d))))


@register("loan_kpis")
def q_loan_kpis(spark, d):
    """Loan KPI row: total net debt, monthly change, weighted rate (A x O)."""
    daily = daily_o(spark, d)
    return marts.loan_kpis(models.portfolio_daily(daily), dim_a(spark, d), daily)


@register("loan_kpis_bucketed")
def q_loan_kpis_bucketed(spark, d):
    """Loan KPI row from stored loans and newest balances, bucketed alike and joined without a shuffle;
    the balances come in two batches, the newer first (A x O)."""
    dim, newest = co_bucketed_loans(spark, d)
    return marts.kpi_row(models.portfolio_daily(daily_o(spark, d)), marts.loan_balance_join(dim, newest.select("account_id", "current_balance")))


def co_bucketed_loans(spark, d):
    """The loan dimension and each loan's newest balance as tables bucketed by account."""
    from ledgerline.session import scratch_path
    place = lambda name: ((path := scratch_path(spark, name)).rsplit("/", 1)[1].replace("-", "_"), path)
    dim = cobucketed.write(dim_a(spark, d).select("account_id", "loan_interest_rate"), *place("loans"), "account_id")
    facts, late = marts.loan_balances(daily_o(spark, d)), F.year("snapshot_date") >= 1998
    first, second = place("newest-balances"), place("newest-balances")
    cobucketed.write(dedupe_batch(facts.filter(late), ["account_id"], marts.LATEST_LOAN_ORDER), *first, "account_id")
    newest = cobucketed.upsert(spark, first[0], facts.filter(~late | late.isNull()), *second, "account_id", marts.LATEST_LOAN_ORDER)
    return dim, newest


@register("portfolio_maintained")
def q_portfolio_maintained(spark, d):
    """Daily totals kept by what each batch takes out of the daily fact and puts in, never summed anew:
    the snapshots of all mornings, then the others, then the mornings once more (B)."""
    from ledgerline.session import scratch_path
    snaps = stg_b(spark, d).withColumnRenamed("snapshot_at", "last_snapshot_at").select(*models.DAILY_COLUMNS)
    morning = F.coalesce(F.hour("last_snapshot_at") < 12, F.lit(False))
    kept = maintained.Maintained(spark, scratch_path(spark, "portfolio-maintained"), models.DAILY_KEY, models.STORED_ORDER,
                                 "snapshot_date", models.portfolio_delta, models.portfolio_add)
    for batch in (snaps.filter(morning), snaps.filter(~morning), snaps.filter(morning)):
        kept.upsert(batch)
    return kept.totals().drop("n_rows")


@register("resolved_models")
def q_resolved_models(spark, d):
    """Models looked up by name among candidate schemas, and the rows found there (A, B)."""
    frames = {"daily_balances": daily_b(spark, d), "dim_loans": dim_a(spark, d)}
    for name, frame in frames.items():
        frame.createOrReplaceGlobalTempView(name)
    out = None
    for name in [*frames, "no_such_model"]:
        found = resolve_table(spark, name, ["ledgerline_marts", "global_temp"])
        present = table_exists(spark, found)
        rows = spark.table(found).agg(F.count("*").alias("row_count")) if present else \
            spark.range(1).select(F.lit(None).cast("long").alias("row_count"))
        row = rows.select(F.lit(name).alias("model"), F.lit(found).alias("resolved"), F.lit(present).alias("present"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


# --- scalar functions on landed accounts (A) ----------------------------------

@register("type_normalise")
def q_type_normalise(spark, d):
    """Account type as landed and normalised (upper/trim, NULL -> '')."""
    raw = raw_a(spark, d)
    return raw.select(F.col("_id").alias("account_id"), "_dlt_load_id", F.col("type").alias("raw_type"),
                      exprs.normalise_type("type").alias("account_type"))


@register("credit_flag")
def q_credit_flag(spark, d):
    """Credit-card flag from the landed type text."""
    raw = raw_a(spark, d)
    return raw.select(F.col("_id").alias("account_id"), "_dlt_load_id", F.col("type").alias("raw_type"),
                      exprs.credit_flag("type").alias("is_credit_card"))


@register("blank_to_null_cast")
def q_blank_to_null_cast(spark, d):
    """Blank-to-NULL then strict casts: numeric, int (rounding), boolean, instant."""
    raw = raw_a(spark, d)
    L = staging.LOAN
    return raw.select(
        F.col("_dlt_load_id"),
        exprs.to_numeric(L + "interest__rate").alias("loan_interest_rate"),
        exprs.to_numeric(L + "initial_principal").alias("loan_initial_principal"),
        exprs.text_to_int(L + "term__years").alias("term_years"),
        exprs.text_to_int(L + "term__months").alias("term_months"),
        exprs.to_bool(L + "is_interest_only").alias("is_interest_only"),
        exprs.to_instant(L + "matures_at").alias("loan_matures_at"),
    )


@register("variant_coalesce")
def q_variant_coalesce(spark, d):
    """Text amount if non-blank, else the double-typed variant column."""
    raw = raw_a(spark, d)
    L = staging.LOAN + "repayment__"
    return raw.select(
        F.col("_dlt_load_id"),
        F.col(L + "next_amount").alias("next_amount_text"),
        F.col(L + "next_amount__v_double").alias("next_amount_double"),
        staging.variant_coalesce(F.col(L + "next_amount"), F.col(L + "next_amount__v_double"))
        .alias("repayment_next_amount"),
    )


# --- ingest: envelopes, keys, snapshots, merges --------------------------------

AS_OF = "2024-07-01T12:00:00Z"     # run instant of the snapshot query (next day in Auckland)
SPLIT_DATE = "1998-01-01"          # versions landed before it form the first load
MERGE_TARGET_LAST = "2024-01-20"   # balance merge: target holds days up to this one
MERGE_INCOMING_FIRST = "2024-01-15"  # incoming re-run starts here (overlap with the target)


def sent_bodies(spark, d):
    """API responses (bare array, items, result, empty items + result) over the account records,
    with balances as an API may send them: each fifth amount as text, a field that nobody
    declared in each third."""
    # each value is built once, in a projection of its own, by all cores
    k = F.col("_dlt_load_id").cast("long")
    rec = records(spark, d)
    schema = rec.schema
    rec = rec.repartition(spark.sparkContext.defaultParallelism)
    fields = [F.col("balance").getField(n).alias(n) for n in ("currency", "current", "available", "limit", "overdrawn")]
    text = F.when(k % 5 == 0, F.col("balance.current").cast("string"))
    whole = F.to_json(F.struct(fields[0], text.alias("current_text"), *fields[1:]), {"ignoreNullFields": "false"})
    # one of the two amounts stays
    whole = F.when(k % 5 == 0, F.replace(F.regexp_replace(whole, r',"current":[^,]*', ""), F.lit("current_text"), F.lit("current"))) \
             .otherwise(F.replace(whole, F.lit('"current_text":null,'), F.lit("")))
    sent = F.when(F.col("balance").isNull(), F.lit("null")).otherwise(whole)
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rec.columns if c != "balance"]))
    parts = rec.select(k.alias("k"), sent.alias("sent"), rest.alias("rest"))
    odd = F.when((F.col("k") % 3 == 0) & (F.col("sent") != "null"), F.concat(
        F.expr("substring(sent, 1, length(sent) - 1)"), F.lit(',"pending":'), (F.col("k") % 100).cast("string"), F.lit("}")))
    parts = parts.select("k", F.concat(F.lit("["), F.expr("substring(rest, 1, length(rest) - 1)"), F.lit(',"balance":'),
                                       F.coalesce(odd, "sent"), F.lit("}]")).alias("array"))
    shape = F.col("k") % 4
    before = F.when(shape == 1, F.lit('{"items":')).when(shape == 2, F.lit('{"result":')).when(shape == 3, F.lit('{"items":[],"result":')).otherwise(F.lit(""))
    return parts.select(F.concat(before, "array", F.when(shape == 0, F.lit("")).otherwise(F.lit("}"))).alias("body")), schema


def _unwrapped(spark, d, keep_raw=False):
    """The responses, landed as JSON lines and read back, the way a fetch is."""
    from ledgerline.session import scratch_path
    bodies, schema = sent_bodies(spark, d)
    path = scratch_path(spark, "landed-responses")
    bodies.write.text(path)
    return landed.read_landed(spark, path, schema, per_line=True, keep_raw=keep_raw)


@register("envelope_unwrap")
def q_envelope_unwrap(spark, d):
    """Records recovered from bare-array, items, result and empty-items envelopes."""
    return landed.flatten_struct(_unwrapped(spark, d).drop("meta"))


@register("accounts_keyed")
def q_accounts_keyed(spark, d):
    """Unwrapped records with a usable key only."""
    return landed.flatten_struct(landed.keyed_records(_unwrapped(spark, d)).drop("meta"))


@register("flatten_struct")
def q_flatten_struct(spark, d):
    """Nested account records flattened to `a__b__c` columns (the landed accounts table)."""
    return raw_a(spark, d)


@register("balance_snapshot")
def q_balance_snapshot(spark, d):
    """One balance row per keyed record for a run at AS_OF, its balance kept as sent."""
    return ingest.balance_snapshot(_unwrapped(spark, d, keep_raw=True), AS_OF)


@register("ingest_metrics")
def q_ingest_metrics(spark, d):
    """Record count and latest parseable refresh time of a fetch."""
    return ingest.ingest_metrics(records(spark, d))


@register("local_snapshot_date")
def q_local_snapshot_date(spark, d):
    """UTC event times to their calendar date in Pacific/Auckland."""
    ev = read_table(spark, d, "events", ["event_id", "ts"])
    return ev.select("event_id", "ts", exprs.local_date("ts").alias("local_date"))


@register("append_evolve")
def q_append_evolve(spark, d):
    """Two loads of the accounts table; the older lacks the variant column."""
    raw = raw_a_dated(spark, d)
    old = raw.filter(F.col("_load_date") < F.lit(SPLIT_DATE).cast("date"))
    new = raw.filter(F.col("_load_date") >= F.lit(SPLIT_DATE).cast("date"))
    v = staging.LOAN + "repayment__next_amount__v_double"
    return landed.append_evolve(old.drop(v, "_load_date"), new.drop("_load_date"))


@register("merge_accounts")
def q_merge_accounts(spark, d):
    """Upsert of the later load into the accounts table on `_id`."""
    raw = raw_a_dated(spark, d)
    split = F.lit(SPLIT_DATE).cast("date")
    order = [("_dlt_load_id", "desc")]
    target = raw.filter(F.col("_load_date") < split).drop("_load_date")   # the merge picks the newest of either side
    incoming = raw.filter(F.col("_load_date") >= split).drop("_load_date")
    return merge_by_key(target, incoming, ["_id"], order)


@register("merge_balances")
def q_merge_balances(spark, d):
    """Upsert on (account_id, snapshot_date) over all snapshots (B). The target holds every
    snapshot up to MERGE_TARGET_LAST; the incoming re-run covers MERGE_INCOMING_FIRST onwards but
    re-sends, of the overlap days, only snapshots with a balance of 1 or more. So on these days its
    rows replace the target's, and keys it does not re-send keep the target's row."""
    stg = stg_b(spark, d).withColumnRenamed("snapshot_at", "last_snapshot_at").select(*models.DAILY_COLUMNS)
    day = F.col("snapshot_date")
    target = stg.filter(day <= F.lit(MERGE_TARGET_LAST).cast("date"))
    incoming = stg.filter((day > F.lit(MERGE_TARGET_LAST).cast("date"))
                          | ((day >= F.lit(MERGE_INCOMING_FIRST).cast("date")) & (F.col("current_balance") >= 1)))
    order = [("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")]
    return merge_by_key(target, incoming, ["account_id", "snapshot_date"], order)


@register("raw_json_fields")
def q_raw_json_fields(spark, d):
    """Decode the balance as it was sent, undeclared field included, and encode fields back to JSON."""
    rec = landed.keyed_records(_unwrapped(spark, d, keep_raw=True))
    snap = ingest.balance_snapshot(rec, AS_OF, extra=["_dlt_load_id"])
    sent = snap.select("account_id", "_dlt_load_id", F.parse_json("raw_balance").alias("sent"))
    pending = F.try_variant_get("sent", "$.pending", "int")
    return sent.select("account_id", "_dlt_load_id", F.try_variant_get("sent", "$.current", "double").alias("current"),
                       pending.alias("pending"),
                       F.to_json(F.struct(F.try_variant_get("sent", "$.currency", "string").alias("currency"),
                                          pending.alias("pending"))).alias("encoded"))


@register("rows_to_json")
def q_rows_to_json(spark, d):
    """Portfolio rows as JSON objects, as an API returns them (B)."""
    return sinks.rows_to_json(marts.portfolio_series(mot_b(spark, d)))


@register("parse_or_default")
def q_parse_or_default(spark, d):
    """Number from text, default when blank or unparseable (B)."""
    raw = raw_b(spark, d)
    return raw.select("account_id", "_dlt_load_id", exprs.parse_or_default("current").alias("amount"))


@register("money_round")
def q_money_round(spark, d):
    """Money amounts rounded half-up to cents."""
    ev = read_table(spark, d, "events", ["event_id", "value"])
    return ev.select("event_id", exprs.money_round(F.col("value") * F.lit(1.075)).alias("amount_with_tax"))


# --- data quality ----------------------------------------------------------------

def _checked_models(spark, d, names):
    """The named models, each input of theirs built once."""
    acc = stg_a(spark, d)
    out = {"landed_records": records(spark, d), "stg_accounts": acc, "dim_loans": models.dim_loans(acc)}
    if {"stg_balances", "daily_balances", "portfolio_daily"} & set(names):
        bal = stg_b(spark, d)
        daily = models.daily_balances(bal)
        out |= {"stg_balances": bal, "daily_balances": daily, "portfolio_daily": models.portfolio_daily(daily)}
    return {n: out[n] for n in names}


NOT_NULL = {
    "landed_records": ["_id", "balance"],   # as fetched: some have neither
    "stg_accounts": ["account_id"],
    "stg_balances": ["account_id", "snapshot_date"],
    "daily_balances": ["account_id", "snapshot_date"],
    "portfolio_daily": ["snapshot_date"],
    "dim_loans": ["account_id"],
}
UNIQUE = {"landed_records": ["_id"], "stg_accounts": ["account_id"], "dim_loans": ["account_id"]}


@register("dq_not_null")
def q_dq_not_null(spark, d):
    """not_null checks of the model graph: failing row count per (model, column)."""
    m = _checked_models(spark, d, NOT_NULL)
    return quality.run_checks({k: (m[k], cols) for k, cols in NOT_NULL.items()}, {})


@register("dq_unique")
def q_dq_unique(spark, d):
    """unique checks: number of keys that occur more than once."""
    m = _checked_models(spark, d, UNIQUE)
    return quality.run_checks({}, {k: (m[k], cols) for k, cols in UNIQUE.items()})


# --- development (lenient) variants ----------------------------------------------

@register("stg_accounts_lenient")
def q_stg_accounts_lenient(spark, d):
    """Accounts staging without normalisation, casts or key filter (A)."""
    return staging.stg_accounts_lenient(raw_a(spark, d))


@register("daily_balances_lenient")
def q_daily_balances_lenient(spark, d):
    """Daily balances without dedupe, try_cast amounts (B)."""
    return staging.daily_balances_lenient(raw_b(spark, d))


@register("portfolio_daily_lenient")
def q_portfolio_daily_lenient(spark, d):
    """Daily totals over undeduplicated landed rows, double amounts (B)."""
    return models.portfolio_daily_lenient(raw_b(spark, d))


@register("dim_loans_lenient")
def q_dim_loans_lenient(spark, d):
    """Every LOAN-typed account version with its rate as double (A; blank rates landed as NULL)."""
    rate = staging.LOAN + "interest__rate"
    raw = raw_a(spark, d).withColumn(rate, exprs.blank_to_null(rate))
    return models.dim_loans_lenient(staging.stg_accounts_lenient(raw))


# --- spines and projections --------------------------------------------------------

@register("account_date_spine")
def q_account_date_spine(spark, d):
    """One row per account per day between its first and last snapshot (B)."""
    return projection.date_spine(stg_b(spark, d))


# --- streaming ------------------------------------------------------------------

def _landed_balances(spark, d):
    """Land the staged intraday snapshots (B) as parquet files for a file stream."""
    from ledgerline.session import scratch_path
    stg = stg_b(spark, d).withColumnRenamed("snapshot_at", "last_snapshot_at").select(*models.DAILY_COLUMNS)
    path = scratch_path(spark, "landed-balances")
    stg.write.option("maxRecordsPerFile", LANDED_ROWS).parquet(path)
    return path, stg.schema


LANDED_ROWS = 40_000   # rows a landed file holds at most


@register("stream_merge_balances")
def q_stream_merge_balances(spark, d):
    """Landed snapshot files merged batch by batch into the daily table (B)."""
    from ledgerline.session import scratch_path
    from ledgerline.streaming.merge_stream import incremental_merge
    src, schema = _landed_balances(spark, d)
    target = scratch_path(spark, "daily-balances-t1")
    incremental_merge(spark, src, schema, target, ["account_id", "snapshot_date"],
                      [("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")], "snapshot_date",
                      scratch_path(spark, "ckpt-t1"), max_files_per_trigger=2)
    return sinks.fresh_read(spark, target).select(*models.DAILY_COLUMNS)


@register("stream_latest_balances")
def q_stream_latest_balances(spark, d):
    """Streaming state keeps the latest snapshot per account-day (B)."""
    from ledgerline.session import scratch_path
    from ledgerline.streaming.merge_stream import latest_state_stream
    src, schema = _landed_balances(spark, d)
    target = scratch_path(spark, "daily-balances-t2")
    latest_state_stream(spark, src, schema, target, ["account_id", "snapshot_date"],
                        [("_dlt_load_id", "desc"), ("last_snapshot_at", "desc")], "snapshot_date",
                        scratch_path(spark, "ckpt-t2"), max_files_per_trigger=2)
    return sinks.fresh_read(spark, target).select(*models.DAILY_COLUMNS)


# --- the daily run ------------------------------------------------------------------

def _land_fetch(spark, d, newest: bool):
    """What the accounts endpoint returns, landed as JSON lines: every account's first version,
    or later the newest version of those with an even key."""
    from ledgerline.session import scratch_path
    # a version is picked by its columns, and only picked ones are built up to records
    def even_newest(j):
        return fixtures.newest_versions(j.filter(F.col("c_custkey") % 2 == 0))

    state = fixtures.api_records(spark, d, faults=False, versions=even_newest if newest else fixtures.first_versions).drop("_dlt_load_id")
    path = scratch_path(spark, "landed-accounts")
    landed.envelope_bodies(state, F.abs(F.xxhash64("_id")) % 4).write.text(path)
    return path


@register("daily_run")
def q_daily_run(spark, d):
    """K2: two fetches of one day, each ingested -> merged -> daily facts -> checked, and a re-run
    of the first, which must not undo the second; returns the stored portfolio table."""
    from ledgerline.plans.daily import run_daily
    from ledgerline.session import scratch_path
    out = scratch_path(spark, "daily-run")
    first, second = _land_fetch(spark, d, newest=False), _land_fetch(spark, d, newest=True)
    for path, load, run_no in ((first, "100", 1), (second, "200", 2), (first, "100", 1)):
        checks = run_daily(spark, path, out, AS_OF, load, run_no, per_line=True)
        if not checks.filter(F.col("failures") > 0).isEmpty():
            raise RuntimeError(f"data-quality checks failed in run {run_no}")
    return sinks.fresh_read(spark, f"{out}/portfolio_daily").select(*marts.SERIES_COLUMNS)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
