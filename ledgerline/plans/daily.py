"""The daily run: landed fetch -> raw tables -> models -> quality checks.

``run_daily`` is re-run safe: accounts are added to the hash buckets of their keys, and
balances / facts are rewritten only in the snapshot-date partition of the run. Merges
compare load ids, so running a day twice, or an older load once more after a newer one,
leaves the same tables. Checks of what a run writes are counted while it is written. A model is
refreshed only when what it is made from has changed (``plans.graph``).

Folder layout under ``out_root``::

    landed/version=<run_no>/                the fetch, parsed once, each record also as it was sent
    landed_broken/version=<run_no>/         response bodies that could not be parsed (``on_broken="skip"``)
    raw/accounts/_bucket=<n>/               landed accounts, merged on _id (``sources.buckets``)
    raw/account_balances/snapshot_date=.../ landed snapshots, merged on (account_id, snapshot_date)
    daily_balances/snapshot_date=.../
    portfolio_daily/snapshot_date=.../
    metrics/version=<run_no>/               record count, latest refresh time, broken bodies
    quality/version=<run_no>/               check results of the run
    refreshed/version=<run_no>/             which models the run has refreshed
    state/snapshot_date=.../                what the models of a date were made from

Nothing of this is ever deleted, unless ``run_daily`` is told how many versions to keep of
the folders that have one per run.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import LOCAL_ZONE
from ledgerline.operators import quality, staging
from ledgerline.operators.ingest import balance_snapshot, ingest_metrics
from ledgerline.plans import graph, models
from ledgerline.schemas import ACCOUNT_RECORD, RAW_ACCOUNTS, RAW_BALANCES, conform
from ledgerline.session import prepare
from ledgerline.sources import buckets
from ledgerline.sources.landed import RAW, RECORD, broken_bodies, flatten_struct, keyed_records, landed_bodies, read_landed
from ledgerline.sources.sinks import children, fresh_read, overwrite_partitions, read_version, upsert_partitions, write_version

ACCOUNT_KEY = ["_id"]
BALANCE_KEY = ["account_id", "snapshot_date"]
ACCOUNT_ORDER = [("_dlt_load_id", "desc"), *((f.name, "desc") for f in RAW_ACCOUNTS.fields if f.name not in ("_id", "_dlt_load_id"))]


def _p(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def current_accounts(spark: SparkSession, out_root: str) -> DataFrame:
    """The accounts table: the newest load of each account. Which of several records of one load
    stays does not depend on how they were dealt to tasks."""
    root = _p(out_root, "raw", "accounts")
    return buckets.read(spark, root, ACCOUNT_KEY, ACCOUNT_ORDER) if buckets.exists(spark, root) else spark.createDataFrame([], RAW_ACCOUNTS)


def run_date(as_of: str) -> dt.date:
    """Local calendar date of a run, the date of all its snapshots."""
    return dt.datetime.fromisoformat(as_of).astimezone(ZoneInfo(LOCAL_ZONE)).date()


def _ordered(df: DataFrame, keys: list[str], first: list) -> list:
    """``first``, then all other columns: which of several records of one load stays does not
    depend on how they were dealt to tasks."""
    used = {c for c, _ in first} | set(keys)
    return first + [(c, "desc") for c in df.columns if c not in used]


def run_daily(spark: SparkSession, landed_path: str, out_root: str, as_of: str, load_id: str,
              run_no: int, per_line: bool = False, on_broken: str = "fail", keep: int | None = None) -> DataFrame:
    """Ingest one landed fetch taken at ``as_of`` and refresh every model; returns the check frame.

    ``per_line``: the landed responses are JSON lines instead of one page per file.
    ``on_broken``: a response that cannot be parsed fails the run, or (``skip``) is kept aside
    and counted in the run's metrics.
    ``keep``: how many of the newest runs keep their landed fetch, broken bodies, metrics and check
    results; by default all do.
    """
    prepare(spark)
    date, load = run_date(as_of), [("_dlt_load_id", "desc")]
    today = lambda path: fresh_read(spark, path).filter(F.col("snapshot_date") == F.lit(date))

    # one parse of the fetch, written, feeds both raw tables and the metrics
    parsed = read_landed(spark, landed_path, ACCOUNT_RECORD, per_line, on_broken, keep_raw=True, keep_record=True)
    write_version(parsed, _p(out_root, "landed"), run_no, keep)
    records = read_version(spark, _p(out_root, "landed"), run_no)
    broken = F.lit(0).cast("long")
    if on_broken == "skip":
        write_version(broken_bodies(landed_bodies(spark, landed_path, per_line), record_schema=ACCOUNT_RECORD), _p(out_root, "landed_broken"), run_no, keep)
        broken = F.lit(read_version(spark, _p(out_root, "landed_broken"), run_no).count()).cast("long")
    write_version(ingest_metrics(records).withColumn("broken_bodies", broken), _p(out_root, "metrics"), run_no, keep)

    state = graph.State(spark, _p(out_root, "state"), date)
    fetch = graph.fingerprint(records, F.to_json(RAW), F.to_json(RECORD)) + f" {as_of} {load_id}"
    acc_path, bal_path = _p(out_root, "raw", "accounts"), _p(out_root, "raw", "account_balances")
    day = f"snapshot_date={date.isoformat()}"
    has = lambda path: day in children(spark, path)
    made: dict[str, dict] = {}
    written: list[str] = []

    def raw_accounts() -> dict:
        """Keyed records, flattened, stamped, added to the buckets of their keys."""
        accounts = conform(flatten_struct(keyed_records(records).select("_id", "name", "type", "status", "meta"))
                           .withColumn("_dlt_load_id", F.lit(load_id)), RAW_ACCOUNTS)
        buckets.merge(accounts, acc_path, ACCOUNT_KEY, ACCOUNT_ORDER)
        return {}

    def raw_balances() -> dict:
        """One snapshot per keyed record, merged into the partition of the run's date."""
        snaps = conform(balance_snapshot(records, as_of).withColumn("_dlt_load_id", F.lit(load_id)), RAW_BALANCES)
        upsert_partitions(spark, snaps, bal_path, BALANCE_KEY, _ordered(snaps, BALANCE_KEY, [*load, ("snapshot_at", "desc")]),
                          "snapshot_date", order_proof=True)
        return {}

    # facts: only that date, checked while they are written
    def daily_balances() -> dict:
        watched = [quality.Observed(m, NOT_NULL[m]) for m in ("stg_balances", "daily_balances")]
        told = graph.Told(graph.GRAPH["portfolio_daily"]["daily_balances"])
        facts = models.daily_balances(watched[0].watch(staging.stg_balances(today(bal_path))))
        overwrite_partitions(told.watch(watched[1].watch(facts)), _p(out_root, "daily_balances"), "snapshot_date", ["account_id"])
        return {"told": told.text(), "checks": [r for w in watched for r in w.rows()]}

    def portfolio_daily() -> dict:
        watched = quality.Observed("portfolio_daily", NOT_NULL["portfolio_daily"])
        overwrite_partitions(watched.watch(models.portfolio_daily(today(_p(out_root, "daily_balances")))), _p(out_root, "portfolio_daily"), "snapshot_date")
        return {"checks": watched.rows()}

    def account_checks() -> dict:
        acc = staging.stg_accounts(current_accounts(spark, out_root))
        frames = [quality.model_checks(name, df, NOT_NULL[name], UNIQUE[name])
                  for name, df in (("stg_accounts", acc), ("dim_loans", models.dim_loans(acc)))]
        return {"checks": [tuple(r) for r in reduce(DataFrame.unionByName, frames).collect()]}     # one row per check

    # model -> how it is refreshed, what its inputs are told by, whether it is there
    steps = {
        "raw_accounts": (raw_accounts, lambda: fetch, lambda: buckets.exists(spark, acc_path)),
        "raw_balances": (raw_balances, lambda: fetch, lambda: bool(children(spark, bal_path))),
        "daily_balances": (daily_balances, lambda: graph.of_files(children(spark, _p(bal_path, day))), lambda: has(_p(out_root, "daily_balances"))),
        "portfolio_daily": (portfolio_daily, lambda: made["daily_balances"]["told"], lambda: has(_p(out_root, "portfolio_daily"))),
        "account_checks": (account_checks, lambda: graph.of_files(n for names in buckets.files(spark, acc_path).values() for n in names), lambda: True),
    }
    for model in graph.in_order():
        build, inputs, there = steps[model]
        made[model], ran = state.refresh(model, inputs(), build, there())
        written += [model] if ran else []
    state.close()

    checks = spark.createDataFrame([tuple(r) for m in ("daily_balances", "portfolio_daily", "account_checks") for r in made[m]["checks"]],
                                   "model string, column_name string, check_name string, failures long")
    write_version(checks.coalesce(1), _p(out_root, "quality"), run_no, keep)
    write_version(spark.createDataFrame([(m, m in written) for m in graph.in_order()], "model string, refreshed boolean").coalesce(1),
                  _p(out_root, "refreshed"), run_no, keep)
    return read_version(spark, _p(out_root, "quality"), run_no)


NOT_NULL = {
    "stg_accounts": ["account_id"], "stg_balances": ["account_id", "snapshot_date"],
    "daily_balances": ["account_id", "snapshot_date"], "portfolio_daily": ["snapshot_date"],
    "dim_loans": ["account_id"],
}
UNIQUE = {"stg_accounts": ["account_id"], "dim_loans": ["account_id"]}


def model_frames(spark: SparkSession, out_root: str) -> dict[str, DataFrame]:
    """The model graph over the stored tables (views computed on read)."""
    stored = lambda *parts: fresh_read(spark, _p(out_root, *parts))
    stg_acc = staging.stg_accounts(current_accounts(spark, out_root))
    return {
        "stg_accounts": stg_acc,
        "stg_balances": staging.stg_balances(stored("raw", "account_balances")),
        "daily_balances": stored("daily_balances"),
        "portfolio_daily": stored("portfolio_daily"),
        "dim_loans": models.dim_loans(stg_acc),
    }


def run_checks(spark: SparkSession, out_root: str) -> DataFrame:
    """The checks of the model graph over all that is stored, one scan per model."""
    m = model_frames(spark, out_root)
    frames = [quality.model_checks(name, m[name], cols, UNIQUE.get(name, ())) for name, cols in NOT_NULL.items()]
    return reduce(DataFrame.unionByName, frames)


def register_views(spark: SparkSession, out_root: str) -> list[str]:
    """Expose the stored models as temporary views for SQL users (views stay lazy:
    staging and the dimension are computed on read, the facts are stored tables)."""
    frames = model_frames(spark, out_root)
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return sorted(frames)


def main(argv: list[str] | None = None) -> int:
    """Job entry point, e.g. ``spark-submit --py-files ledgerline.zip ledgerline/plans/daily.py ...``.

    Uses the session the launcher provides (master, checkpoint folder); exits non-zero
    when a quality check fails.
    """
    import argparse

    parser = argparse.ArgumentParser(description="Ingest one landed fetch and refresh the models.")
    parser.add_argument("--landed", required=True, help="folder of landed API responses")
    parser.add_argument("--out", required=True, help="root folder of the tables")
    parser.add_argument("--as-of", required=True, help="fetch instant, ISO-8601 with offset")
    parser.add_argument("--load-id", required=True, help="load id stamped on every row")
    parser.add_argument("--run-no", required=True, type=int, help="version number of this run")
    parser.add_argument("--per-line", action="store_true", help="responses are JSON lines")
    parser.add_argument("--keep", type=int, help="runs whose fetch and results are kept (default: all)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerline-daily").getOrCreate()
    checks = run_daily(spark, args.landed, args.out, args.as_of, args.load_id, args.run_no, args.per_line,
                       keep=args.keep)
    failed = checks.filter(F.col("failures") > 0).collect()   # at most one row per check
    for row in failed:
        print(f"check failed: {row.model}.{row.column_name} {row.check_name}: {row.failures}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
