"""Stored tables: no rows are lost by errors, NULL partitions, re-runs or replays."""
import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrameReader

from ledgerline import session
from ledgerline.plans import daily
from ledgerline.schemas import ACCOUNT_RECORD, RAW_BALANCES, conform
from ledgerline.sources import landed, sinks, tables

SCHEMA = "k string, day date, v int, load string"
D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
KEYS, ORDER = ["k", "day"], [("load", "desc")]


def rows(spark, path):
    return sorted(map(repr, sinks.fresh_read(spark, path).select("k", "day", "v", "load").collect()))


def upsert(spark, path, data, **kw):
    sinks.upsert_partitions(spark, spark.createDataFrame(data, SCHEMA), path, KEYS, ORDER, "day", **kw)


@pytest.fixture
def path(spark, tmp_path):
    p = f"{tmp_path}/t"
    upsert(spark, p, [("a", D1, 1, "1"), ("b", D1, 1, "1"), ("c", D2, 1, "1"), ("n", None, 1, "1"), ("m", None, 1, "1")])
    return p


def test_upsert_touches_only_its_partitions(spark, path):
    upsert(spark, path, [("a", D1, 2, "2")])
    got = {r.k: r.v for r in sinks.fresh_read(spark, path).collect()}
    assert got == {"a": 2, "b": 1, "c": 1, "n": 1, "m": 1}


def test_null_partition_keeps_its_other_rows(spark, path):
    upsert(spark, path, [("n", None, 5, "2"), ("c", D2, 5, "2")])
    assert {r.k: r.v for r in sinks.fresh_read(spark, path).collect()} == {"a": 1, "b": 1, "c": 5, "n": 5, "m": 1}
    upsert(spark, path, [("x", None, 6, "3")])
    assert sinks.fresh_read(spark, path).count() == 6
    upsert(spark, path, [])
    assert sinks.fresh_read(spark, path).count() == 6


def test_read_error_ends_the_write_and_leaves_the_table(spark, path, monkeypatch):
    before = rows(spark, path)

    def broken(self, *a, **k):
        raise OSError("listing failed")

    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "parquet", broken)
        with pytest.raises(OSError):
            upsert(spark, path, [("a", D1, 2, "2")])
    assert rows(spark, path) == before


def test_failing_job_leaves_the_table(spark, path):
    before = rows(spark, path)
    bad = spark.createDataFrame([("a", D1, 2, "2")], SCHEMA).selectExpr("k", "day", "cast(raise_error('x') as int) AS v", "load")
    with pytest.raises(PySparkException):
        sinks.upsert_partitions(spark, bad, path, KEYS, ORDER, "day")
    assert rows(spark, path) == before


def test_older_load_does_not_undo_a_newer_one(spark, path):
    upsert(spark, path, [("a", D1, 9, "2")], order_proof=True)
    upsert(spark, path, [("a", D1, 1, "1")], order_proof=True)
    assert sinks.fresh_read(spark, path).filter("k = 'a'").first().v == 9


def test_versions(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/v"
    assert sinks.latest_version(spark, root) is None
    for n in (1, 2, 3, 10):
        sinks.write_version(spark.range(n), root, n)
    assert sinks.versions(spark, root) == [1, 2, 3, 10]
    assert sinks.latest_version(spark, root).count() == 10 and sinks.latest_version(spark, root, before=3).count() == 2
    (tmp_path / "v" / "version=000000000011").mkdir()          # a version that was never finished
    assert sinks.latest_version(spark, root).count() == 10
    sinks.write_version(spark.range(12), root, 12, keep=2)
    assert sinks.versions(spark, root) == [10, 12]
    monkeypatch.setattr(DataFrameReader, "parquet", lambda *a, **k: (_ for _ in ()).throw(OSError("x")))
    with pytest.raises(OSError):
        sinks.latest_version(spark, root)


def account(_id, current, **more):
    return {"_id": _id, "name": f"acc {_id}", "type": "LOAN", "status": "ACTIVE", "connection": {"name": "Bank"},
            "balance": {"currency": "NZD", "current": current, "available": None, "limit": None, "overdrawn": False, **more},
            "refreshed": {"balance": "2024-07-01T00:00:00Z"}, "meta": {"loan_details": {"interest": {"rate": "4.5"}}}}


def land(tmp_path, name, *pages):
    d = tmp_path / name
    d.mkdir()
    for i, page in enumerate(pages):
        (d / f"page{i}.json").write_text(page if isinstance(page, str) else json.dumps(page))
    return str(d)


AT = "2024-07-01T01:00:00Z"


def test_rerun_of_an_older_load_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    one, two = land(tmp_path, "one", [account("m1", -500.0), account("m2", -1.0)]), land(tmp_path, "two", [account("m1", -400.0)])
    daily.run_daily(spark, one, out, AT, "100", 1)
    daily.run_daily(spark, two, out, AT, "200", 2)
    state = lambda: {n: sorted(map(repr, f.collect())) for n, f in daily.model_frames(spark, out).items()}
    before = state()
    checks = daily.run_daily(spark, one, out, AT, "100", 1)
    assert state() == before and checks.filter("failures > 0").isEmpty()
    got = {r.account_id: float(r.current_balance) for r in daily.model_frames(spark, out)["daily_balances"].collect()}
    assert got == {"m1": -400.0, "m2": -1.0}
    metrics = sinks.read_version(spark, f"{out}/metrics", 1).first()
    assert (metrics.record_count, metrics.latest_refreshed, metrics.broken_bodies) == (2, "2024-07-01T00:00:00+00:00", 0)


def test_two_records_of_one_key_in_a_fetch(spark, tmp_path):
    pages = [[account("m1", -5.0)], [account("m1", -7.0)], [account("m1", -6.0)]]
    got = set()
    for i, order in enumerate(([0, 1, 2], [2, 1, 0])):
        out = str(tmp_path / f"out{i}")
        daily.run_daily(spark, land(tmp_path, f"f{i}", *[pages[k] for k in order]), out, AT, "100", 1)
        got.add(tuple(float(r.current_balance) for r in daily.model_frames(spark, out)["daily_balances"].collect()))
    assert len(got) == 1


def test_broken_response_fails_or_is_kept_aside(spark, tmp_path):
    whole, cut = json.dumps([account("m1", -5.0)]), json.dumps({"items": [account("m2", -5.0), account("m3", -5.0)]})[:-40]
    fetch, out = land(tmp_path, "fetch", whole, cut), str(tmp_path / "out")
    with pytest.raises(PySparkException, match="broken response body"):
        daily.run_daily(spark, fetch, out, AT, "100", 1)
    assert sinks.versions(spark, f"{out}/raw/accounts") == []
    daily.run_daily(spark, fetch, out, AT, "100", 1, on_broken="skip")
    assert sinks.read_version(spark, f"{out}/landed_broken", 1).first().body == cut
    assert sinks.read_version(spark, f"{out}/metrics", 1).first().broken_bodies == 1
    assert landed.read_landed(spark, land(tmp_path, "empty", {"error": "none"}, []), ACCOUNT_RECORD).count() == 0


def test_declared_tables(spark):
    good = spark.createDataFrame([], RAW_BALANCES)
    assert conform(good.select(*reversed(good.columns)), RAW_BALANCES).schema == RAW_BALANCES
    with pytest.raises(ValueError):
        conform(good.drop("current"), RAW_BALANCES)
    with pytest.raises(ValueError):
        conform(good.withColumnRenamed("current", "now"), RAW_BALANCES)


def test_catalog_lookups(spark):
    spark.range(3).createOrReplaceGlobalTempView("lookup_me")
    assert tables.resolve_table(spark, "lookup_me", ["no_such_db", "global_temp"]) == "global_temp.lookup_me"
    assert tables.resolve_table(spark, "nowhere", ["no_such_db", "global_temp"]) == "nowhere"
    assert not tables.table_exists(spark, "no_such_db.lookup_me")


def test_no_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session)


def _rows_scanned(df):
    """Rows that the table scan of a plan gave, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(scans)


def _row_groups(path, column, value):
    """How many row groups of a table's files may hold a value, by their ranges, and how many there are."""
    import glob

    import pyarrow.parquet as pq
    held = total = 0
    for name in glob.glob(f"{path}/*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for i in range(meta.num_row_groups):
            own = [meta.row_group(i).column(c) for c in range(meta.num_columns)]
            stats = next(c.statistics for c in own if c.path_in_schema == column)
            total += 1
            held += stats.min <= value <= stats.max
    return held, total


def test_one_account_is_read_without_the_others(spark, tmp_path):
    from pyspark.sql import functions as F
    days = spark.range(40_000).select(F.concat(F.lit("acc_"), F.lpad((F.col("id") * 7_919 % 20_000).cast("string"), 6, "0")).alias("account_id"),
                                      F.when(F.col("id") < 20_000, F.lit(D1)).otherwise(F.lit(D2)).alias("day"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    spark.conf.set("parquet.block.size", str(128 * 1024))
    try:
        for name, cluster in (("dealt", []), ("clustered", ["account_id"])):
            sinks.overwrite_partitions(days, f"{tmp_path}/{name}", "day", cluster)
    finally:
        spark.conf.unset("parquet.block.size")
    one = lambda name: sinks.fresh_read(spark, f"{tmp_path}/{name}").filter("account_id = 'acc_012345'")
    assert sorted(r.day for r in one("clustered").collect()) == [D1, D2]
    assert sorted(one("clustered").collect()) == sorted(one("dealt").collect())
    (held, all_), (held_dealt, all_dealt) = (_row_groups(f"{tmp_path}/{n}", "account_id", "acc_012345") for n in ("clustered", "dealt"))
    assert all_ > 20 and held == 2 and held_dealt > all_dealt / 2   # one row group a day
    assert _rows_scanned(one("clustered")) <= 40_000 / all_ * 4
    # an upsert keeps the order of the files it rewrites
    sinks.upsert_partitions(spark, days.filter("account_id = 'acc_000001'"), f"{tmp_path}/clustered", ["account_id", "day"],
                            [("payload", "desc")], "day")
    assert sinks.fresh_read(spark, f"{tmp_path}/clustered").count() == 40_000
    stored = [r.account_id for r in sinks.fresh_read(spark, f"{tmp_path}/clustered").filter(F.col("day") == D1).coalesce(1).collect()]
    assert stored == sorted(stored)
