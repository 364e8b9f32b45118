"""The daily run refreshes only the models whose inputs have changed."""
import os

import pytest

from ledgerline.plans import daily, graph
from ledgerline.sources.sinks import read_version
from test_daily_run import account, land, snapshot

AT = "2024-07-01T01:00:00Z"


def stored(out):
    return {f: os.stat(f).st_mtime_ns for top in ("raw", "daily_balances", "portfolio_daily")
            for d, _, names in os.walk(f"{out}/{top}") for n in names if n.endswith(".parquet") for f in [f"{d}/{n}"]}


def refreshed(spark, out, run_no):
    return {r.model for r in read_version(spark, f"{out}/refreshed", run_no).collect() if r.refreshed}


def test_order():
    order = graph.in_order()
    assert sorted(order) == sorted(graph.GRAPH)
    assert all(order.index(i) < order.index(m) for m, inputs in graph.GRAPH.items() for i in inputs if i in order)


def test_only_what_changed(spark, tmp_path):
    out = str(tmp_path / "out")
    first = land(tmp_path, "first", [{"items": [account("m1", "LOAN", -500.0), account("s1", "SAVINGS", 9.0)]}])
    checks = daily.run_daily(spark, first, out, AT, "100", 1).collect()
    assert refreshed(spark, out, 1) == set(graph.GRAPH)
    files, tables = stored(out), snapshot(spark, out)
    # the same fetch again, its pages in another order: no table is written, the checks are told as before
    again = land(tmp_path, "again", [[account("s1", "SAVINGS", 9.0)], [account("m1", "LOAN", -500.0)]])
    assert sorted(daily.run_daily(spark, again, out, AT, "100", 2).collect()) == sorted(checks)
    assert refreshed(spark, out, 2) == set() and stored(out) == files
    # a newer load with the same amounts: the totals do not read what changed
    daily.run_daily(spark, again, out, AT, "200", 3)
    assert refreshed(spark, out, 3) == set(graph.GRAPH) - {"portfolio_daily"}
    # another amount
    more = land(tmp_path, "more", [[account("m1", "LOAN", -400.0)]])
    daily.run_daily(spark, more, out, AT, "300", 4)
    assert refreshed(spark, out, 4) == set(graph.GRAPH)
    # a fetch that was merged before two others: nothing to do, nothing undone
    now = snapshot(spark, out)
    daily.run_daily(spark, first, out, AT, "100", 5)
    assert refreshed(spark, out, 5) == set() and snapshot(spark, out) == now != tables


def test_a_run_that_died_is_made_again(spark, tmp_path, monkeypatch):
    """Amounts go there and back while a run dies in between: the state of before is not trusted."""
    out = str(tmp_path / "out")
    fetch = lambda name, amount: land(tmp_path, name, [[account("m1", "LOAN", amount)]])
    daily.run_daily(spark, fetch("a", -1.0), out, AT, "1", 1)
    with monkeypatch.context() as m:
        m.setattr(graph.State, "close", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.run_daily(spark, fetch("b", -2.0), out, AT, "2", 2)
    daily.run_daily(spark, fetch("c", -1.0), out, AT, "3", 3)
    assert refreshed(spark, out, 3) == set(graph.GRAPH)
    assert [float(r.total_net_debt) for r in daily.model_frames(spark, out)["portfolio_daily"].collect()] == [-1.0]


def test_fingerprint(spark):
    from pyspark.sql import functions as F
    told = lambda rows: graph.fingerprint(spark.createDataFrame(rows, "a string, b int"), F.col("a"), F.col("b"))
    rows = [("x", 1), ("y", None), ("x", 1)]
    assert told(rows) == told(rows[::-1])
    assert len({told(rows), told(rows[:2]), told([("x", 1), ("y", None), ("x", 2)]), told([])}) == 4
