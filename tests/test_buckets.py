"""Keyed tables in hash buckets, primary keys on insert, checks observed while writing."""
import random

import pytest
from pyspark.errors import PySparkException

from ledgerline.operators import quality
from ledgerline.operators.merge import merge_by_key
from ledgerline.plans import daily
from ledgerline.schemas import RAW_ACCOUNTS
from ledgerline.sources import buckets, sinks

SCHEMA = "k string, v int, load string"
KEYS, ORDER = ["k"], [("load", "desc"), ("v", "desc")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path):
    return sorted(tuple(r) for r in buckets.read(spark, path, KEYS, ORDER).collect())


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.merge(frame(spark, [(f"k{i}", 1, "1") for i in range(200)]), path, KEYS, ORDER, buckets=8)
    before = buckets.files(spark, path)
    assert len(before) == 8
    assert buckets.merge(frame(spark, [("k5", 2, "2")]), path, KEYS, ORDER, buckets=8) == []
    after = buckets.files(spark, path)
    changed = [b for b in after if after[b] != before[b]]
    assert len(changed) == 1 and set(before[changed[0]]) < set(after[changed[0]])
    assert ("k5", 2, "2") in stored(spark, path) and len(stored(spark, path)) == 200


def test_only_full_buckets_are_compacted(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.merge(frame(spark, [(f"k{i}", 0, "0") for i in range(50)]), path, KEYS, ORDER, buckets=4)
    for n in range(1, 4):
        done = buckets.merge(frame(spark, [("k1", n, str(n))]), path, KEYS, ORDER, buckets=4, most_files=3)
    assert len(done) == 1
    sizes = {b: len(f) for b, f in buckets.files(spark, path).items()}
    assert sizes[done[0]] == 1 and ("k1", 3, "3") in stored(spark, path) and len(stored(spark, path)) == 50
    assert sinks.fresh_read(spark, path).filter(f"_bucket = {done[0]}").filter("k = 'k1'").count() == 1


def test_merges_equal_the_keyed_merge(spark, tmp_path):
    rng, path = random.Random(4), f"{tmp_path}/t"
    batches = [[(f"k{rng.randint(0, 9)}" if rng.random() > 0.1 else None, rng.randint(0, 99), str(rng.randint(0, 5))) for _ in range(12)]
               for _ in range(4)]
    want = frame(spark, [])
    for b in [*batches, batches[0]]:   # the first once more
        buckets.merge(frame(spark, b), path, KEYS, ORDER, buckets=3, most_files=2)
        want = merge_by_key(want, frame(spark, b), KEYS, ORDER, order_proof=True)
    assert sorted(map(repr, buckets.read(spark, path, KEYS, ORDER).collect())) == sorted(map(repr, want.collect()))


def test_a_primary_key_stops_a_write(spark, tmp_path):
    path, schema = f"{tmp_path}/t", RAW_ACCOUNTS
    row = lambda i: (i, *["x"] * 14, 1.0, "1")
    insert = lambda ids: buckets.insert(spark, spark.createDataFrame([row(i) for i in ids], schema), path, schema, ["_id"])
    insert(["a", "b", "c"])
    for bad in (["d", "d"], ["e", "a"], [None, "f"]):
        with pytest.raises(PySparkException, match="primary key"):
            insert(bad)
    insert(["d", "e"])
    assert sorted(r._id for r in sinks.fresh_read(spark, path).collect()) == ["a", "b", "c", "d", "e"]
    with pytest.raises(ValueError, match="declared"):
        buckets.insert(spark, spark.createDataFrame([("z",)], "_id string"), path, schema, ["_id"])


def test_model_checks_equal_the_single_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("b", 2), ("c", 2), ("c", 3)], "k string, v int")
    got = {(r.column_name, r.check_name): r.failures for r in quality.model_checks("t", df, ["k", "v"], ["k", "v"]).collect()}
    want = quality.run_checks({"t": (df, ["k", "v"])}, {"t": (df, ["k", "v"])})
    assert got == {(r.column_name, r.check_name): r.failures for r in want.collect()}
    empty = quality.model_checks("t", df.filter("false"), ["k"], ["k"]).collect()
    assert [r.failures for r in empty] == [0, 0]


def test_checks_are_counted_while_writing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, None)], "k string, v int")
    seen = quality.Observed("t", ["k", "v"])
    seen.watch(df).write.parquet(f"{tmp_path}/t")
    assert seen.rows() == [("t", "k", "not_null", 2), ("t", "v", "not_null", 1)]


def test_all_fetches_are_kept_unless_told(spark, tmp_path):
    from test_daily_run import account, land
    out = str(tmp_path / "out")
    for n in range(1, 4):
        fetch = land(tmp_path, f"f{n}", [[account("a", "LOAN", -1.0 * n)]])
        daily.run_daily(spark, fetch, out, f"2024-07-0{n}T01:00:00Z", str(n), n, keep=None if n < 3 else 1)
        assert sinks.versions(spark, f"{out}/landed") == ([*range(1, n + 1)] if n < 3 else [3])
    assert {r.failures for r in daily.run_checks(spark, out).collect()} == {0}
    assert sinks.read_version(spark, f"{out}/quality", 3).count() == 9
