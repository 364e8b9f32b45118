"""Totals kept by changes against totals summed anew; tables bucketed alike."""
import datetime as dt
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators.changes import SIGN, upsert_changes
from ledgerline.operators.merge import merge_by_key
from ledgerline.plans import models
from ledgerline.session import scratch_path
from ledgerline.sources import cobucketed
from ledgerline.sources.maintained import Maintained
from ledgerline.sources.sinks import fresh_read, versions

FACT = ("account_id string, account_type string, is_credit_card boolean, current_balance decimal(18,3), "
        "available_balance decimal(18,3), credit_limit decimal(18,3), last_snapshot_at timestamp, _dlt_load_id string, snapshot_date date")
MONEY = st.one_of(st.none(), st.integers(-9999, 9999).map(lambda x: decimal.Decimal(x).scaleb(-2)))
ROW = st.tuples(st.sampled_from(["a", "b", "c", None]), st.sampled_from(["LOAN", "SAVINGS", None]), st.sampled_from([True, False, None]),
                MONEY, MONEY, MONEY, st.integers(0, 3).map(lambda h: dt.datetime(2024, 7, 1, h)), st.sampled_from(["1", "10", "2", "9"]),
                st.sampled_from([dt.date(2024, 7, 1), dt.date(2024, 7, 2), None]))
BATCH = st.lists(ROW, max_size=8, unique_by=lambda r: (r[0], r[8], r[7], r[6]))


def maintained(spark, **options):
    return Maintained(spark, scratch_path(spark, "kept"), models.DAILY_KEY, models.STORED_ORDER, "snapshot_date",
                      models.portfolio_delta, models.portfolio_add, **options)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def summed(spark, kept):
    return rows(models.portfolio_daily(fresh_read(spark, kept.fact)))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BATCH.filter(bool), min_size=1, max_size=3))
def test_random_upserts(spark, batches):
    kept, plain = maintained(spark, keep=2), None
    for b in [*batches, batches[0]]:
        batch = spark.createDataFrame(b, FACT)
        kept.upsert(batch)
        target = spark.createDataFrame([] if plain is None else plain, FACT)
        plain = [tuple(r) for r in merge_by_key(target, batch, models.DAILY_KEY, models.STORED_ORDER, order_proof=True).collect()]
    assert rows(fresh_read(spark, kept.fact).select(*spark.createDataFrame([], FACT).columns)) == sorted(plain, key=repr)
    assert rows(kept.totals().drop("n_rows")) == summed(spark, kept) == rows(models.portfolio_daily(spark.createDataFrame(plain, FACT)))


def fact(spark, *keyed):
    return spark.createDataFrame([(k, "LOAN", False, decimal.Decimal(v), None, None, dt.datetime(2024, 7, 1), load, dt.date(2024, 7, day))
                                  for k, v, load, day in keyed], FACT)


def test_changes(spark):
    target = fact(spark, ("a", 1, "1", 1), ("b", 2, "5", 1), ("c", 3, "1", 1), (None, 4, "1", 1))
    batch = fact(spark, ("a", 10, "2", 1), ("b", 20, "4", 1), ("c", 3, "1", 1), (None, 40, "2", 1), ("d", 50, "1", 1), ("d", 51, "2", 1))
    got = {(r.account_id, int(r.current_balance), r[SIGN]) for r in upsert_changes(target, batch, models.DAILY_KEY, models.STORED_ORDER).collect()}
    # b is older, c the same again; a NULL account is an account
    assert got == {("a", 10, 1), ("a", 1, -1), (None, 40, 1), (None, 4, -1), ("d", 51, 1)}
    assert upsert_changes(target, batch.limit(0), models.DAILY_KEY, models.STORED_ORDER).isEmpty()


def test_only_changes_are_summed(spark):
    """The totals of a batch are made from the log: a fact that is altered beside it is not looked at."""
    kept = maintained(spark)
    assert kept.totals() is None and not kept.recover()
    kept.upsert(fact(spark, ("a", 1, "1", 1), ("b", 2, "1", 1), ("a", 5, "1", 2)))
    kept.upsert(fact(spark, ("a", 7, "2", 1)))
    assert {(r.snapshot_date.day, int(r.total_net_debt), r.n_rows) for r in kept.totals().collect()} == {(1, 9, 2), (2, 5, 1)}
    assert fresh_read(spark, f"{kept.log}/version=000000000002").count() == 2


@pytest.mark.parametrize("dies_at", ["fact", "totals"])
def test_a_run_that_died_is_finished(spark, monkeypatch, dies_at):
    from ledgerline.sources import maintained as module
    kept = maintained(spark)
    kept.upsert(fact(spark, ("a", 1, "1", 1), ("b", 2, "1", 1)))
    real_upsert, real_write = module.upsert_partitions, module.write_version
    with monkeypatch.context() as m:
        if dies_at == "fact":
            m.setattr(module, "upsert_partitions", lambda *a, **k: 1 / 0)
        else:
            m.setattr(module, "write_version", lambda df, root, *a: 1 / 0 if root == kept.sums else real_write(df, root, *a))
        with pytest.raises(ZeroDivisionError):
            kept.upsert(fact(spark, ("a", 100, "2", 1)))
    assert module.upsert_partitions is real_upsert and versions(spark, kept.sums) == [1]
    # the same batch once more, as a retried job would: counted once
    kept.upsert(fact(spark, ("a", 100, "2", 1)))
    assert versions(spark, kept.sums) == [1, 2, 3]
    assert [int(r.total_net_debt) for r in kept.totals().collect()] == [102]
    assert rows(kept.totals().drop("n_rows")) == summed(spark, kept)


def test_co_bucketed_upsert(spark):
    place = lambda: ((p := scratch_path(spark, "cob")).rsplit("/", 1)[1].replace("-", "_"), p)
    schema, order = "k string, load string, v int", [("load", "desc")]
    old, new = [("a", "2", 1), ("b", "2", 2), ("c", None, 3), (None, "1", 4)], [("a", "1", 10), ("b", "3", 20), ("b", "2", 21), ("c", "0", 30), ("d", "1", 40), (None, "2", 50)]
    first, second = place(), place()
    cobucketed.write(spark.createDataFrame(old, schema), *first, "k", 4)
    got = cobucketed.upsert(spark, first[0], spark.createDataFrame(new, schema), *second, "k", order, 4)
    want = merge_by_key(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k"], order, order_proof=True)
    assert rows(got) == rows(want)
    assert rows(spark.table(first[0])) == sorted(old, key=repr)     # the old version stays as it was
    assert got.select(F.input_file_name()).distinct().count() <= 4 + 1       # one file a bucket, one for the NULL key
    # only the batch is shuffled: the stored side is read by its buckets
    plan = cobucketed.newer(spark.table(first[0]), spark.createDataFrame(new[:1], schema), "k", order)._jdf.queryExecution().executedPlan()
    assert "Bucketed: true" in plan.toString() and plan.toString().count("Exchange hashpartitioning") == 1
