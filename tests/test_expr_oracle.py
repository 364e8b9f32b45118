"""Property tests: the column expressions against DuckDB's casts on generated text."""
from decimal import Decimal

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.functions import exprs

NUM_TEXT = st.builds(
    lambda sign, whole, frac, pad: f"{pad}{sign}{whole}{('.' + frac) if frac else ''}{pad}",
    st.sampled_from(["", "-"]),
    st.integers(min_value=0, max_value=99999999),
    st.one_of(st.just(""), st.text("0123456789", min_size=1, max_size=7)),
    st.sampled_from(["", " "]),
) | st.just("")
TYPE_TEXT = st.text(st.sampled_from(list("LOANloanCREDITcreditCARDcard SAVINGS-_x")), max_size=14)

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def duck(sql, values):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, v VARCHAR)")
    if values:
        con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    return [r[0] for r in con.execute(f"SELECT {sql} FROM t ORDER BY i").fetchall()]


def spark_values(spark, col, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", col.alias("x")).orderBy("i").collect()]


@SETTINGS
@given(st.lists(NUM_TEXT, min_size=1, max_size=60))
def test_numeric_cast_matches(spark, values):
    assert spark_values(spark, exprs.to_numeric("v"), values) == duck("nullif(v, '')::numeric", values)


@SETTINGS
@given(st.lists(NUM_TEXT, min_size=1, max_size=60))
def test_text_to_int_matches(spark, values):
    values = [v for v in values if v.strip() == v]            # DuckDB's ::int keeps no padding rule we rely on
    values = [v for v in values if v == "" or abs(Decimal(v)) < 2 ** 31 - 1]
    assert spark_values(spark, exprs.text_to_int("v"), values) == duck("nullif(v, '')::int", values)


@SETTINGS
@given(st.lists(st.one_of(st.none(), TYPE_TEXT), min_size=1, max_size=60))
def test_type_predicates_match(spark, values):
    got = spark_values(spark, exprs.normalise_type("v"), values)
    assert got == duck("upper(trim(coalesce(v, '')))", values)
    flag = spark_values(spark, exprs.credit_flag("v"), values)
    assert flag == duck("lower(coalesce(v,'')) LIKE '%credit%' OR lower(coalesce(v,'')) LIKE '%card%'", values)
