"""Queries that SQL can express, against DuckDB; the others, against brute force."""
import duckdb
import pytest
from brute import near_groups
from conftest import SF_SMALL

from ledgerline.llm.oracle import ORACLE
from ledgerline.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _rows(map(tuple, df.collect()), df.columns) == _rows(cur.fetchall(), cols)


def test_simhash_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, SF_SMALL).collect())) == sorted(near_groups(rows))


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
