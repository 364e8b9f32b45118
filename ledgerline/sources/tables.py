"""Named table access: driver parquet tables and the model-schema lookup.

Tables are read lazily; callers select only the columns they need so the
parquet scan's ``ReadSchema`` stays minimal and filters are pushed down.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: Columns of the tables that the adapters read. Declared, they need no look into the files
#: while a plan is built.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read one driver table (``{sf_dir}/{name}.parquet``), optionally projected."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df if columns is None else df.select(*columns)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog has a table or view of that name; a database that does not exist has none."""
    return spark.catalog.tableExists(name)


def resolve_table(spark: SparkSession, name: str, schemas: Iterable[str]) -> str:
    """First ``schema.name`` among the ordered candidate ``schemas`` that exists in the
    catalog, else the bare name (the current database).

    Catalog lookups only; no data is read. The caller caches the answer if it
    needs it repeatedly.
    """
    for schema in schemas:
        qualified = f"{schema}.{name}"
        if table_exists(spark, qualified):
            return qualified
    return name
