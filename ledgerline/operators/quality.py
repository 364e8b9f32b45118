"""Data-quality checks: ``not_null`` and ``unique`` as DataFrames of failures.

``not_null`` scans a table once for all its checked columns (one partial
aggregate per task). ``unique`` counts keys seen more than once (NULL keys are
ignored); the group-by is partial before the shuffle, so a hot key costs one row
per map task. Results are frames, not exceptions, so a run can store them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

RESULT_COLUMNS = ["model", "column_name", "check_name", "failures"]


def not_null_checks(model: str, df: DataFrame, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("long").alias("failures")) for c in columns]))
    return counts.select(stacked.alias("r")).select(
        F.lit(model).alias("model"), "r.column_name", F.lit("not_null").alias("check_name"), "r.failures")


def unique_check(model: str, df: DataFrame, column: str) -> DataFrame:
    dup = (df.filter(F.col(f"`{column}`").isNotNull())
             .groupBy(f"`{column}`").count()
             .filter(F.col("count") > 1))
    return dup.agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(model).alias("model"), F.lit(column).alias("column_name"),
        F.lit("unique").alias("check_name"), "failures")


def model_checks(model: str, df: DataFrame, not_null: Iterable[str], unique: Iterable[str] = ()) -> DataFrame:
    """All checks of one model in one scan: every checked column gives (column, value) pairs,
    which are counted together. Values of columns that are only checked for NULL are not kept."""
    not_null, unique = list(not_null), list(unique)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").isNull().alias("missing"),
                 (F.col(f"`{c}`").cast("string") if c in unique else F.lit(None).cast("string")).alias("value"))
        for c in dict.fromkeys([*not_null, *unique])]))
    counts = df.select(pairs.alias("p")).groupBy("p.column_name", "p.missing", "p.value").count()
    sums = counts.agg(*[F.coalesce(F.sum(F.when((F.col("column_name") == c) & F.col("missing"), F.col("count"))), F.lit(0)).alias(f"n{i}")
                        for i, c in enumerate(not_null)],
                      *[F.count_if((F.col("column_name") == c) & ~F.col("missing") & (F.col("count") > 1)).alias(f"u{i}")
                        for i, c in enumerate(unique)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("check_name"), F.col(f"{at}{i}").alias("failures"))
                               for name, at, cols in (("not_null", "n", not_null), ("unique", "u", unique)) for i, c in enumerate(cols)]))
    return sums.select(rows.alias("r")).select(F.lit(model).alias("model"), "r.column_name", "r.check_name", "r.failures")


class Observed:
    """``not_null`` checks that are counted while a frame is written, without a scan of their own."""

    def __init__(self, model: str, columns: Iterable[str]):
        self.model, self.columns, self.metrics = model, list(columns), Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.metrics, *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in self.columns])

    def rows(self) -> list[tuple]:
        """One row per column, once the write has ended."""
        got = self.metrics.get
        return [(self.model, c, "not_null", int(got[c])) for c in self.columns]


def run_checks(not_null: Mapping[str, tuple[DataFrame, Iterable[str]]],
               unique: Mapping[str, tuple[DataFrame, Iterable[str]]]) -> DataFrame:
    """All checks as one frame: (model, column_name, check_name, failures)."""
    frames = [not_null_checks(m, df, cols) for m, (df, cols) in not_null.items()]
    frames += [unique_check(m, df, c) for m, (df, cols) in unique.items() for c in cols]
    return reduce(lambda a, b: a.unionByName(b), frames)
