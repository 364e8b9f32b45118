"""The model graph of the daily run as data, and what each model was last made from.

``GRAPH`` names each model's inputs, with the columns that it reads of them. A run goes through it
in order and refreshes a model only when the fingerprint of its inputs is another one than when it
was last made, so a fetch that is sent again writes no table, and one that alters only what the
totals do not read leaves the totals.

Fingerprints: a fetch and a fact are told by their rows (number, and sums of two 64-bit hashes per
row, whatever their order; a fact's are counted while it is written), stored raw tables by the names
of their files, which every write makes anew. A merge compares versions, so a fetch that was once
merged need not be again, whatever came after it.

State is one small partition per snapshot date. It is marked open before anything is altered and
written in full when the run has ended; a run that finds it open trusts none of it.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.sinks import children, fresh_read, overwrite_partitions

#: Model -> the inputs it is made from -> the columns it reads of them (None: all).
GRAPH: dict[str, dict[str, tuple[str, ...] | None]] = {
    "raw_accounts": {"fetch": None},
    "raw_balances": {"fetch": None},
    "daily_balances": {"raw_balances": None},
    "portfolio_daily": {"daily_balances": ("snapshot_date", "account_type", "is_credit_card", "current_balance",
                                           "available_balance", "credit_limit")},
    "account_checks": {"raw_accounts": None},
}
#: Models whose refresh is a merge by version: once merged, an input is merged for good.
MERGED = ("raw_accounts", "raw_balances")
STATE = "model string, inputs string, result string, snapshot_date date"


def in_order() -> list[str]:
    """The models, each after those that it is made from."""
    return [m for m in TopologicalSorter({m: set(i) for m, i in GRAPH.items()}).static_order() if m in GRAPH]


def _digest(columns: Iterable[Column]) -> list[Column]:
    columns = list(columns)
    exact = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("n"), exact(1).alias("a"), exact(2).alias("b")]


def _told(row: dict) -> str:
    return f"{row['n']}:{row['a']}:{row['b']}"


def fingerprint(df: DataFrame, *columns: Column) -> str:
    """What tells the rows of ``df``, in any order. One scan."""
    return _told(df.agg(*_digest(columns)).first().asDict())


def of_files(names: Iterable[str]) -> str:
    return json.dumps(sorted(n for n in names if not n.startswith(("_", "."))))


class Told:
    """The fingerprint of some columns, taken while a frame is written."""

    def __init__(self, columns: Iterable[str]):
        self.columns, self.metrics = list(columns), Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.metrics, *_digest(F.col(f"`{c}`") for c in self.columns))

    def text(self) -> str:
        return _told(self.metrics.get)


class State:
    """What the models of one snapshot date were made from, and what the refresh told
    (``result``: fingerprint for its readers, check results)."""

    def __init__(self, spark: SparkSession, root: str, date: dt.date):
        self.spark, self.root, self.date, self.open = spark, root, date, False
        here = f"snapshot_date={date.isoformat()}" in children(spark, root)
        stored = fresh_read(spark, root).filter(F.col("snapshot_date") == F.lit(date)).collect() if here else []   # a row per model and fetch of a day
        self.rows = {} if any(r.model == "open" for r in stored) else {(r.model, r.inputs): r.result for r in stored}

    def _write(self, rows: list[tuple]) -> None:
        df = self.spark.createDataFrame([(*r, self.date) for r in rows], STATE)
        overwrite_partitions(df, self.root, "snapshot_date")

    def refresh(self, model: str, inputs: str, build: Callable[[], dict], there: bool = True) -> tuple[dict, bool]:
        """``build`` unless the model was made from these inputs already (and is still ``there``);
        tells what the refresh of these inputs told, and whether it ran now."""
        if there and (model, inputs) in self.rows:
            return json.loads(self.rows[model, inputs]), False
        if not self.open:
            self._write([("open", "", "")])
            self.open = True
        result = build()
        if model not in MERGED:
            self.rows = {k: v for k, v in self.rows.items() if k[0] != model}
        self.rows[model, inputs] = json.dumps(result)
        return result, True

    def close(self) -> None:
        if self.open:
            self._write([(m, i, r) for (m, i), r in self.rows.items()])
            self.open = False
