"""A date-partitioned fact with totals that are kept up to date by changes, not summed anew.

An upsert is three writes, in this order::

    changes/version=<n>/            rows that leave and rows that come in (``operators.changes``)
    fact/<date column>=.../         the touched partitions, merged
    totals/version=<n>/             totals of version n - 1 and what the changes add up to

The changes are written before anything is altered and say all that is to be done. A run that
dies later on is finished by the next one from them (``recover``): merging them again leaves the
fact as it is, and totals of version n are always made from those of version n - 1, so no change
is counted twice or lost. One writer at a time.

Totals must add up: ``delta`` gives the signed sums of changes, ``add`` puts them to the totals.
There is one row of totals per group (a day), so writing them as a whole stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.changes import SIGN, upsert_changes
from ledgerline.operators.latest import OrderTerm
from ledgerline.sources.sinks import children, latest_version, read_version, touched_target, upsert_partitions, versions, write_version


class Maintained:
    """A fact under ``root`` and its totals. ``keep``: versions of changes and totals that stay (default: all)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[OrderTerm], partition_col: str,
                 delta: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame, DataFrame], DataFrame], keep: int | None = None):
        if keep is not None and keep < 2:
            raise ValueError("a version is made from the one before it: keep at least two")
        self.spark, self.keys, self.order, self.partition_col = spark, list(keys), list(order), partition_col
        self.delta, self.add, self.keep = delta, add, keep
        self.fact, self.log, self.sums = (f"{root.rstrip('/')}/{x}" for x in ("fact", "changes", "totals"))

    def totals(self) -> DataFrame | None:
        """The totals of all upserts that have ended, None before the first."""
        return latest_version(self.spark, self.sums)

    def recover(self) -> bool:
        """Finish an upsert whose changes are written and whose totals are not; tells if there was one."""
        logged, done = versions(self.spark, self.log), versions(self.spark, self.sums)
        if not logged or (done and done[-1] >= logged[-1]):
            return False
        self._finish(logged[-1])
        return True

    def upsert(self, incoming: DataFrame) -> int:
        """Merge a batch; returns its version."""
        self.recover()
        there = any(c.startswith(f"{self.partition_col}=") for c in children(self.spark, self.fact))
        target = touched_target(self.spark, self.fact, incoming, self.partition_col) if there else None
        version = max(versions(self.spark, self.log), default=0) + 1
        write_version(upsert_changes(target, incoming, self.keys, self.order), self.log, version, self.keep)
        self._finish(version)
        return version

    def _finish(self, version: int) -> None:
        changes = read_version(self.spark, self.log, version)
        new = changes.filter(F.col(SIGN) > 0).drop(SIGN)
        if not new.isEmpty():
            upsert_partitions(self.spark, new, self.fact, self.keys, self.order, self.partition_col, order_proof=True)
        before, delta = latest_version(self.spark, self.sums, before=version), self.delta(changes)
        write_version(delta if before is None else self.add(before, delta), self.sums, version, self.keep)
