"""What an upsert changes: rows that it takes out of a keyed table and rows that it puts in.

Sums, counts and whatever else adds up over a table can be kept by these alone: take the old
row of each changed key away, add the new one. The table's other rows are not read again.

Only the target's rows of the incoming keys take part: a semi-join cuts the target down first
(a small batch is broadcast by its measured size, so the target is not shuffled), and what is
left is at most two rows per key, of which one window gives both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.latest import OrderTerm
from ledgerline.operators.merge import dedupe_batch

#: +1 for a row that comes into the table, -1 for one that leaves it.
SIGN = "_change"
_SIDE = "__incoming"


def upsert_changes(target: DataFrame | None, incoming: DataFrame, keys: Sequence[str],
                   order: Sequence[OrderTerm]) -> DataFrame:
    """The changes that an order-proof upsert of ``incoming`` makes: its columns and ``SIGN``.

    ``target`` has one row per key (None: the table is not there yet). Of a key's rows the
    greatest by ``order`` stays, an incoming one on a tie, as in ``merge_by_key``. A NULL key is a
    key like any other. A key whose row comes again unchanged, or in an older version, gives no
    rows, so a batch that is sent twice changes nothing.
    """
    new = dedupe_batch(incoming, keys, order)
    if target is None:
        return new.withColumn(SIGN, F.lit(1))
    key = [F.col(f"`{k}`") for k in keys]
    sent = incoming.select(*[c.alias(f"__sent_{i}") for i, c in enumerate(key)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & c.eqNullSafe(F.col(f"__sent_{i}"))
    old = target.select(*[F.col(f"`{c}`") for c in incoming.columns]).join(sent, same, "left_semi")
    both = old.withColumn(_SIDE, F.lit(0)).unionByName(new.withColumn(_SIDE, F.lit(1)))
    row = F.struct(*[F.col(f"`{c}`") for c in incoming.columns])
    w = Window.partitionBy(*key).orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c, _ in order], F.col(_SIDE).desc())
    pairs = (both.select("*", F.row_number().over(w).alias("__turn"), F.lead(row).over(w).alias("__old"))
                 .filter((F.col("__turn") == 1) & (F.col(_SIDE) == 1) & ~row.eqNullSafe(F.col("__old"))))
    signed = lambda sign, r: F.struct(F.lit(sign).alias("sign"), r.alias("row"))
    out = pairs.select(F.explode(F.array(signed(1, row), signed(-1, F.col("__old")))).alias("c")).filter("c.row IS NOT NULL")
    return out.select("c.row.*", F.col("c.sign").alias(SIGN))
