"""Keyed upsert of an incoming batch into a target table.

``merge_by_key`` is a single shuffle: target and incoming rows are unioned with a
priority flag and reduced to one row per key, incoming first, then by the caller's
order inside each side. This equals "anti-join the target on the incoming keys,
then append the deduplicated incoming rows", without a second exchange for the
anti-join and without reading the incoming keys twice.

``order_proof=True`` compares the versions themselves (e.g. load ids) instead of
the batch they came in, so batches that arrive out of order still converge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.latest import OrderTerm, latest_per_key

_SIDE = "__incoming"


def merge_by_key(target: DataFrame, incoming: DataFrame, keys: Sequence[str],
                 order: Sequence[OrderTerm] = (), order_proof: bool = False,
                 strategy: str = "window") -> DataFrame:
    cols = list(dict.fromkeys(target.columns + incoming.columns))
    both = (target.withColumn(_SIDE, F.lit(0))
                  .unionByName(incoming.withColumn(_SIDE, F.lit(1)), allowMissingColumns=True))
    terms = list(order) + [(_SIDE, "desc")] if order_proof else [(_SIDE, "desc")] + list(order)
    return latest_per_key(both, keys, terms, strategy=strategy).select(*[F.col(f"`{c}`") for c in cols])


def dedupe_batch(batch: DataFrame, keys: Sequence[str], order: Sequence[OrderTerm],
                 strategy: str = "window") -> DataFrame:
    """One row per key inside a single batch (the latest by ``order``)."""
    return latest_per_key(batch, keys, order, strategy=strategy)
