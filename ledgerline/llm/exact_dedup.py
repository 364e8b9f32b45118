"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (Spark's ``approx_top_k``, a frequent-items sketch of that family
that merges across tasks) names the digests that may be frequent. Their groups are counted
exactly, and the verified winners, at most ``HEAVY`` rows, are broadcast: copies of frequent
texts are settled on the map side and never shuffled. All other digests go through an
ordinary shuffle. The summary keeps every digest that makes up more than 1 in ``TRACKED``
of the rows, so no group left for the shuffle is larger than that.

Only DataFrame functions are used. Texts never shuffle to find groups: 32-byte digests do.

Defined results: a null text counts as empty; a null ``doc_id`` is smaller than any other;
of rows that repeat both text and ``doc_id`` one stays; an empty table gives no rows; other
columns pass through ``drop_copies`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, keep_one, texts

#: Frequent digests that are settled by broadcast, and items that the summary tracks.
HEAVY, TRACKED = 4096, 16384


def digest(text) -> F.Column:
    """SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _tagged(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest``, the digest's first 8 bytes and a row number, written once: the
    row number is fixed from then on."""
    d = texts(docs).select("doc_id", digest(F.col("text")).alias("digest"))
    return cut(d.select("doc_id", "digest", F.xxhash64("digest").alias("short"),
                        F.monotonically_increasing_id().alias("row")))


def frequent(tagged: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Verified frequent groups: ``digest``, ``winner`` (doc_id and row that stay), ``size``.
    At most ``heavy`` rows."""
    found = (tagged.agg(F.expr(f"approx_top_k(short, {heavy}, {tracked})").alias("top"))
                   .select(F.explode("top.item").alias("short")))
    return (tagged.join(F.broadcast(found), "short")
                  .groupBy("digest")
                  .agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("size"))
                  .filter("size > 1"))


def groups(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: ``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept``,
    ``is_heavy``."""
    tagged = _tagged(docs)
    winners = cut(frequent(tagged, heavy, tracked))
    split = tagged.join(F.broadcast(winners), "digest", "left")
    rest = split.filter("size IS NULL").drop("winner", "size")
    # written, so that the join is one of plain shuffles, of which Spark splits large groups
    of_rest = cut(rest.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("size")))
    rest = rest.join(of_rest, "digest")
    cols = ["doc_id", "digest", F.col("winner.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
            (F.col("winner.row") == F.col("row")).alias("kept")]
    return (split.filter("size IS NOT NULL").select(*cols, F.lit(True).alias("is_heavy"))
                 .unionByName(rest.select(*cols, F.lit(False).alias("is_heavy"))))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id."""
    found = cut(groups(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                       heavy, tracked).filter("group_size > 1"))
    rows = docs.withColumn("__digest", digest(F.col(f"`{text_col}`"))).withColumn("__id", F.col(f"`{id_col}`"))
    # frequent groups: all but the winner's rows go on the map side
    winners = (found.filter("is_heavy AND kept")
                    .select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.lit(True).alias("__w")))
    rows = (rows.join(F.broadcast(winners), "__digest", "left")
                .filter(F.col("__w").isNull() | F.col("__id").eqNullSafe(F.col("__keep"))).drop("__w", "__keep"))
    named = lambda d: d.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    lost = named(found.filter(~F.col("is_heavy") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))).distinct()
    again = named(found.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id")))).distinct()
    rows = keep_one(rows, lost, again, "__id", "__digest")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
