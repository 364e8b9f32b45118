"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits are cut into segments. If two of them differ in at most ``r`` bits,
then in one of ``m`` segments they differ in at most ``r // m``: each fingerprint enumerates
the small Hamming ball around its segments, fetches what the segment's table holds there, and
the whole distance is verified in the join. With 2 segments of 32 bits and r = 3 a ball has
33 members, of which a fingerprint looks up about half: of two values that differ, only the
one with a 0 in the highest differing bit asks for the other.

Copies collapse into one fingerprint before that, so a group of copies costs one row.
Linked fingerprints are joined into components by star rounds (``components``).

Defined results: a null or empty text has fingerprint zero and links like any other; a text
of fewer words than a shingle is one shingle; a null ``doc_id`` is larger than any other; an
empty table gives no rows; of rows that repeat doc_id and text ``drop_near_copies`` keeps
one; other columns pass through untouched.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, keep_one, texts
from ledgerline.llm.components import components

SHINGLE, BITS, SEGMENTS, HASH_SEED = 3, 3, 2, 42
#: A fingerprint of more than 1 in ``HOT`` rows is joined by broadcast; there are fewer than ``HOT``.
HOT = 1024
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII only, as bytes
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = np.array([xxhash.xxh64_intdigest(joined[s:e], HASH_SEED)
                  for s, e in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist(), strict=True)], np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text), ``fp`` (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "tie", "fp"])

    return (texts(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
            .mapInArrow(run, "doc_id long, tie long, fp long"))


def links(fps: DataFrame, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``a``, ``b``: all pairs of different fingerprints (column ``fp``, distinct) that differ
    in at most ``bits`` bits."""
    width, ball = 64 // segments, bits // segments
    cut_at = [k * width for k in range(segments)]
    size = [width] * (segments - 1) + [64 - width * (segments - 1)]
    segment = lambda col, k: F.shiftrightunsigned(col, cut_at[k]).bitwiseAND(F.lit((1 << size[k]) - 1).cast("long"))
    table = fps.select("fp", F.posexplode(F.array(*[segment(F.col("fp"), k) for k in range(segments)])).alias("seg", "key"))
    masks = [sorted(sum(1 << b for b in c) for n in range(ball + 1) for c in itertools.combinations(range(s), n))
             for s in size]
    # (mask, its highest bit) of each segment's ball
    per_seg = F.array(*[F.array(*[F.struct(F.lit(m).cast("long").alias("mask"),
                                           F.lit(1 << m.bit_length() >> 1).cast("long").alias("top")) for m in ms])
                        for ms in masks])
    asked = (table.select("fp", "seg", "key", F.explode(F.get(per_seg, F.col("seg"))).alias("m"))
                  .filter(F.col("key").bitwiseAND(F.col("m.top")) == 0)
                  .select(F.col("fp").alias("a"), "seg", F.col("key").bitwiseXOR(F.col("m.mask")).alias("key"),
                          (F.col("m.mask") == 0).alias("alike")))
    t = table.select(F.col("fp").alias("b"), "seg", "key")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    match = ((F.bit_count(differ) <= bits) & (~F.col("alike") | (F.col("a") < F.col("b")))
             & (asked["seg"] == t["seg"]) & (asked["key"] == t["key"]))
    for k in range(segments - 1):  # what an earlier segment finds, a later one need not find again
        match = match & ((asked["seg"] <= k) | (F.bit_count(segment(differ, k)) > ball))
    return asked.join(t, match).select("a", "b")


def groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``tie``, ``fp``, ``first`` (missing, id and tie
    of the smallest document that is reachable)."""
    own = cut(fingerprints(docs, shingle))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie")
    distinct = cut(own.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    comp = cut(components(links(distinct.select("fp"), bits, segments)))
    first = (comp.join(distinct, comp["node"] == distinct["fp"]).groupBy("label").agg(F.min("first").alias("first")))
    linked = comp.join(first, "label").select(F.col("node").alias("fp"), "first")
    final = cut(distinct.join(linked.withColumnRenamed("first", "of_all"), "fp", "left")
                        .select("fp", "n", F.coalesce("of_all", "first").alias("first")))
    rows = distinct.agg(F.sum("n")).first()[0] or 0
    # copies of one text may be a third of all rows: they get their group on the map side
    hot = final.filter(F.col("n") > rows / HOT).select("fp", F.col("first").alias("of_hot"))
    split = own.join(F.broadcast(hot), "fp", "left")
    rest = split.filter("of_hot IS NULL").drop("of_hot").join(final.filter(F.col("n") <= rows / HOT), "fp")
    return (split.filter("of_hot IS NOT NULL").select("doc_id", "tie", "fp", F.col("of_hot").alias("first"))
                 .unionByName(rest.select("doc_id", "tie", "fp", "first")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, bits: int = BITS, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id."""
    found = cut(groups(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                       shingle, bits, segments))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    named = found.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), stays.alias("stays"))
    lost = named.filter("NOT stays").select("__id", "__tie").distinct()
    again = named.filter("stays").groupBy("__id", "__tie").count().filter("count > 1").select("__id", "__tie")
    rows = (docs.withColumn("__id", F.col(f"`{id_col}`"))
                .withColumn("__tie", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    return keep_one(rows, lost, again, "__id", "__tie").select(*[F.col(f"`{c}`") for c in docs.columns])
