"""Line dedup: drop lines that many documents repeat, but for one copy.

Lines are exploded and normalised, their 16-byte hashes are counted over distinct documents
(with partial counts, so a line that a third of all documents hold is combined before any
shuffle), and lines over the threshold go from all documents but the one with the largest
id. Hashes travel, texts do not, until documents are put together again by line position.

Python does the per-document line work over Arrow batches; Spark does the counting and joins.

Defined results: a null or empty text is one empty line; a row is told from others by its
``doc_id`` and text, so rows that repeat both count as one document and come out alike; a
null ``doc_id`` is an id of its own, smaller than any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, cut, join_same, texts

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: str) -> str:
    """The line without spaces at its ends, A-Z lower-cased."""
    return line.strip(SPACES).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _hashes(text: str, min_chars: int) -> list[bytes | None]:
    """A hash for each line that may be dropped, None for the others."""
    out: list[bytes | None] = []
    for line in text.split("\n"):
        key = line.strip(SPACES)
        out.append(hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()
                   if len(key) >= min_chars else None)
    return out


def common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id``, ``fp``, ``hash``: the common lines that each document loses."""

    def long_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                own = {x for x in _hashes(text, min_chars) if x is not None}
                at.extend([i] * len(own))
                found.extend(own)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("fp").take(rows),
                                              pa.array(found, pa.binary())], ["doc_id", "fp", "hash"])

    held = cut(docs.mapInArrow(long_lines, "doc_id long, fp long, hash binary"))
    counts = held.groupBy("hash").agg(F.countDistinct(F.struct("doc_id", "fp")).alias("n"), F.max("doc_id").alias("keep_id"))
    # written, so that both sides of the join are plain shuffles, of which Spark splits hot keys
    counts = cut(counts.filter(F.col("n") >= min_docs).select("hash", "keep_id"))
    return (held.join(counts, "hash").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
                .select("doc_id", "fp", "hash"))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_lines``, ``n_dropped``, ``text`` without the
    common lines."""
    d = texts(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    lost = (common_lines(d, min_chars, min_docs)
            .groupBy("doc_id", "fp").agg(F.collect_set("hash").alias("lost")))  # a document's own lines
    joined = join_same(d, lost, "doc_id", "fp", how="left").select("doc_id", "text", "lost")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, kept = [], [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("lost").to_pylist(), strict=True):
                lines = text.split("\n")
                n.append(len(lines))
                if gone:
                    drop = set(gone)
                    lines = [x for x, h in zip(lines, _hashes(text, min_chars), strict=True) if h not in drop]
                    text = "\n".join(lines)
                m.append(n[-1] - len(lines))
                kept.append(text)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    return joined.mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, text string")
