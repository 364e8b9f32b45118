"""Substring dedup by prefix-partitioned suffix trees.

A suffix (the text from one word on) can only share its first ``window`` words with another
one if both share every anchor in there: the least hash among the ``GRAM``-word pieces of
the window, the same for equal windows wherever they stand. Anchors that occur once are
gone after one count, and with them all suffixes whose windows they stand for: of a corpus of
mostly new text, most.

The remaining suffixes are split by prefix. The first cut is the anchor's words, which
stretches of neighbouring suffixes have in common, so a stretch travels once, and not at all
if all stretches of its part are one text (told by their labels): such a part is a single path
of the tree, and all its suffixes repeat. A part that would not fit in a task (more than
``PART`` stretches) is cut by longer prefixes, up to the whole window, where equal prefixes
are only counted. In every other part the suffixes are grouped by prefix doubling (names of
their first 1, 2, 4, ... words: the suffix tree's nodes of that depth); nodes of ``window``
words with two or more suffixes below are the repeats, and all words below them go.

Texts travel twice, compressed and keyed by document, never by anchor; a document's own
lists are all that is gathered. Joins on anchors have hot keys that Spark splits, counts are
combined before they are shuffled.

Defined results: a null or empty text has no words; a text of fewer words than the window
keeps all; rows that repeat a whole text repeat each other's windows; rows that repeat
doc_id and text as well come out alike; an empty table gives no rows; kept words are joined
by one space, and other columns are not returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, texts

WINDOW, GRAM = 35, 6
#: Stretches of a part that a task takes whole: about 1.5 million words, 150 MB with their names.
PART = 32_000


def window_anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's position (the leftmost of the least hashes), and the
    hashes of all pieces of ``gram`` words."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    h = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + own[j:n - gram + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the least of the w pieces from each place on, by ranges of doubled length
    w, at, least, reach = window - gram + 1, np.arange(len(h)), h, 1
    while reach < w:
        step = min(reach, w - reach)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    return at, h


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal values."""
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    return edge[:-1], edge[1:]


_P = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def stretch_labels(words: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit label of each stretch of words: equal words give equal labels wherever they stand."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * _powers(len(words), _P)[:-1])))
    label = (sums[end] - sums[start]) * _powers(len(words), pow(_P, -1, 1 << 64))[start]
    return label + (end - start).astype(np.uint64)


KEYS = ["doc_id", "missing", "fp"]


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``KEYS`` (never null) and ``text``."""
    d = texts(docs, id_col, text_col)
    return d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"),
                    F.col("doc_id").isNull().alias("missing"), F.xxhash64("text").alias("fp"), "text")


def anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``KEYS`` and of each run of windows that have one anchor its ``first`` and ``last`` window, the
    anchor's ``key`` and the ``label`` of the words under it, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for text in b.column("text"):
                words = text.as_buffer().to_pybytes().split()
                at, h = window_anchors(words, window, gram)
                lo, hi = _runs(at) if len(at) else (at, at)
                label = stretch_labels(words, lo, hi + window - 1) if len(at) else h
                for x, v in zip(out, (lo.astype(np.int32), (hi - 1).astype(np.int32), h[at[lo]].view(np.int64), label.view(np.int64)), strict=True):
                    x.append(v)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in KEYS], *[pa.array(x, pa.list_(t)) for x, t in zip(out, kinds, strict=True)]],
                                             [*KEYS, "first", "last", "key", "label"])

    kept = "doc_id long, missing boolean, fp long, first array<int>, last array<int>, key array<long>, label array<long>"
    return docs.mapInArrow(run, kept).filter("size(first) > 0")


def packed(docs: DataFrame) -> DataFrame:
    """``KEYS`` and the text, compressed for its way through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for b in batches:
            data = [pack.compress(x.as_buffer().to_pybytes()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in KEYS], pa.array(data, pa.binary())], [*KEYS, "packed"])

    return docs.mapInArrow(run, "doc_id long, missing boolean, fp long, packed binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text of a batch."""
    unpack = zstandard.ZstdDecompressor()
    for x in batch.column("packed"):
        yield unpack.decompress(x.as_buffer().to_pybytes()).split()


def _rows_of(batch: pa.RecordBatch, at: list[int]) -> list[pa.Array]:
    rows = pa.array(at, pa.int32())
    return [batch.column(c).take(rows) for c in KEYS]


def stretches(joined: DataFrame, window: int) -> DataFrame:
    """The words under each run of windows whose part branches: ``part`` (the prefix that
    partitions), ``KEYS``, ``first``, ``words``. Parts too large for a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, part, under = [], [], [], []
            for i, (words, runs) in enumerate(zip(_unpacked(b), b.column("runs").to_pylist(), strict=True)):
                for r in runs:
                    if not r["large"]:
                        row.append(i)
                        first.append(r["first"])
                        part.append(r["key"])
                        under.append(b" ".join(words[r["first"]:r["last"] + window]))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *_rows_of(b, row), pa.array(first, pa.int32()),
                                              pa.array(under, pa.binary())], ["part", *KEYS, "first", "words"])

    return joined.mapInArrow(run, "part long, doc_id long, missing boolean, fp long, first int, words binary")


def suffixes(joined: DataFrame, window: int) -> DataFrame:
    """The single suffixes of parts too large for a task: ``KEYS``, ``first`` and, for the prefix that
    partitions, now the whole window, its 16-byte ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, first, label = [], [], []
            for i, (words, runs) in enumerate(zip(_unpacked(b), b.column("runs").to_pylist(), strict=True)):
                for r in runs:
                    if r["large"]:
                        for k in range(r["first"], r["last"] + 1):
                            row.append(i)
                            first.append(k)
                            label.append(hashlib.blake2b(b" ".join(words[k:k + window]), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*_rows_of(b, row), pa.array(first, pa.int32()), pa.array(label, pa.binary())],
                                             [*KEYS, "first", "label"])

    return joined.mapInArrow(run, "doc_id long, missing boolean, fp long, first int, label binary")


def repeated_suffixes(parts: np.ndarray, stretch_words: list[bytes], window: int) -> list[np.ndarray]:
    """For each stretch, the offsets of those of its suffixes that share a node of ``window``
    words with another suffix of the same part.

    All suffixes are named by their first word, then by the first 2, 4, ... words (prefix
    doubling): one name at a depth is one node of the suffix tree at that depth.
    """
    split = [w.split() for w in stretch_words]
    sizes = np.array([len(w) for w in split])
    ids: dict[bytes, int] = {}
    name = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    del ids
    starts = np.cumsum(sizes) - sizes
    depth = 1
    while depth < window:
        step = min(depth, window - depth)  # the last step overlaps: 32 words and 32 words from 3 on make 35
        pair = name[:len(name) - step] * (int(name.max()) + 1) + name[step:]
        name = pd.factorize(pair)[0]
        depth += step
    # only suffixes with a whole window in their own stretch
    place = np.concatenate([np.arange(s, s + n - window + 1) for s, n in zip(starts, sizes, strict=True)])
    owner = np.repeat(np.arange(len(sizes)), sizes - window + 1)
    node = pd.factorize(parts[owner] * (int(name.max()) + 1) + name[place])[0]
    several = np.bincount(node)[node] > 1
    return [np.flatnonzero(x) for x in np.split(several, np.cumsum(sizes - window + 1)[:-1])]


def _trees(window: int, most_words: int = 400_000):
    """Task that builds the suffix trees of the parts it gets, whole parts at a time."""

    def solve(part: list, first: list, words: list, keys: list) -> Iterator[pa.RecordBatch]:
        offsets = repeated_suffixes(np.unique(np.array(part), return_inverse=True)[1], words, window)
        row = np.repeat(np.arange(len(offsets)), [len(o) for o in offsets])
        at = np.concatenate(offsets) + np.array(first)[row]
        own = pa.Table.from_batches(keys).combine_chunks().take(pa.array(row))
        yield from own.append_column("first", pa.array(at, pa.int32())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, words, keys, total = [], [], [], [], 0
        for b in batches:
            start, parts = 0, b.column("part").to_pylist()
            firsts, under = b.column("first").to_pylist(), b.column("words").to_pylist()
            for i in range(b.num_rows):
                if total >= most_words and parts[i] != part[-1]:
                    keys.append(b.slice(start, i - start).select(KEYS))
                    yield from solve(part, first, words, keys)
                    part, first, words, keys, total, start = [], [], [], [], 0, i
                part.append(parts[i])
                first.append(firsts[i])
                words.append(under[i])
                total += under[i].count(b" ") + 1
            keys.append(b.slice(start).select(KEYS))
        if part:
            yield from solve(part, first, words, keys)

    return run


def shared_runs(docs: DataFrame, window: int, gram: int, part: int) -> DataFrame:
    """Of each document (``KEYS``) the runs of windows whose anchor occurs elsewhere: ``whole``, runs of
    parts that are one text over and over (first and last window in the upper and lower half of
    a number), and ``runs`` (``first``, ``last``, ``key``, ``large``) of parts that branch."""
    found = cut(anchored(docs, window, gram))
    runs = found.select(*KEYS, F.explode(F.arrays_zip("first", "last", "key", "label")).alias("r")).select(*KEYS, "r.*")
    counts = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    # written, so that both sides of the join are plain shuffles, of which Spark splits hot keys
    counts = cut(counts.filter("n > 1").select("key", "n", (F.col("low") == F.col("high")).alias("alike")))
    span = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")
    one = F.struct("first", "last", "key", (F.col("n") > part).alias("large"))
    return (runs.drop("label").join(counts, "key").groupBy(*KEYS)
                .agg(F.collect_set(F.when(F.col("alike"), span)).alias("whole"),
                     F.collect_set(F.when(~F.col("alike"), one)).alias("runs")))


def repeats(texts_packed: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """``KEYS``, ``first``: the windows of branching parts that also start elsewhere."""
    # rows that repeat doc_id and text share one list and each send their words, so they count as copies
    joined = texts_packed.join(shared.filter("size(runs) > 0").select(*KEYS, "runs"), KEYS)
    by_tree = (stretches(joined, window).repartition("part").sortWithinPartitions("part")
               .mapInArrow(_trees(window), "doc_id long, missing boolean, fp long, first int"))
    if shared.filter(F.exists("runs", lambda r: r["large"])).isEmpty():
        return by_tree
    single = suffixes(joined.filter(F.exists("runs", lambda r: r["large"])), window)
    several = single.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    return by_tree.unionByName(single.join(several, "label").select(*KEYS, "first"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 gram: int = GRAM, part: int = PART) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``text`` (kept words)."""
    d = _with_keys(docs, id_col, text_col)
    shared, data = cut(shared_runs(d, window, gram, part)), packed(d)
    starts = repeats(data, shared, window).groupBy(*KEYS).agg(F.collect_set("first").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, kept = [], [], []
            for words, whole, single in zip(_unpacked(b), b.column("whole"), b.column("starts"), strict=True):
                n.append(len(words))
                edge = np.zeros(len(words) + 1, np.int64)
                if whole.is_valid:
                    spans = whole.values.to_numpy()
                    np.add.at(edge, spans >> 32, 1)
                    np.add.at(edge, (spans & 0xFFFFFFFF) + window, -1)
                if single.is_valid:
                    at = single.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                if edge.any():
                    words = list(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
                m.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            ids = pa.compute.if_else(b.column("missing"), pa.scalar(None, pa.int64()), b.column("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "text"])

    return (data.join(shared.select(*KEYS, "whole"), KEYS, "left").join(starts, KEYS, "left")
                .select(*KEYS, "packed", "whole", "starts")
                .mapInArrow(run, "doc_id long, n_words long, n_removed long, text string"))
