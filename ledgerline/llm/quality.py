"""Quality classifier: random Fourier features, partition-summed normal equations, ridge,
isotonic calibration.

A document becomes a few statistics of its whole text (``STATISTICS``). Standardised, they
are mapped by random Fourier features, which approximate a Gaussian kernel. Each task sums
its rows' normal equations; Spark adds up the tasks' sums, so what reaches the driver has
the size of the feature space however many rows there are. The ridge scores are made
probabilities by isotonic regression over a histogram of the training rows' scores.

Training uses all labelled rows it is given (``train_rows`` of the query: all folds but
one). Inputs of a score are the text's statistics alone.

Defined results: null and empty texts have zero statistics and get a score like any other;
rows without a label train nothing; without labelled rows, or rows of one class only, every
score is the share of that class (0.5 without rows); other columns pass through ``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, cut, texts

STATISTICS = ("log chars", "log words", "capitals", "digits", "symbols", "stops and commas", "exclamations", "bars",
              "other than ASCII", "word length", "spread of word length", "distinct words", "commonest word",
              "repeats of the word before", "distinct lines", "log words a line")
FEATURES, RIDGE, SEED, THRESHOLD, BINS = 192, 1e-3, 7, 0.7, 400
#: Scores below and above these share the outermost bins of the histogram.
LOW, HIGH = -0.5, 1.5

_CLASS = np.zeros((256, 7))
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+-/<=>@\\^_`~\"'()[]{}:;?", b".,", b"!", b"|",
                             bytes(range(128, 256)))):
    _CLASS[list(_chars), _k] = 1.0


def statistics(text: str) -> list[float]:
    """The statistics of one text; zeros for an empty one."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(data)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / chars
    length = np.fromiter(map(len, words), np.float64, n)
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip(SPACES.encode())]
    return [math.log1p(chars), math.log1p(n), *shares.tolist(), float(length.mean()), float(length.std()),
            len(count) / n, max(count.values()) / n, sum(map(eq, words, words[1:])) / n,
            len(set(lines)) / len(lines), math.log1p(n / len(lines))]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    #: Labelled rows that it was fitted on.
    rows: int = 0

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2.0 / len(self.phases)) * np.cos((x - self.mean) / self.scale @ self.frequencies + self.phases)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels) if len(x) else np.zeros(0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(STATISTICS))


def isotonic(position: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators: one level for each position."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count, strict=True):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """The model of ``rows`` (``x``, ``label`` 0 or 1; all of them are used)."""
    rows = cut(rows.select("x", F.col("label").cast("double").alias("label")).filter("label IS NOT NULL"))
    d = len(STATISTICS)
    named = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = rows.agg(*named, F.count("*").alias("n"), F.avg("label").alias("share")).first()
    share = got["share"] if got["n"] else 0.5
    rng = np.random.default_rng(seed)
    spread = np.array([got[f"s{i}"] or 0.0 for i in range(d)])
    model = Model(np.array([got[f"m{i}"] or 0.0 for i in range(d)]), np.where(spread > 1e-9, spread, 1.0),
                  rng.normal(0.0, 1.0 / math.sqrt(d), (d, features)), rng.uniform(0, 2 * math.pi, features),
                  np.zeros(features + 1), np.array([0.0, 1.0]), np.array([share, share]), got["n"])
    if share in (0.0, 1.0) or not got["n"]:
        return model

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            z = model.features(_matrix(b))
            total += z.T @ np.column_stack([z, b.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array(list(total))], ["i", "v"])

    def add(table: pa.Table) -> pa.Table:
        v = np.array(table.column("v").to_pylist()).sum(axis=0)
        return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "v": pa.array([v.tolist()])})

    added = rows.mapInArrow(sums, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>")
    equations = np.array([r["v"] for r in sorted(added.collect(), key=lambda r: r["i"])])  # as many rows as features
    a, b = equations[:, :-1], equations[:, -1]
    model.weights = np.linalg.solve(a + ridge * got["n"] * np.eye(features + 1), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = (model.raw(_matrix(batch)) - LOW) / (HIGH - LOW) * BINS
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(place, 0, BINS - 1).astype(np.int32)),
                                              batch.column("label")], ["bin", "label"])

    hist = (rows.mapInArrow(binned, "bin int, label double").groupBy("bin")
                .agg(F.sum("label").alias("total"), F.count("*").alias("n")).orderBy("bin").collect())  # BINS rows at most
    bins, total, n = (np.array([r[c] for r in hist], np.float64) for c in ("bin", "total", "n"))
    model.knots = LOW + (bins + 0.5) * (HIGH - LOW) / BINS
    model.levels = isotonic(bins, total, n)
    return model


def scored(statistics_of: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` from ``doc_id`` and ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b)))], ["doc_id", "score"])

    return statistics_of.mapInArrow(run, "doc_id long, score double")


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in values]).reshape(-1, len(STATISTICS))))

    return run(text)


def training_rows(statistics_of: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows: ``x`` and ``label`` from the table of labels (``doc_id``, ``label``)."""
    return statistics_of.join(labels.select("doc_id", "label"), "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold`` by a model of their labelled rows; all of
    ``docs`` if none is labelled, as there is nothing to reject them by."""
    model = fit(training_rows(with_statistics(docs), labels))
    if not model.rows:
        return docs
    return docs.filter(score_of(F.col("text"), model) >= threshold)
