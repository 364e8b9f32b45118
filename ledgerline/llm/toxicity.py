"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the subsequences of ``ORDER`` letters that they share, each
weighted down by ``DECAY`` for every letter that it spans, so gaps and inserted letters cost
a little and not everything ("id-iot", "idxiot"). Words are stripped of all that is not a
letter or digit, and letters that stand alone in a row are joined ("i d i o t"), so spaced
and punctuated spellings come out as the word.

Landmarks are words that labelled toxic texts hold far more often than others, chosen one by one:
a text that holds some already counts less for the next, so insults of rarer languages get
theirs. The kernel of a text with a landmark is the root of the mean square of their likeness
(the kernel value, normalised and squared) over all its words, repeats included, and the windows
of its sentences; so it tells how dense the text is in words like the landmark, where words that
are a little like it hardly count. These values are Nyström-whitened by the landmarks' own matrix.
Sentence windows are made of a sentence's letters, wherever words begin and end ("worth less",
"i. d. i. o. t."); the kernel runs on those that hold a landmark's letters in order, at most one
missing and at most one other letter between neighbours. A linear support vector machine (squared
hinge) is trained on labelled rows and its margin made a probability by a logistic fit.

Landmarks and machine are fitted on a bounded sample of the labelled rows (``MOST_TOXIC`` and
``MOST_OTHER`` rows, drawn by a hash of the id); every text is scored whole. The sample is what
is broadcast. Each task compares only the distinct words of a batch that share enough letters
with a landmark, so the kernel runs on a small share of the words. Words too long for a landmark
are looked at in overlapping windows of about its own size.

Defined results: null and empty texts have likeness 0 to all landmarks and get a score; without
toxic or without other labelled rows the score is the share of toxic ones (0 without rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, texts

ORDER, DECAY, SPAN = 3, 0.85, 24
LANDMARKS, MOST_TOXIC, MOST_OTHER, THRESHOLD = 64, 3000, 6000, 0.7
#: Words that landmarks are chosen from, and what a text counts for the next choice once it holds one.
CANDIDATES, FADE = 1000, 0.7
#: Weight of a toxic row in training against another one, and cost of a row on the wrong side.
TOXIC_WEIGHT, COST = 3.0, 100.0
#: Directions in which the landmarks differ less (eigenvalues of their matrix) are not blown up.
LEAST_VALUE = 0.5
#: Share of a landmark's different letters that a word must have to be compared with it.
LEAST_LETTERS = 0.75
#: Likeness from which a window of a longer word counts.
NEAR = 0.3
#: Texts that are compared at once; words whose values a task keeps for the next ones.
ROWS, MOST_KNOWN = 1500, 400_000
_NOT_LETTERS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]\s+){2,}[^\W_](?!\S)")


def _plain(word: str) -> str:
    return word if word.isalnum() else _NOT_LETTERS.sub("", word)


def word_counts(text: str) -> Counter[str]:
    """The words of a text, lower-cased, and how often each comes; spaced-out letters also joined."""
    text = text.lower()
    out = Counter(text.split())
    out.update("".join(m.group().split()) for m in _SPACED.finditer(text))
    return out


def raw_words(text: str) -> set[str]:
    """The different words of ``word_counts``."""
    return set(word_counts(text))


@cache
def _spelled(mark: str) -> str:
    """Pattern of a landmark's letters in order, at most one of them missing (of five or more) and
    at most one other letter between neighbours."""
    short = [mark[:i] + mark[i + 1:] for i in range(len(mark))] if len(mark) > 4 else []
    return "|".join("[^\x01]??".join(x) for x in dict.fromkeys([mark, *short]))


@cache
def _finder(mark: str) -> re.Pattern:
    return re.compile(f"(?=({_spelled(mark)}))")


def spelled_apart(batch: list[str], landmarks: list[str]) -> list[set[str]]:
    """For each text the windows of its sentences that spell a landmark (``_spelled``) over the ends
    of words: they start with one word and end with another. A sentence ends at a stop that
    follows two letters and stands before a space."""
    out: list[set[str]] = [set() for _ in batch]
    if not batch or not landmarks:
        return out
    flat = pa.array([t.lower() for t in batch], pa.large_string())
    flat = pc.split_pattern(pc.replace_substring_regex(flat, r"([\p{L}\p{N}]{2})[.!?…]+\s", "\\1\x01"), "\x01")
    of, sent = pc.list_parent_indices(flat), pc.list_flatten(flat)
    flat = pc.replace_substring_regex(sent, r"[^\p{L}\p{N}]+", "")
    words: dict[int, tuple[str, set[int], dict[int, int]]] = {}
    for first in range(0, len(landmarks), 8):
        some = landmarks[first:first + 8]
        at = np.flatnonzero(pc.match_substring_regex(flat, "|".join(map(_spelled, some))).to_numpy(zero_copy_only=False))
        sentence = flat.take(pa.array(at))
        for mark in some:
            own = pc.match_substring_regex(sentence, _spelled(mark)).to_numpy(zero_copy_only=False)
            for k in at[own].tolist():
                if k not in words:
                    plain = [p for w in sent[k].as_py().split() if (p := _plain(w))]
                    ends = np.cumsum([len(p) for p in plain]).tolist()
                    words[k] = "".join(plain), set(ends), dict(zip([0, *ends[:-1]], ends, strict=False))
                letters, ends, word_end = words[k]
                for m in _finder(mark).finditer(letters):
                    end = m.end(1)
                    if end in ends and word_end.get(m.start(), end) < end:
                        out[of[k].as_py()].add(m.group(1))
    return out


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= SPAN else [word[i:i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, one row per word, 0 beyond its end; lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    out = np.zeros((len(words), int(length.max(initial=0))), np.int32)
    out[np.arange(out.shape[1])[None, :] < length[:, None]] = flat
    return out, length


def kernel(words: np.ndarray, others: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``words`` with that row of ``others``
    (codes, 0 beyond the end)."""
    value = np.zeros(len(words))
    for at in range(0, len(words), 512):
        s, o = words[at:at + 512].T, others[at:at + 512].T
        equal = ((s[None, :, :] == o[:, None, :]) & (s[None, :, :] != 0)).astype(np.float32) * decay * decay
        # tails[j, i]: weight of the subsequences of the level below that both words have before j and i
        tails = np.ones((len(o) + 1, len(s) + 1, s.shape[1]), np.float32)
        for level in range(order):
            ends = equal * tails[:-1, :-1]
            if level == order - 1:
                value[at:at + 512] = ends.sum(axis=(0, 1))
                break
            tails = np.zeros_like(tails)
            for i in range(len(s)):
                tails[1:, i + 1] = decay * tails[1:, i] + ends[:, i]
            for j in range(1, len(o)):
                tails[j + 1] += decay * tails[j]
    return value


def alike(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel, squared: one row per word, one column per landmark. 0 where the word
    lacks the letters for it, or is not of about the landmark's length (see ``alike_inside``)."""
    out = np.zeros((len(words), len(landmarks)))
    if not words or not landmarks:
        return out
    codes, length = _codes(words)
    marks, mark_length = _codes(landmarks)
    masks = _masks(codes)
    rows, cols = [], []
    for j, size in enumerate(mark_length):
        at = np.nonzero(_has_letters(masks, marks[j, :size]) & (length >= LEAST_LETTERS * size) & (length <= 2 * size + 2))[0]
        rows.append(at)
        cols.append(np.full(len(at), j))
    row, col = np.concatenate(rows), np.concatenate(cols)
    k = np.zeros(len(row))
    longest = np.maximum(length[row], 1)
    for low, high in ((0, 9), (9, 14), (14, SPAN)):  # short words need few columns
        part = np.nonzero((longest > low) & (longest <= high))[0]
        k[part] = kernel(codes[row[part], :high], marks[col[part]])
    near = k > 0
    row, col, k = row[near], col[near], k[near]
    different, where = np.unique(row, return_inverse=True)
    own = kernel(codes[different], codes[different])
    norm = kernel(marks, marks)
    out[row, col] = np.minimum(k / np.sqrt(own[where] * norm[col]), 1.0) ** 2
    return out


def _window_sizes(size: int) -> tuple[int, int]:
    """Letters of the shortest and of the longest window that is compared with a landmark."""
    return max(math.ceil(LEAST_LETTERS * size), ORDER), size + size // 2


@cache
def _least_own(size: int) -> float:
    """The least kernel of so many letters with themselves: no subsequence comes twice."""
    return sum((size - n + 1) * math.comb(n - 2, ORDER - 2) * DECAY ** (2 * n) for n in range(ORDER, size + 1))


def _masks(codes: np.ndarray) -> np.ndarray:
    """Letters of each row as bits (several letters share one)."""
    return np.bitwise_or.reduce(np.where(codes > 0, np.left_shift(np.int64(1), codes.astype(np.int64) % 63), 0), axis=1)


def _has_letters(masks: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether ``LEAST_LETTERS`` of the landmark's different letters are there."""
    letters = np.unique(np.left_shift(np.int64(1), mark.astype(np.int64) % 63))
    return sum(((masks & b) != 0).astype(np.int8) for b in letters) >= LEAST_LETTERS * len(letters)


def alike_inside(words: list[str], landmarks: list[str]) -> np.ndarray:
    """For words too long for a landmark, the largest likeness of their windows to it, 0 below
    ``NEAR`` (and for the others): a window is any run of ``_window_sizes`` letters. They are cut
    into pieces of two landmarks' length that overlap by the longest window, so each window lies
    whole in a piece. A piece is dropped only if no window in it can be near: its letters and
    its kernel are not less than theirs, and their own kernel is not below ``_least_own``."""
    out = np.zeros((len(words), len(landmarks)))
    if not words or not landmarks:
        return out
    length = np.fromiter(map(len, words), np.int64, len(words))
    flat = _codes(["".join(words)])[0][0]
    start = np.cumsum(length) - length
    for m in sorted(set(map(len, landmarks))):
        low, high = _window_sizes(m)
        step, wide = 2 * m - high + 1, np.arange(2 * m)
        long = np.nonzero(length > 2 * m + 2)[0]
        pieces_of = -(-(length[long] - 2 * m) // step) + 1
        word = np.repeat(long, pieces_of)
        offset = (np.arange(len(word)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)) * step
        for at in range(0, len(word), 1 << 13):
            of, off = word[at:at + (1 << 13)], offset[at:at + (1 << 13)]
            left = length[of] - off
            code = np.where(wide < left[:, None], flat[np.minimum((start[of] + off)[:, None] + wide, len(flat) - 1)], 0)
            masks = _masks(code)
            for j in (j for j, mark in enumerate(landmarks) if len(mark) == m):
                mark = _codes([landmarks[j]])[0]
                norm = kernel(mark, mark)[0]
                row = np.nonzero(_has_letters(masks, mark[0]))[0]
                most = kernel(code[row], np.repeat(mark, len(row), 0)) ** 2 / norm / _least_own(low)
                row = row[most >= NEAR * (1 - 1e-4)]
                for w in range(low, high + 1):
                    windows = np.lib.stride_tricks.sliding_window_view(code[row], w, axis=1)
                    i, k = np.nonzero(windows[:, :, -1] != 0)
                    windows = windows[i, k]
                    near = _has_letters(_masks(windows), mark[0])
                    i, windows = i[near], windows[near]
                    value = kernel(windows, np.repeat(mark, len(i), 0)) ** 2 / norm
                    near = value >= NEAR * _least_own(w) * (1 - 1e-4)
                    i, windows, value = i[near], windows[near], value[near]
                    value = np.minimum(value / np.maximum(kernel(windows, windows), 1e-9), 1.0)
                    near = value >= NEAR
                    np.maximum.at(out[:, j], of[row[i[near]]], value[near])
    return out


def word_values(batch: list[str], landmarks: list[str],
                known: dict[str, np.ndarray | None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each text the likenesses of its words, and of the windows of its sentences that spell a
    landmark, to each landmark (a row per different word that has any), how often each comes, and
    the words of the text. ``known`` keeps words' values for the next call."""
    sets = []
    for t, windows in zip(batch, spelled_apart(batch, landmarks), strict=True):
        own = word_counts(t)
        own.update(windows.difference(own))
        sets.append(own)
    known = {} if known is None else known
    different = list(set().union(*sets).difference(known)) if sets else []
    known.update(dict.fromkeys(different))
    plain = list(map(_plain, different))
    parts, of = [], []
    for i, w in enumerate(plain):
        if len(w) > SPAN:
            own = pieces(w)
            parts.extend(own)
            of.extend([i] * len(own))
        elif len(w) >= ORDER:
            parts.append(w)
            of.append(i)
    least = 2 * min(map(len, landmarks), default=0) + 2
    long = [i for i, p in enumerate(plain) if len(p) > least]
    for rows, values in ((of, lambda at: alike(parts[at:at + 10_000], landmarks)),
                         (long, lambda at: alike_inside([plain[i] for i in long[at:at + 10_000]], landmarks))):
        for start in range(0, len(rows), 10_000):
            k = values(start)
            for r in np.nonzero(k.any(axis=1))[0]:
                w = different[rows[start + r]]
                known[w] = k[r].copy() if known[w] is None else np.maximum(known[w], k[r])
    for s in sets:
        near = [(k, n) for w, n in s.items() if (k := known[w]) is not None]
        values = np.array([k for k, _ in near]).reshape(len(near), len(landmarks))
        yield values, np.array([n for _, n in near], np.float64), s.total()


def likeness(batch: list[str], landmarks: list[str], known: dict[str, np.ndarray | None] | None = None) -> np.ndarray:
    """For each text its largest likeness to each landmark."""
    return np.array([v.max(axis=0, initial=0) for v, _, _ in word_values(batch, landmarks, known)]).reshape(len(batch), len(landmarks))


def density(batch: list[str], landmarks: list[str], known: dict[str, np.ndarray | None] | None = None) -> np.ndarray:
    """For each text its kernel with each landmark: the root mean square of its words' likeness."""
    return np.array([np.sqrt(n @ v ** 2 / max(words, 1)) for v, n, words in word_values(batch, landmarks, known)]) \
        .reshape(len(batch), len(landmarks))


@dataclass
class Model:
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.whiten @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -60, 60)))


def sample(labels: DataFrame, most_toxic: int = MOST_TOXIC, most_other: int = MOST_OTHER) -> DataFrame:
    """At most so many labelled rows of either class (``doc_id``, ``label``), drawn by hash."""
    rows = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = lambda v, n: rows.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return cut(drawn(1, most_toxic).unionByName(drawn(0, most_other)))


def find_landmarks(docs: DataFrame, drawn: DataFrame, most: int = LANDMARKS) -> list[str]:
    """Words that set toxic texts of the sample apart, each the one that adds most to those
    before it: what a text counts fades with each landmark that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, label, of = [], [], []
            for doc, text, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True):
                own = {p for w in raw_words(text) for p in pieces(_plain(w)) if len(p) >= ORDER}
                words.extend(own)
                label.extend([y] * len(own))
                of.extend([doc] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(label, pa.int32()), pa.array(of, pa.int64())],
                                             ["word", "label", "doc"])

    joined = (texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(drawn), "doc_id")
              .select("doc_id", "text", F.col("label").cast("int")))
    n = {r["label"]: r["count"] for r in joined.groupBy("label").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return []
    each = cut(joined.mapInArrow(run, "word string, label int, doc long"))
    held = each.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("o") + 0.5) / (other + 1)))
    top = cut(held.filter("t >= 2").withColumn("odds", odds).filter("odds > 1.5")
              .orderBy(F.desc(F.col("t") * F.col("odds")), "word").limit(CANDIDATES).select("word", "odds"))
    # of each candidate the toxic texts of the sample that hold it
    rows = (each.filter("label = 1").join(F.broadcast(top), "word").groupBy("word", "odds")
                .agg(F.collect_set("doc").alias("docs")).orderBy("word").collect())
    return _choose([(r["word"], r["odds"], r["docs"]) for r in rows], most)


def _choose(candidates: list[tuple[str, float, list[int]]], most: int) -> list[str]:
    """Greedy choice; ties go to the first word."""
    place = {d: i for i, d in enumerate(sorted({d for _, _, docs in candidates for d in docs}))}
    docs = [np.array(sorted(place[d] for d in own)) for _, _, own in candidates]
    weight, left, out = np.ones(len(place)), list(range(len(candidates))), []
    while left and len(out) < most:
        best = max(left, key=lambda i: (candidates[i][1] * weight[docs[i]].sum(), -i))
        left.remove(best)
        out.append(candidates[best][0])
        weight[docs[best]] *= FADE
    return out


def with_likeness(docs: DataFrame, landmarks: list[str]) -> DataFrame:
    """``doc_id`` and ``x``, the text's kernel with each landmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray | None] = {}
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = density(b.column("text").to_pylist(), landmarks, known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])
            if len(known) > MOST_KNOWN:
                known.clear()

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, x array<double>")


def train(x: np.ndarray, y: np.ndarray, landmarks: list[str], share: float, cost: float = COST) -> Model:
    """Squared-hinge machine on whitened features, by Newton steps, toxic rows weighing
    ``TOXIC_WEIGHT``; then a logistic fit of the margin in which toxic rows count as the ``share``
    that they have among all labelled ones, with the same weight: a toxic text that is let
    through costs more than a clean one that is marked."""
    k = alike(landmarks, landmarks)
    k = np.maximum(k, k.T)
    np.fill_diagonal(k, 1.0)
    values, vectors = np.linalg.eigh(k)
    whiten = vectors / np.sqrt(np.maximum(values, LEAST_VALUE)) @ vectors.T
    z = np.column_stack([x @ whiten, np.ones(len(x))])
    sign = np.where(y > 0, 1.0, -1.0)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) * len(x) / (cost * 100)
    ridge[-1, -1] = 1e-9
    for _ in range(50):
        inside = sign * (z @ w) < 1
        zi = z[inside]
        weighed = zi * np.where(y[inside] > 0, TOXIC_WEIGHT, 1.0)[:, None]
        new = np.linalg.solve(ridge + weighed.T @ zi, weighed.T @ sign[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    model = Model(landmarks, whiten, w, 1.0, 0.0)
    m = model.margin(x)
    weight = np.where(y > 0, TOXIC_WEIGHT * share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    design, ab = np.column_stack([m, np.ones(len(m))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -60, 60)))
        step = np.linalg.solve(design.T @ (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + 1e-3 * np.eye(2),
                               design.T @ (weight * (y - p)) - 1e-3 * ab)
        ab = ab + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(ab[0], 0.0)), float(ab[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, marked: DataFrame | None = None,
        landmarks: list[str] | None = None, drawn: DataFrame | None = None) -> Model:
    """A model of the labelled rows (``labels``: ``doc_id``, ``label``). ``marked``, if given, is
    ``with_likeness`` of the same documents and landmarks."""
    drawn = sample(labels) if drawn is None else drawn
    landmarks = find_landmarks(docs, drawn) if landmarks is None else landmarks
    n = labels.filter("label IS NOT NULL").agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    share = float(n["share"] or 0.0)
    if not landmarks:
        certain = min(max(share, 1e-9), 1 - 1e-9)
        return Model([], np.zeros((0, 0)), np.zeros(1), 0.0, float(np.log(certain / (1 - certain))))
    marked = with_likeness(docs, landmarks) if marked is None else marked
    rows = marked.join(F.broadcast(drawn), "doc_id").select("x", "label").collect()  # the bounded sample
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], np.float64)
    return train(x, y, landmarks, share)


def scored(marked: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` from ``doc_id`` and ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(b.num_rows, len(model.landmarks))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return marked.mapInArrow(run, "doc_id long, score double")


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``score`` of every document, by a model of the labelled ones."""
    drawn = sample(labels)
    landmarks = find_landmarks(docs, drawn)
    marked = cut(with_likeness(docs, landmarks))
    return scored(marked, fit(docs, labels, marked, landmarks, drawn))


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(density([t or "" for t in values], model.landmarks)))

    return run(text)
