"""Cross-tokenizer alignment by galloping intersection of token ends.

Every text is encoded by two tokenizers. The byte offsets where their tokens end are two
ascending lists; the shorter one drives an exponential and then binary search into the
longer. Common ends cut the text into groups; the differences of the ranks that the search
gives are the ranges of tokens that overlap. How often two ids overlap is counted over the
whole corpus, and each document is told how its links compare with those counts.

Documents travel once: the first pass writes, per document, its figures and its distinct
pairs of linked ids. Counts of pairs are a partial aggregate. A pair that is linked in more
than 1 in ``MOST_KNOWN`` links (there are fewer of these than ``MOST_KNOWN``, whatever the
corpus) is looked up inside the tasks that read the documents; the others are joined by a
shuffle, in which no pair is hot. Texts are encoded in chunks of ``CHUNK`` characters, so a
task holds the tokens of one chunk, or of one longer text.

Defined results: a null or empty text, and one that the bytes of either tokenizer's tokens do
not spell, has no tokens: zeros and empty groups. Rows are told apart by a row number of the
scan, so null, repeated and tied ids each get their own result; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import texts, written

#: Folder of the tokenizer files, and their names. The driver reads them; tasks get the bytes.
TOKENIZERS, BYTE_LEVEL, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs that are looked up in the task; at most as many are sent there (16 bytes each).
MOST_KNOWN = 1 << 20
#: Characters of text that a task encodes at a time.
CHUNK = 1 << 20
#: Driving elements between two anchors of the search.
STRIDE = 16

#: Words whose tokens a worker keeps, and their tokens; both are dropped when one is reached.
MOST_WORDS, MOST_TOKENS = 1 << 19, 1 << 22
#: Where a text may be cut: between a character that is surely no white space and a space that
#: is followed by another such character. No token of either tokenizer goes over that place.
_SURE = r"[!-~\u00a1-\u00ff]"
_WORDS, _WORD = re.compile(f"(?<={_SURE})(?= {_SURE})"), re.compile(f" {_SURE}.*{_SURE}\\Z", re.S)

#: A tokenizer for tasks: encodes a text that starts with a space, and knows the bytes of each id.
Coder = tuple[Callable[[str], list[int]], list[bytes]]
_LOADED: dict[bytes, Words] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for
    themselves, the others, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_coder(data: bytes) -> Coder:
    """A tokenizer of the ``tokenizers`` library with a byte-level vocabulary. Strings of its
    special tokens are ordinary text. Its pattern splits before a space that follows another
    character than white space, so words can be encoded one by one."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.encode_special_tokens = True
    alphabet = byte_alphabet()
    names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    spelled = [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names]
    return lambda text: t.encode(text, add_special_tokens=False).ids, spelled


def piece_coder(data: bytes) -> Coder:
    """A tokenizer of the ``sentencepiece`` library, which puts a space before texts itself. No
    piece may hold a space behind another character; then words can be encoded one by one."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=data)
    spelled = [bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(map(s.id_to_piece, range(s.vocab_size())))]
    if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in spelled):
        raise ValueError("pieces that go over the start of a word are not supported")
    return lambda text: s.encode(text[1:]), spelled


class Words(dict):
    """Words (with the space before them) by number, and the tokens of each on both sides."""

    def __init__(self, a: Coder, b: Coder):
        self.encode, self.bytes = (a[0], b[0]), (a[1], b[1])
        self.lengths = [np.array([len(x) for x in own], np.int64) for own in self.bytes]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.size, self.spelled = (array("i"), array("i")), (array("q"), array("q")), array("b")

    def full(self) -> bool:
        return len(self) >= MOST_WORDS or max(map(len, self.ids)) >= MOST_TOKENS

    def learn(self, words: list[str]) -> None:
        """Tokens of new words. Words that start and end as at a cut are encoded as one text
        and told apart by their bytes; where these differ from the text, in halves."""
        whole = [w.encode("utf-8", "surrogatepass") for w in words]
        regular = [i for i, w in enumerate(words) if len(w) > 2 and _WORD.match(w)]
        right = np.ones(len(words), bool)
        for side, own in enumerate(self.bytes):
            coded: list[list[int]] = [[]] * len(words)
            todo = [regular, *([i] for i in set(range(len(words))) - set(regular))]
            while todo:
                part = todo.pop()
                ids = self.encode[side]("".join(words[i] for i in part)) if part else []
                if b"".join(map(own.__getitem__, ids)) == b"".join(whole[i] for i in part):
                    ends = np.cumsum([len(whole[i]) for i in part], dtype=np.int64)
                    to = np.searchsorted(np.cumsum(self.lengths[side][ids]), ends) + 1
                    for i, x, y in zip(part, np.append(0, to).tolist(), to.tolist(), strict=False):
                        coded[i] = ids[x:y]
                elif len(part) > 1:
                    todo += [part[:len(part) // 2], part[len(part) // 2:]]
                else:
                    coded[part[0]], right[part[0]] = ids, False
            self.ids[side].extend(chain.from_iterable(coded))
            self.size[side].extend(map(len, coded))
        self.spelled.extend(right.tolist())
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))

    def tokens(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, text by text, and how many each text has; none where the bytes
        of either side do not spell the text with a space before it."""
        if self.full():
            self.forget()
        cut = [_WORDS.split(" " + x) if x else [] for x in rows]
        n_words = np.array(list(map(len, cut)), np.int64)
        self.learn([w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self])
        word = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, n_words.sum())
        of = np.repeat(np.arange(len(rows)), n_words)
        for i in np.unique(of[np.array(self.spelled, bool)[word] == 0]).tolist() if len(word) else []:
            if any(b"".join(own[k] for w in cut[i] for k in self.encode[side](w)) != (" " + rows[i]).encode("utf-8", "surrogatepass")
                   for side, own in enumerate(self.bytes)):
                word, of = word[of != i], of[of != i]
        ids, n = [], []
        for own, size in zip(self.ids, self.size, strict=True):
            size = np.array(size, np.int64)
            n.append(np.bincount(of, weights=size[word], minlength=len(rows)).astype(np.int64))
            ids.append(np.array(own, np.int64)[_ranges((np.cumsum(size) - size)[word], size[word])])
        return *ids, *n


def _words(file_a: bytes, file_b: bytes) -> Words:
    """One per worker process and pair of files."""
    key = hashlib.sha256(file_a).digest() + hashlib.sha256(file_b).digest()
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[key] = Words(byte_level_coder(file_a), piece_coder(file_b))
    return _LOADED[key]


def gallop(short: np.ndarray, long: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """For each element of ``short`` how many of ``long`` are smaller; both ascend strictly.

    Every ``stride``-th element, the anchors, is searched from where the anchor before it was
    found: steps double until they pass it, then the last step is halved. The elements behind
    an anchor start from its place and take these steps together.
    """
    n, at, places, values = len(long), 0, [], memoryview(np.ascontiguousarray(long))
    for x in short[::stride].tolist():
        step = 1
        while at + step <= n and values[at + step - 1] < x:
            at, step = at + step, 2 * step
        high = min(at + step - 1, n)
        while at < high:
            middle = (at + high) // 2
            if values[middle] < x:
                at = middle + 1
            else:
                high = middle
        places.append(at)
    rank = np.repeat(np.array(places, np.int64), stride)[:len(short)]
    # behind the end stands what no element passes
    long = np.append(long, np.iinfo(np.int64).max)
    going, step, found = np.arange(len(short)), 1, []
    while len(going):
        passed = long[np.minimum(rank[going] + step - 1, n)] < short[going]
        found.append((going[~passed], step))
        going = going[passed]
        rank[going] += step
        step *= 2
    for own, step in found:
        while step > 1 and len(own):  # the place is one of ``step``
            step //= 2
            own_passed = long[np.minimum(rank[own] + step - 1, n)] < short[own]
            rank[own[own_passed]] += step
    return rank


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of the next, and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of two encodings of the same bytes, by their ends: the tokens of either side
    that end a group (as many on both), and the links, as tokens of a and of b."""
    swap = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = gallop(short, long)
    common = np.zeros(len(short), bool)
    inside = rank < len(long)
    common[inside] = long[rank[inside]] == short[inside]
    first = np.concatenate(([0], (rank + common)[:-1])) if len(rank) else rank
    count = rank - first + 1
    by_short, by_long = np.repeat(np.arange(len(short)), count), _ranges(first, count)
    last_short, last_long = np.flatnonzero(common), rank[common]
    return (last_long, last_short, by_long, by_short) if swap else (last_short, last_long, by_short, by_long)


def _spellings(ids: int, seps: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``<id><separator>`` for each id and separator (row id * len(seps) + which), and
    which of them count."""
    rows = [f"{i}{s}".encode() for i in range(ids) for s in seps]
    width = max(map(len, rows))
    table = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    return table, table != 0


class Aligner:
    """Aligns chunks of texts. ``aligned`` gives, per text, the figures of its row."""

    def __init__(self, words: Words):
        self.words, self.bytes, self.lengths = words, words.bytes, words.lengths
        self.ids_b = len(self.bytes[1])
        spelled = [_spellings(len(own), seps) for own, seps in zip(self.bytes, (",|", ",;"), strict=True)]
        width = max(t.shape[1] for t, _ in spelled)
        self.table, self.shown = (np.concatenate([np.pad(x[k], ((0, 0), (0, width - x[k].shape[1]))) for x in spelled])
                                  for k in (0, 1))

    def aligned(self, rows: list[str]) -> dict[str, list]:
        """Texts follow each other in one pair of lists of ends: a text's end is common to both
        sides, so no group and no link goes over it."""
        ids_a, ids_b, n_a, n_b = self.words.tokens(rows)
        last_a, last_b, link_a, link_b = align(np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b]))
        doc_of_a = np.repeat(np.arange(len(rows)), n_a)
        n_groups = np.bincount(doc_of_a[last_a], minlength=len(rows))
        n_links = np.bincount(doc_of_a[link_a], minlength=len(rows))
        # distinct pairs of each text and how often it holds them
        of_doc = len(self.bytes[0]) * self.ids_b
        pair = np.sort(doc_of_a[link_a] * of_doc + ids_a[link_a] * self.ids_b + ids_b[link_b])
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        times = np.diff(np.append(new, len(pair)))
        doc, pair = np.divmod(pair[new], of_doc)
        pairs_to = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(rows)))))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": self._digests(n_a, n_b, ids_a, ids_b, last_a, last_b),
                "pairs": pa.ListArray.from_arrays(pa.array(pairs_to, pa.int32()), pa.array(pair)),
                "times": pa.ListArray.from_arrays(pa.array(pairs_to, pa.int32()), pa.array(times, pa.int32()))}

    def _digests(self, n_a, n_b, ids_a, ids_b, last_a, last_b) -> list[str]:
        """Hashes of the groups as text: the tokens of both sides in the order of the text,
        each spelled with the separator behind it."""
        ends = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        ends[0][last_a], ends[1][last_b] = 1, 1
        group_a, group_b = (np.cumsum(e) - e for e in ends)
        spelled = np.zeros(len(ids_a) + len(ids_b), np.int64)
        spelled[np.arange(len(ids_a)) + np.append(0, last_b + 1)[group_a]] = 2 * ids_a + ends[0]
        spelled[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = 2 * (len(self.bytes[0]) + ids_b) + ends[1]
        shown = self.shown[spelled]
        flat, size = self.table[spelled][shown].tobytes(), np.append(0, np.cumsum(shown.sum(axis=1)))
        to = size[np.append(0, np.cumsum(n_a + n_b))].tolist()
        # without the separator behind the last group
        return [hashlib.sha256(flat[i:j - 1]).hexdigest() if j > i else "" for i, j in zip(to[:-1], to[1:], strict=True)]


FIGURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, folder: str = TOKENIZERS, a: str = BYTE_LEVEL, b: str = PIECES,
            chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """One row per document: ``row``, ``doc_id``, its figures, and its distinct linked pairs
    (``id of a * ids of b + id of b``) with how often it holds them; and the ids of b."""
    with open(f"{folder}/{a}", "rb") as f, open(f"{folder}/{b}", "rb") as g:
        file_a, file_b = f.read(), g.read()
    ids_b = len(piece_coder(file_b)[1])
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = rows.select("row", "doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(_words(file_a, file_b))
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False))
            part = (size - 1).clip(0) // chunk
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                own = batch.slice(i, j - i)
                out = aligner.aligned(own.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("doc_id"),
                     *(v if isinstance(v, pa.Array) else pa.array(v) for v in out.values())],
                    ["row", "doc_id", *out])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return written(rows.mapInArrow(run, f"{types}, {FIGURES}"), "aligned"), ids_b


def pair_counts(rows: DataFrame, ids_b: int) -> DataFrame:
    """``pair``, ``links`` (over the corpus), ``best`` (no other pair of its id of b has more)."""
    one = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = written(one.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links")), "pair_counts")
    # one row per id of b: at most the size of its vocabulary
    most = counts.groupBy((F.col("pair") % ids_b).alias("b")).agg(F.max("links").alias("most"))
    return (counts.join(F.broadcast(most), F.col("pair") % ids_b == F.col("b"))
                  .select("pair", "links", (F.col("links") == F.col("most")).alias("best")))


def _look_up(rows: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Per row, what its known pairs give, and its other pairs."""
    pair, links, best = known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column("pairs")).to_numpy(zero_copy_only=False)
            own, times = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("pairs", "times"))
            row = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(pair, own).clip(0, max(len(pair) - 1, 0))
            found = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            # whole numbers, summed as such: bincount with weights would make doubles of them
            sums = np.zeros((2, len(size)), np.int64)
            np.add.at(sums[0], row[found], times[found] * best[at[found]])
            np.add.at(sums[1], row[found], times[found] * links[at[found]])
            to = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~found], minlength=len(size))))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(sums[0]), pa.array(sums[1]),
                 pa.ListArray.from_arrays(to, pa.array(own[~found])),
                 pa.ListArray.from_arrays(to, pa.array(times[~found]))],
                ["row", "n_best", "count_sum", "pairs", "times"])

    return rows.select("row", "pairs", "times").mapInArrow(
        run, "row long, n_best long, count_sum long, pairs array<long>, times array<int>")


def alignment(docs: DataFrame, folder: str = TOKENIZERS, a: str = BYTE_LEVEL, b: str = PIECES,
              most_known: int = MOST_KNOWN) -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``,
    ``n_best`` (links of a pair that its id of b is linked in most often), ``count_sum`` (its
    links' counts over the corpus, added), ``groups_sha256``."""
    rows, ids_b = aligned(docs, folder, a, b)
    counts = written(pair_counts(rows, ids_b), "pairs")
    total = counts.agg(F.sum("links")).first()[0] or 0
    table = counts.filter(F.col("links") > total / most_known).orderBy("pair").toArrow()
    looked = written(_look_up(rows, tuple(table.column(k).to_numpy() for k in ("pair", "links", "best"))), "looked_up")
    rest = (looked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
                  .select("row", F.col("x.pairs").alias("pair"), "x.times").join(counts, "pair")
                  .select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"),
                          (F.col("times") * F.col("links")).alias("count_sum")))
    sums = (looked.select("row", "n_best", "count_sum").unionByName(rest)
                  .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return rows.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
