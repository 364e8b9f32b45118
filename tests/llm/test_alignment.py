"""Cross-tokenizer alignment against brute force over the tokenizers' own output."""
import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL

from ledgerline.llm import alignment
from ledgerline.llm.queries import QUERIES

FOLDER = alignment.TOKENIZERS


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/{alignment.BYTE_LEVEL}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/{alignment.PIECES}")
    letters = alignment.byte_alphabet()
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i)),
            lambda t: b.encode(t), piece)


def brute(texts, coders):
    encode_a, bytes_a, encode_b, bytes_b = coders
    docs = []
    for t in texts:
        spans = []
        for encode, own in ((encode_a, bytes_a), (encode_b, bytes_b)):
            ids, at, side = encode(t) if t else [], 0, []
            for i in ids:
                side.append((i, at, at + len(own(i))))
                at += len(own(i))
            spans.append(side)
            if t and b"".join(own(i) for i in ids) != (" " + t).encode():
                spans = [[], []]
                break
        a, b = spans
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        links, low = [], 0
        for i, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            k = low
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        groups = []
        for s, e in zip([0, *common], common):
            groups.append("|".join(",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in (a, b)))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        docs.append((len(a), len(b), len(common), links, digest))
    count = Counter(x for d in docs for x in d[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, ng, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), h) for na, nb, ng, ls, h in docs]


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


ODD = [None, "", " ", "a", "  a  b ", "a ", "\t x  y", "<s> </s> <unk> <|endoftext|>", "é é x ▁ ▁x a▁ b", "　 a b", "x\x1c y \x85 z",
       "don't 's 'll  'll x' s", "日本語 テキスト 混ざる", "🙂 🙂🙂 a 🙂", "\x00 \x01a b", "ﬁ ﬀ x ½ ² a", "a\n b\n\n c\r\n d", "<0x41> A",
       "of the people " * 50, "of the people " * 50, "of the", "x" * 3000, "word " * 20000, "İ ı ß ẞ é a"]


@pytest.mark.parametrize("known", [alignment.MOST_KNOWN, 20], ids=["all looked up", "rare pairs joined"])
def test_odd_texts(spark, coders, known):
    ids = [None, 3, 3] + [i % 7 for i in range(len(ODD) - 3)]  # null and repeated ids
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, ODD)], "doc_id long, text string, row int, pairs string").repartition(3)
    got = rows_of(alignment.alignment(df, most_known=known))
    assert got == sorted([(i, *r) for i, r in zip(ids, brute(ODD, coders))], key=repr)


def test_small_chunks(spark, coders, monkeypatch):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    rows, _ = alignment.aligned(df, chunk=10)
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in rows.collect())
    assert got == [(i, *r[:4], r[6]) for i, r in enumerate(brute(ODD, coders))]


def test_query_against_brute_force(spark, coders):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    df = QUERIES["op13_alignment"](spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(df) == sorted([(d, *r) for (d, _), r in zip(docs, brute([t for _, t in docs], coders))], key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(df).collect() == []


def test_words_are_forgotten(coders, monkeypatch):
    read = lambda name: open(f"{FOLDER}/{name}", "rb").read()
    monkeypatch.setattr(alignment, "MOST_WORDS", 50)
    words = alignment.Words(alignment.byte_level_coder(read(alignment.BYTE_LEVEL)), alignment.piece_coder(read(alignment.PIECES)))
    for k in range(5):
        texts = [f"word{i} and w{i * k}" for i in range(40)]
        ids_a, ids_b, n_a, n_b = words.tokens(texts)
        assert ids_a.tolist() == [i for t in texts for i in coders[0](t)] and ids_b.tolist() == [i for t in texts for i in coders[2](t)]
        assert len(words) < 150


@pytest.mark.parametrize("stride", [1, 2, 16, 1000])
def test_gallop(stride):
    rng = np.random.default_rng(stride)
    for _ in range(50):
        long, short = (np.unique(rng.integers(0, 1000, int(rng.integers(0, 400)))) for _ in range(2))
        assert (alignment.gallop(short, long, stride) == np.searchsorted(long, short)).all()
