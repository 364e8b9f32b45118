"""Exact dedup, line dedup, SimHash near-dedup, substring dedup and components."""
import hashlib
import random

import pytest
from brute import components as brute_components
from brute import near_groups, without_repeats
from pyspark.sql import functions as F

from ledgerline.llm import components, exact_dedup, line_dedup, simhash, substring

SCHEMA = "doc_id long, text string, source string, digest int, fp string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)


ODD = [(1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (6, "A"), (None, "z"), (None, "z"), (7, "long " * 30000)]


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact_groups(spark, heavy):
    got = exact_dedup.groups(table(spark, ODD), heavy=heavy).collect()
    by = {}
    for i, t in ODD:
        by.setdefault(t or "", []).append(i)
    assert len(got) == len(ODD)
    for r in got:
        text = next(t for t in by if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
        ids = [i for i in by[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(by[text]))
    assert sum(r.kept for r in got) == len(by)


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact_drop_keeps_one_row_and_all_columns(spark, heavy):
    docs = table(spark, ODD)
    out = exact_dedup.drop_copies(docs, heavy=heavy)
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((r.text or "")[:9] for r in got) == sorted({(t or "")[:9] for _, t in ODD})
    assert {r.text: r.doc_id for r in got}["a"] == 2


def test_frequent_finds_the_large_groups(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    top = exact_dedup.frequent(exact_dedup._tagged(docs), heavy=8, tracked=64).collect()
    assert [(r["size"], r.winner.doc_id) for r in top] == [(1000, 2997)]


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.drop_copies(docs).count() == 0
    assert line_dedup.drop_lines(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0
    assert substring.drop_repeats(docs).count() == 0


def test_line_dedup_edges(spark):
    line = "This line is long enough to be looked at, yes"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nend") for i in range(5)] + \
        [(10, None), (11, ""), (12, "\n\n"), (13, "short\nshort"), (14, line[:39]), (None, line), (None, line)]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(table(spark, rows)).collect()}
    for i in range(4):
        assert got[i, f"own {i}\nend"] == (3, 1)
    assert got[4, rows[4][1]] == (3, 0)          # the largest id keeps its copy
    assert got[10, ""] == (1, 0) and got[11, ""] == (1, 0) and got[12, "\n\n"] == (3, 0) and got[14, line[:39]] == (1, 0)
    assert got[None, ""] == (1, 1)               # rows that repeat id and text count once and lose it alike
    few = line_dedup.drop_lines(table(spark, rows[:4])).collect()
    assert sum(r.n_dropped for r in few) == 0    # four documents are below the threshold


def _texts(seed, n):
    """Texts with copies, near copies and unrelated ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(n)]
    for t in list(base[:n // 2]):
        w = t.split()
        for _ in range(4):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = rng.choice(words)
            base.append(" ".join(v))
    return [(i, t) for i, t in enumerate(base)] + [(9000, None), (9001, "two words"), (9002, "TWO  words\n"), (None, base[0])]


def test_simhash_against_brute_force(spark):
    rows = _texts(1, 30)
    want = near_groups(rows)
    got = simhash.groups(table(spark, rows)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), F.col("first.doc_id")).collect()
    key = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert len({w[2] for w in want}) < len({w[1] for w in want})      # some links are between different fingerprints
    kept = simhash.drop_near_copies(table(spark, rows + rows[:3])).collect()
    assert sorted(r.doc_id for r in kept) == sorted({w[2] for w in want})


@pytest.mark.parametrize("bits,segments", [(3, 2), (3, 4), (2, 2), (0, 2), (4, 2)])
def test_links_lose_none(spark, bits, segments):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(20)] + [0, 2**64 - 1, 2**63]
    fps = set(base)
    for b in base:
        for k in range(1, 6):
            fps.add(b ^ sum(1 << x for x in rng.sample(range(64), k)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= bits}
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, segments).collect()
    assert {tuple(sorted(map(int, r))) for r in got} == want


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 60
    links = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "none": [],
             "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(45)]}[shape]
    want = brute_components(n, links)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


@pytest.mark.parametrize("part", [2, 2000])
def test_substring_against_brute_force(spark, part):
    rng = random.Random(part)
    words = [f"w{i}" for i in range(30)]
    passage = " ".join(rng.choices(words, k=12))
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(20)]
    rows += [(100 + i, f"{' '.join(rng.choices(words, k=5))}  {passage}\n{' '.join(rng.choices(words, k=5))}") for i in range(9)]
    rows += [(200, "und " * 50), (201, None), (202, ""), (203, rows[3][1]), (204, "a b c d e f g"), (204, "a b c d e f g"), (None, passage)]
    got = substring.drop_repeats(table(spark, rows), window=7, gram=3, part=part).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(without_repeats(rows, 7), key=key)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(5)
    words = [b"w%d" % rng.randrange(4) for _ in range(300)]
    at, h = substring.window_anchors(words, 9, 3)
    seen = {}
    for i in range(len(words) - 8):
        assert h[at[i]] == min(h[i:i + 7]) and i <= at[i] < i + 7
        assert seen.setdefault(tuple(words[i:i + 9]), at[i] - i) == at[i] - i


def test_stretch_labels_do_not_depend_on_the_place():
    a, b = [b"x", b"y", b"z", b"x", b"y"], [b"q"] * 300 + [b"x", b"y"]
    import numpy as np
    one = substring.stretch_labels(a, np.array([0, 3, 0, 1]), np.array([2, 5, 3, 3]))
    two = substring.stretch_labels(b, np.array([300, 299]), np.array([302, 301]))
    assert one[0] == one[1] == two[0] and len({int(x) for x in (*one, *two)}) == 4


def test_hundreds_of_equally_large_groups(spark):
    """Of 300 groups none is left to the shuffle with production settings; with few winners all
    others are, with the same result."""
    docs = spark.range(9_300).select(F.col("id").alias("doc_id"),
                                     F.when(F.col("id") < 9_000, F.concat(F.lit("text "), (F.col("id") % 300).cast("string")))
                                      .otherwise(F.concat(F.lit("single "), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.groups(docs)
    assert got.filter("NOT is_heavy AND group_size > 1").isEmpty()
    want = {(i, i if i >= 9_000 else 8_700 + i % 300, 1 if i >= 9_000 else 30) for i in range(9_300)}
    for rows in (got, exact_dedup.groups(docs, heavy=4, tracked=64)):
        assert {(r.doc_id, r.keep_id, r.group_size) for r in rows.collect()} == want
    assert exact_dedup.drop_copies(docs, heavy=4, tracked=64).count() == 600
