"""Embedding near-dedup and centroid clustering against brute force."""
import hashlib
import math

import numpy as np
import pytest
from brute import components

from ledgerline.llm import centroids, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vec string, n int, x string"


def table(spark, rows, parts=4):
    """Columns beside id and vector have names that the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 7, "x", 1, "y")
                                  for i, v in rows], SCHEMA).repartition(parts)


def groups(rng, sizes, dim=64, noise=0.015, singles=300):
    out = [rng.standard_normal(dim) for _ in range(singles)]
    for s in sizes:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        out += [c + noise * rng.standard_normal(dim) for _ in range(s)]
    return [np.float32(v) for v in out]


def brute(rows, cosine=0.95):
    """Pairs of positions that link."""
    fine = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(c for c in v)
            for _, v in rows]
    out = []
    by = {}
    for i, (_, v) in enumerate(rows):
        if fine[i]:
            by.setdefault(len(v), []).append(i)
    for ids in by.values():
        x = np.array([rows[i][1] for i in ids], np.float32).astype(float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)))]
    return out


def expected(rows, pairs):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    at = {i: k for k, i in enumerate(order)}
    comp = components(len(rows), [(at[a], at[b]) for a, b in pairs])
    n = np.bincount([i for p in pairs for i in p], minlength=len(rows))
    first = [rows[order[comp[at[i]]]][0] for i in range(len(rows))]
    return sorted([(rows[i][0], int(n[i]), first[i], rows[i][0] == first[i]) for i in range(len(rows))], key=repr)


def result(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=repr)


def links(rows):
    return sum(r[1] for r in rows) / 2


@pytest.mark.parametrize("block", [4096, 64], ids=["whole buckets", "cores and blocks"])
def test_near_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    vectors = groups(rng, [2, 3, 5, 40, 300]) + groups(rng, [], dim=8, singles=40)
    vectors += [vectors[310] for _ in range(90)]  # copies
    rows = [(1000 + i, v) for i, v in enumerate(vectors)]
    want, got = expected(rows, brute(rows)), result(embeddings.near(table(spark, rows), block=block))
    assert [r[0] for r in got] == [r[0] for r in want]
    # none below the threshold, at least nine in ten of the others
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert links(got) >= 0.97 * links(want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(rows)


def test_near_recall_close_to_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):  # pairs at a cosine just over 0.95
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        rows += [(2 * k, a), (2 * k + 1, 0.951 * a + math.sqrt(1 - 0.951 ** 2) * b)]
    found = links(result(embeddings.near(table(spark, rows), bucket=8)))
    assert links(expected(rows, brute(rows))) >= 400
    assert found >= 0.95 * 400


def test_near_edges(spark):
    one = [1.0] + [0.0] * 63
    rows = [(5, one), (5, one), (None, one), (9, [2.0] + [0.0] * 63), (7, None), (8, []), (10, [0.0] * 64),
            (11, [math.nan] * 64), (12, [math.inf] + [0.0] * 63), (13, [None] + [1.0] * 63), (14, one[:32]), (15, [1e-30] + [0.0] * 63),
            (16, [-1.0] + [0.0] * 63), (None, None), (17, [1e30] + [-0.0] * 63)]
    got = result(embeddings.near(table(spark, rows)))
    want = expected(rows, brute(rows))
    assert got == sorted([(r if r[0] is not None else (None, r[1], r[2], r[0] == r[2])) for r in want], key=repr)
    assert embeddings.near(table(spark, [])).collect() == []


def test_design_reaches_the_recall():
    for nodes in (1, 100, 10**5, 10**8, 10**11):
        bits, tables = embeddings.design(nodes)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - meet) ** tables >= 0.99 and nodes / 2 ** bits <= 64 * 2


def lloyd(rows, k=40, rounds=5, dim=64, salt="2"):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    h = lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    cents = [x for _, x in sorted((r for r in kept if r[0] is not None), key=lambda r: (h(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        by = {}
        for (_, x), (_, j) in zip(kept, assign()):
            by.setdefault(j, []).append(x)
        cents = [[sum(col) // len(by[j]) for col in zip(*by[j])] if j in by else c for j, c in enumerate(cents)]
    last = assign()
    inertia = {j: sum(d for d, i in last if i == j) for j in range(len(cents))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last)], key=repr)


def clusters(df):
    return sorted([tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=repr)


def test_clusters_against_lloyd(spark):
    rng = np.random.default_rng(7)
    vectors = groups(rng, [30, 5], dim=6, singles=60) + [np.zeros(6)] * 20 + groups(rng, [], dim=5, singles=3)
    rows = [(i // 2, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (None, None), (900, [None] * 6), (901, [math.nan] * 6)]
    rows += [(902, [math.inf] + [0.0] * 5), (903, [])]
    df = centroids.cluster(table(spark, rows), dim=6, clusters=9, pivots=4)
    assert clusters(df) == lloyd(rows, k=9, dim=6)


def test_clusters_empty_few_and_large(spark):
    assert centroids.cluster(table(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(table(spark, [])).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [300000.0, -300000.0]), (4, [1e30, 0.0])]
    assert clusters(centroids.cluster(table(spark, rows), dim=2)) == lloyd(rows[:3], dim=2)
    rows = [(None, [1.0, 2.0]), (None, [3.0, 2.0])]
    assert len(clusters(centroids.cluster(table(spark, rows), dim=2))) == 2


def test_simplex_bounds_hold_and_filter():
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (12, 64))
    x = np.concatenate([c + rng.integers(-20, 20, (50, 64)) for c in centers])
    cents = centers + rng.integers(-5, 5, centers.shape)
    s = centroids.Simplex(np.concatenate([centers[:8], centers[:2]]))
    assert len(s.pivots) == 8  # repeated pivots add nothing
    (p, h), (cp, ch) = s.apex(s.squares(x)), s.apex(s.squares(cents))
    true = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    flat = ((p[:, None] - cp[None]) ** 2).sum(axis=2)
    assert (flat + (h[:, None] - ch[None]) ** 2 <= true + 1e-3).all() and (true <= flat + (h[:, None] + ch[None]) ** 2 + 1e-3).all()
    cluster, distance, compared = centroids.nearest(x, p, h, cents, s)
    assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert compared < 0.5 * true.size
