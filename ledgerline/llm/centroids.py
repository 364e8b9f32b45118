"""Centroid clustering (Lloyd's rounds in whole numbers) with an n-simplex filter.

Components become integers once, and each vector's distances to a few pivots are measured
once. Pivots and a vector span a simplex: the distances give the vector's place in the
pivots' own space (the apex, ``n - 1`` coordinates) and its height over it. For a vector and
a centroid the distance between their places, with the difference of their heights, is a lower
bound of their distance, and with the sum of their heights an upper bound. A centroid whose
lower bound is over the least upper bound cannot be nearest; the others are compared exactly,
as integers.

A round is one pass over the written table: tasks get the centroids (a few kilobytes, as many
as ``clusters`` says) and give back sums per cluster and component, which a partial aggregate
adds. Nothing else is shuffled, so a cluster that holds a third of all rows is a few sums.

Defined results: a vector that is null, has another number of components, or a null or
non-finite one takes no part; neither does one with a component beyond ``MOST`` in size, whose
squared distances would not fit in 64 bits. With fewer vectors than clusters each starts one.
Rows that share an id are vectors of their own; of these, equal hashes at the start are ordered
by components. A null id is no start and is clustered like any other. Equal vectors may start
clusters of which only the first keeps members. An empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written

DIM, CLUSTERS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2"
#: Pivots of the filter (at most; as many as are independent are used).
PIVOTS = 16
#: Largest component, as an integer: squared distances stay below 2**63.
MOST = 1 << 27
#: Vectors that a task compares at a time.
BLOCK = 4096


class Simplex:
    """Places and heights of points over the space that the pivots span."""

    def __init__(self, pivots: np.ndarray):
        self.pivots, base = pivots[:1], np.zeros((0, 0))
        # a pivot that lies (nearly) in the space of those before it would add nothing
        for p in pivots[1:]:
            place, height = self._apex(self.squares(p[None]), base)
            if height[0] > 0.1 * np.sqrt(max(self.squares(p[None])[0, 0], 1.0)):
                base = np.block([[base, np.zeros((len(base), 1))], [place, height[:, None]]])
                self.pivots = np.vstack([self.pivots, p[None]])
        self.base = base

    def squares(self, points: np.ndarray) -> np.ndarray:
        """Exact squared distances to the pivots."""
        return ((points[:, None, :] - self.pivots[None]) ** 2).sum(axis=2)

    def _apex(self, squares: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates follow pivot by pivot from the distances to the first and to that one."""
        squares = squares.astype(np.float64)
        place = np.zeros((len(squares), len(base)))
        for i in range(len(base)):
            left = place[:, :i] @ base[i, :i]
            norm = base[i] @ base[i]
            place[:, i] = ((squares[:, 0] + norm - squares[:, i + 1]) / 2 - left) / base[i, i]
        return place, np.sqrt(np.maximum(squares[:, 0] - (place * place).sum(axis=1), 0))

    def apex(self, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._apex(squares, self.base)


def nearest(x: np.ndarray, place: np.ndarray, height: np.ndarray, centroids: np.ndarray,
            simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), the exact squared distance,
    and how many exact comparisons that took."""
    c_place, c_height = simplex.apex(simplex.squares(centroids))
    flat = ((place * place).sum(axis=1)[:, None] + (c_place * c_place).sum(axis=1)[None] - 2 * place @ c_place.T)
    low = flat + (height[:, None] - c_height[None]) ** 2
    high = flat + (height[:, None] + c_height[None]) ** 2
    # rounding of the bounds is far below this share of the numbers that they are made of
    slack = 1e-7 * (1 + (place * place).sum(axis=1) + height ** 2 + (c_place * c_place).sum(axis=1).max() + (c_height ** 2).max())
    maybe = low <= high.min(axis=1)[:, None] + slack[:, None]
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(maybe[:, j])
        d = ((x[rows] - c) ** 2).sum(axis=1)
        less = d < best[rows]
        best[rows[less]], cluster[rows[less]] = d[less], j
    return cluster, best, int(maybe.sum())


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
             dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x`` (``floor(scale * component)`` each) of the vectors that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    scaled = F.transform(v, lambda c: F.floor(c * scale))
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale))
    return (rows.filter((F.size(v) == dim) & F.coalesce(fits, F.lit(False)))
                .select(F.col(f"`{id_col}`").alias("vec_id"), scaled.alias("x")))


def _batch(b: pa.RecordBatch, dim: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    take = lambda name, width: (b.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                                .reshape(b.num_rows, width))
    return take("x", dim), take("squares", n_pivots)


def with_distances(vectors: DataFrame, simplex: Simplex, dim: int) -> DataFrame:
    """``vec_id``, ``x`` and ``squares``, the squared distances to the pivots, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            squares = np.concatenate([simplex.squares(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)])
            to = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * squares.shape[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("x").cast(pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(to, pa.array(squares.ravel()))], ["vec_id", "x", "squares"])

    id_type = vectors.schema["vec_id"].dataType.simpleString()
    return written(vectors.mapInArrow(run, f"vec_id {id_type}, x array<int>, squares array<long>"), "vectors")


def _assigned(cached: DataFrame, centroids: np.ndarray, simplex: Simplex, sums: bool) -> DataFrame:
    """Either ``vec_id``, ``cluster``, ``distance`` of every vector or, for the next round,
    per task ``cluster``, ``at`` (component; -1: the number of vectors) and ``total``."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                x, squares = _batch(b, dim, len(simplex.pivots))
                cluster, distance, _ = nearest(x, *simplex.apex(squares), centroids, simplex)
                if sums:
                    for j in np.unique(cluster):
                        own = x[cluster == j]
                        total[j] += np.append(len(own), own.sum(axis=0))
                else:
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                     ["vec_id", "cluster", "distance"])
        if sums:
            c, at = np.divmod(np.arange(k * (dim + 1)), dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(total.ravel())],
                                             ["cluster", "at", "total"])

    id_type = cached.schema["vec_id"].dataType.simpleString()
    return cached.mapInArrow(run, "cluster int, at int, total long" if sums else f"vec_id {id_type}, cluster int, distance long")


def moved(cached: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Centroids after one round; an empty cluster's stays."""
    rows = (_assigned(cached, centroids, simplex, True).groupBy("cluster", "at")
            .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    total = {(r["cluster"], r["at"]): int(r["total"]) for r in rows}
    out = centroids.copy()
    for j in range(len(centroids)):
        if n := total.get((j, -1), 0):
            out[j] = [total[j, i] // n for i in range(centroids.shape[1])]
    return out


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM,
            clusters: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT, pivots: int = PIVOTS) -> DataFrame:
    """One row per vector that takes part: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` (distances summed over its cluster and over all),
    ``centroid_sha256``."""
    vectors = integers(rows, id_col, vec_col, dim)
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = (vectors.filter("vec_id IS NOT NULL").select(order.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
             or vectors.select("x").orderBy("x").limit(clusters).collect())
    if not first:
        return (vectors.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in
                                                                      ("distance", "cluster_inertia", "inertia")],
                               F.lit("").alias("centroid_sha256")).filter("false"))
    centroids = np.array([r["x"] for r in first], np.int64)
    simplex = Simplex(centroids[:pivots])
    cached = with_distances(vectors, simplex, dim)
    for _ in range(rounds):
        centroids = moved(cached, centroids, simplex)
    out = written(_assigned(cached, centroids, simplex, False), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in
            out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    # one row per cluster
    per = out.sparkSession.createDataFrame(
        [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
         for j, c in enumerate(centroids)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
