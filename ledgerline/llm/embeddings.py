"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine
verification, and connected components by star rounds.

A table's key is the signs of a vector against ``k`` random hyperplanes. Vectors at the
threshold's angle share a key with probability ``p ** k``; ``k`` follows the number of
vectors, so that an even bucket holds about ``BUCKET`` of them, and the number of tables
follows from ``k``, so that such a pair meets in some table with probability ``RECALL`` (closer
pairs with a higher one). Every pair that meets is verified in double precision, and counted in
the first table in which it meets: the tasks know the keys of all tables.

Equal vectors are one node with a weight. No pair leaves a task: a block of a bucket gives
each node the number of its links and the root of its tree in the block, and the trees together
connect what the links connect.

A bucket of more than ``BLOCK`` nodes is cut into blocks. Its pivot (one of its nodes) names a
core: nodes within half the threshold's angle of it. Any two nodes of a core are within the
whole angle, so their links are counted by the core's weight and never compared, however many
there are: a third of all rows that are near copies of each other costs a core, not its pairs.
What is not of one core is compared block by block, each pair of blocks a group of its own.

Defined results: a vector that is null or empty, holds a null or non-finite component, or is
zero links with nothing; vectors of different lengths do not link. Rows that share an id are
vectors of their own. A null id is larger than any other; a component of null ids only has a
null ``component_id``, and a null id is kept there. An empty table gives no rows; other columns
are not read. Vectors are told apart by 128 bits of hashes when rows get their node's result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import written
from ledgerline.llm.components import components

COSINE, RECALL, BUCKET, BLOCK, SEED = 0.95, 0.99, 64, 1024, 11
#: Fewest and most signs of a key.
FEWEST, MOST = 4, 40
#: A vector that is more than 1 in ``HOT`` rows gets its result on the map side; there are fewer than ``HOT``.
HOT = 1024


def design(nodes: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs of a key and number of tables."""
    bits = min(max(math.ceil(math.log2(max(nodes, 1) / bucket)), FEWEST), MOST)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of one length as double vectors of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> list[np.ndarray]:
    """Positions of the vectors of each length."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return [np.flatnonzero(size == d) for d in np.unique(size)]


def comparable(vec: Column) -> Column:
    """Whether a vector has a direction."""
    fine = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda c: c != 0), F.lit(False))


def signed(nodes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """``node``, ``n``, ``vec`` and ``keys``, one per table: its signs and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            keys = np.zeros((b.num_rows, tables), np.int64)
            for at in _by_length(b.column("vec")):
                x = _unit(b.column("vec").take(pa.array(at)))
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                sign = (x @ planes[d] > 0).reshape(len(at), tables, bits)
                keys[at] = (sign << np.arange(bits)).sum(axis=2) + (d << bits)
            to = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("n"), b.column("vec"), pa.ListArray.from_arrays(to, pa.array(keys.ravel()))],
                ["node", "n", "vec", "keys"])

    vec = nodes.schema["vec"].dataType.simpleString()
    return written(nodes.select("node", "n", "vec").mapInArrow(run, f"node long, n long, vec {vec}, keys array<long>"), "signed")


def _forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest position that each is connected to by the pairs ``i``, ``j``."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(table: int, node: np.ndarray, n: np.ndarray, core: np.ndarray, keys: np.ndarray, x: np.ndarray,
            side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block of table ``table``, or of two (``side`` 0 and 1): nodes that have
    any, how many (weighted), and the root of their tree."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(b)
    i, j = np.nonzero(x[a] @ x[a if alone else b].T >= cosine)
    i, j = (a[i[i < j]], a[j[i < j]]) if alone else (a[i], b[j])
    # pairs of one core are counted by its weight, pairs that met before were counted there
    new = ((core[i] < 0) | (core[i] != core[j])) & ~(keys[i, :table] == keys[j, :table]).any(axis=1)
    i, j = i[new], j[new]
    links = np.zeros(len(node), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    root = _forest(i, j, len(node))
    have = np.flatnonzero(links)
    return node[have], links[have], node[root[have]]


def found(parts: DataFrame, cosine: float) -> DataFrame:
    """``node``, ``links``, ``root`` of each block, or pair of blocks, of each bucket: rows that
    share ``t``, ``key`` and ``part``. Groups stream through a task one by one."""

    def group(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        col = lambda name: t.column(name).to_numpy()
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        out = compare(t.column("t")[0].as_py(), col("node"), col("n"), col("core"), keys,
                      _unit(t.column("vec").combine_chunks()), col("side"), cosine)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in out], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            name = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("t", "key", "part")], axis=1)
            starts = [0, *(np.flatnonzero((np.diff(name, axis=0) != 0).any(axis=1)) + 1).tolist(), len(name)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if i == j:
                    continue
                this = tuple(name[i].tolist())
                if held and this != last:
                    yield group(held)
                    held = []
                held.append(b.slice(i, j - i))
                last = this
        if held:
            yield group(held)

    return (parts.repartition("t", "key", "part").sortWithinPartitions("t", "key", "part")
                 .mapInArrow(run, "node long, links long, root long"))


def _cores(hot: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """``node``, ``core``: nodes within half the angle of a pivot (the smallest one's node id),
    with one pivot for each hot bucket."""
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    pick = F.min(F.struct(F.xxhash64("node", "t"), "node"))
    pivots = hot.groupBy("t", "key").agg(pick["node"].alias("core"))
    near = (hot.select("t", "key", "node").join(pivots, ["t", "key"]).select("node", "core").distinct()
               .join(nodes.select("node", "vec"), "node")
               .join(nodes.select(F.col("node").alias("core"), F.col("vec").alias("pivot")), "core"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _by_length(b.column("vec")):
                own = b.take(pa.array(at))
                close = (_unit(own.column("vec")) * _unit(own.column("pivot"))).sum(axis=1) >= half
                yield own.select(["node", "core"]).filter(pa.array(close))

    vec = nodes.schema["vec"].dataType.simpleString()
    slim = near.select("node", "core", "vec", F.col("pivot").cast(vec).alias("pivot"))
    return slim.mapInArrow(run, "node long, core long").groupBy("node").agg(F.min("core").alias("core"))


def _parts(nodes: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all blocks to compare (``t``, ``key``, ``part``, ``side`` and the node's columns),
    and ``node``, ``core`` of the cores, if there are any."""
    keyed = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    hot = written(keyed.groupBy("t", "key").count().filter(F.col("count") > block).select("t", "key"), "hot_buckets")
    plain = nodes.select("node", "n", "keys", "vec", F.lit(-1).cast("long").alias("core"))
    whole = lambda df: df.select("*", F.posexplode("keys").alias("t", "key"))
    one = [F.lit(0).cast("long").alias("part"), F.lit(0).alias("side")]
    if hot.isEmpty():
        return whole(plain).select("*", *one), None
    in_hot = written(keyed.join(hot, ["t", "key"]), "hot_rows")
    cores = written(_cores(in_hot, nodes, cosine), "cores")
    cored = written(plain.drop("core").join(cores, "node", "left")
                         .withColumn("core", F.coalesce("core", F.lit(-1).cast("long"))), "cored")
    # blocks of a hot bucket: those of each of its cores, and those of the other nodes (core -1)
    slim = in_hot.join(cored.select("node", "core"), "node")
    units = written(slim.groupBy("t", "key", "core").agg(F.ceil(F.count("*") / block).alias("blocks")), "units")
    a, b = (units.select("t", "key", F.col("core").alias(f"core_{s}"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(f"block_{s}")) for s in "ab")
    later = (F.col("core_a") < F.col("core_b")) | ((F.col("core_a") == F.col("core_b")) & (F.col("core_a") < 0)
                                                   & (F.col("block_a") <= F.col("block_b")))
    pairs = written(a.join(b, ["t", "key"]).filter(later)
                     .select("*", (F.monotonically_increasing_id() + 1).alias("part")), "block_pairs")
    self_pair = (F.col("core_a") == F.col("core_b")) & (F.col("block_a") == F.col("block_b"))
    sides = (pairs.select("t", "key", F.col("core_a").alias("core"), F.col("block_a").alias("block"), "part", F.lit(0).alias("side"))
                  .unionByName(pairs.filter(~self_pair).select("t", "key", F.col("core_b").alias("core"),
                                                               F.col("block_b").alias("block"), "part", F.lit(1).alias("side"))))
    placed = (slim.join(units, ["t", "key", "core"])
                  .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
                  .join(sides, ["t", "key", "core", "block"]).select("node", "t", "key", "part", "side"))
    split = cored.join(placed, "node")
    # each node's own hot tables, at most as many as there are tables
    of_node = in_hot.groupBy("node").agg(F.collect_set("t").alias("hot"))
    cold = (whole(cored.join(of_node, "node", "left"))
            .filter(F.col("hot").isNull() | ~F.array_contains("hot", F.col("t"))).drop("hot").select("*", *one))
    return cold.unionByName(split), cores


def near(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
         recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row: ``vec_id``, ``n_links`` (other rows linked directly), ``component_id``
    (the smallest id reachable, its own included), ``kept`` (its id is that one)."""
    v = F.col("vec")
    own = written(rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vec"))
                      .select("vec_id", comparable(v).alias("there"), F.xxhash64("vec").alias("k1"),
                              F.xxhash64(F.lit(1), "vec").alias("k2"), F.when(comparable(v), v).alias("vec")), "vectors")
    nodes = written(own.filter("there").groupBy("vec", "k1", "k2").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
                       .select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    bits, tables = design(nodes.count(), cosine, recall, bucket)
    parts, cores = _parts(signed(nodes, bits, tables), cosine, block)
    links = written(found(parts, cosine), "links")
    count = links.select("node", "links")
    edges = links.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if cores is not None:
        weighed = cores.join(nodes.select("node", "n"), "node")
        weight = weighed.groupBy("core").agg(F.sum("n").alias("weight"))
        count = count.unionByName(weighed.join(weight, "core").select("node", (F.col("weight") - F.col("n")).alias("links")))
        edges = edges.unionByName(cores.select(F.col("node").alias("a"), F.col("core").alias("b")))
    count = count.groupBy("node").agg(F.sum("links").alias("links"))
    comp = written(components(edges), "components")
    first = comp.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("of_all"))
    linked = comp.join(first, "label").select("node", "of_all", F.lit(True).alias("linked"))
    # a component of null ids only has a null first id
    final = written(nodes.drop("vec").join(count, "node", "left").join(linked, "node", "left").select(
        "k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        F.when(F.col("linked"), F.col("of_all")).otherwise(F.col("first")).alias("first")), "results")
    slim = own.filter("there").select("vec_id", "k1", "k2")
    total = final.agg(F.sum("n")).first()[0] or 0
    hot = final.filter(F.col("n") > total / HOT).select("k1", "k2", F.col("links").alias("hot_links"), F.col("first").alias("hot_first"))
    split = slim.join(F.broadcast(hot), ["k1", "k2"], "left")
    rest = (split.filter("hot_links IS NULL").select("vec_id", "k1", "k2")
                 .join(final.filter(F.col("n") <= total / HOT).drop("n"), ["k1", "k2"]))
    out = (split.filter("hot_links IS NOT NULL").select("vec_id", F.col("hot_links").alias("n_links"), F.col("hot_first").alias("component_id"))
           .unionByName(rest.select("vec_id", F.col("links").alias("n_links"), F.col("first").alias("component_id")))
           .unionByName(own.filter("NOT there").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                       F.col("vec_id").alias("component_id"))))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
