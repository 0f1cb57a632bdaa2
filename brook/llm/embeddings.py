"""Near-duplicate vectors through a forest of random-projection trees with
spill overlap: vectors are compared within leaves, verified and united."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.common import components, partitions_for, ready, scratch
from brook.llm.links import roots

# Trees, vectors that fit the trees, leaf size aimed at, vectors
# of a tile, half width of the overlap in standard deviations of the
# projected difference of a borderline pair, and rows compared at once.
TREES = 5
SAMPLE = 20_000
LEAF = 512
TILE = 4_096
SPILL = 0.5
STRIP = 512
SEED = 20_250_701


def _direction(tree: int, node: int, dim: int) -> np.ndarray:
    v = np.random.default_rng([SEED, tree, node]).standard_normal(dim)
    return v / np.linalg.norm(v)


def fit(sample: np.ndarray, leaf: int, spill: float, trees: int = TREES) -> list[dict[int, float]]:
    """For each tree the inner nodes (root 1, children 2n and 2n + 1) with
    their thresholds: medians of the projections of the sample.  A node stays a
    leaf if it is small, or if a child would keep over nine tenths of it."""
    out = []
    for tree in range(trees):
        nodes: dict[int, float] = {}
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf or node >= 1 << 40:
                continue
            p = sample[rows] @ _direction(tree, node, sample.shape[1])
            cut = float(np.median(p))
            left, right = rows[p < cut + spill], rows[p >= cut - spill]
            if max(len(left), len(right)) > 0.9 * len(rows):
                continue
            nodes[node] = cut
            todo += [(2 * node, left), (2 * node + 1, right)]
        out.append(nodes)
    return out


def leaves(x: np.ndarray, forest: list[dict[int, float]], spill: float) -> list[list[tuple[int, int]]]:
    """The leaves (tree, node) of each row of ``x``; a row within ``spill`` of
    a threshold goes to both sides."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(x))]
    for tree, nodes in enumerate(forest):
        todo = [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node not in nodes:
                for r in rows.tolist():
                    out[r].append((tree, node))
                continue
            p = x[rows] @ _direction(tree, node, x.shape[1])
            todo += [(2 * node, rows[p < nodes[node] + spill]), (2 * node + 1, rows[p >= nodes[node] - spill])]
    return out


def _earlier(trees: pa.ListArray, places: pa.ListArray, tree: int, node: int) -> np.ndarray:
    """For each row the leaves before (tree, node) that it lies in, as bits."""
    row = np.repeat(np.arange(len(trees)), trees.value_lengths().to_numpy())
    t, n = trees.flatten().to_numpy(), places.flatten().to_numpy()
    before = (t < tree) | ((t == tree) & (n < node))
    # A node number takes at most 41 bits, a tree number far fewer than 22.
    codes, at = np.unique(t[before].astype(np.int64) << 41 | n[before], return_inverse=True)
    lies = np.zeros((len(trees), max(1, len(codes))), bool)
    lies[row[before], at] = True
    return np.packbits(lies, axis=1)


def compare(x: np.ndarray, earlier: np.ndarray, first: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile: for each row the weight of the rows it is linked with
    and has not met in an earlier leaf, and the least row it is connected to.
    ``earlier`` holds the leaves before this one that each row lies in.
    ``first`` marks the rows of the first of two blocks (all, if there is one):
    pairs within the second block belong to another tile."""
    links = np.zeros(len(x), np.int64)
    p = np.arange(len(x))
    one = np.flatnonzero(first)
    two = np.arange(len(x)) if first.all() else np.flatnonzero(~first)
    for i in range(0, len(one), STRIP):
        part = one[i:i + STRIP]
        a, b = np.nonzero(x[part] @ x[two].T >= least)
        a, b = part[a], two[b]
        if first.all():
            a, b = a[a < b], b[a < b]
        new = ~(earlier[a] & earlier[b]).any(axis=1)
        a, b = a[new], b[new]
        links += np.bincount(a, weight[b], len(x)).astype(np.int64) + np.bincount(b, weight[a], len(x)).astype(np.int64)
        p = roots(len(x), a, b, p)
    return links, p


def _matrix(column) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """``vec, n_links, component_id`` of every row of ``vectors``.

    Two vectors of the same length are linked if their cosine, in double
    precision, is ``least`` or more; ``n_links`` counts the other rows a row is
    linked with, ``component_id`` is the smallest id reachable over links,
    itself included.

    The forest is fitted to at most ``sample`` vectors for each length (chosen
    by hash); every vector is then put into its leaves, in each tree one or,
    near a threshold, more.  All pairs of a leaf are compared and verified; a
    pair counts in the first leaf it shares, so nothing is counted twice and no
    list of pairs is made: a tile sends one row per linked vector.  A leaf that
    cannot be split (a third of all vectors may be near copies) is compared in
    tiles of two blocks.  Pairs that no tree brings together are missed; tests
    hold the share found at over 0.99.

    Equal vectors are one node with a weight.  Vectors that are null, zero or
    hold null or non-finite components have no links and are a component of
    their own.  A null id takes part but is never the smallest; rows that
    repeat an id are separate rows.  Other columns are not read.  An empty
    table gives an empty result."""
    spark = ready(vectors)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists(v, lambda x: x != 0), F.lit(False))
    # Components keep their precision; adding zero makes one zero of both.
    kind = "float" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"),
                          F.when(sound, F.transform(F.col(vector_col), lambda x: x.cast(kind) + F.lit(0).cast(kind))).alias("v"))
    rows = rows.withColumn("key", F.xxhash64("v"))
    nodes = (rows.where("v IS NOT NULL").groupBy("key", "v").agg(F.min("vec").alias("first"), F.count("*").alias("weight"))
             .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    nodes = scratch(nodes, "vector-nodes", spark)
    # One forest for each vector length (few lengths: a column of one model).
    forests, spills = {}, {}
    for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        dim, n = r["dim"], r["n"]
        some = nodes.where(F.col("dim") == dim).orderBy(F.xxhash64("node")).limit(sample).select("v").toArrow()
        x = _matrix(some.column("v"))
        spills[dim] = SPILL * float(np.sqrt(2 - 2 * least) / np.sqrt(dim))
        forests[dim] = fit(x, max(8, LEAF * len(x) // n), spills[dim])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in set(b.column("dim").to_pylist()):
                part = b.filter(pa.compute.equal(b.column("dim"), dim))
                found = leaves(_matrix(part.column("v")), forests[dim], spills[dim])
                tree = [[t for t, _ in x] for x in found]
                leaf = [[n for _, n in x] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("node", "weight", "v", "dim")]
                    + [pa.array(tree, pa.list_(pa.int32())), pa.array(leaf, pa.list_(pa.int64()))],
                    ["node", "weight", "v", "dim", "tree", "leaf"])

    placed = scratch(nodes.select("node", "weight", "v", "dim").mapInArrow(
        put, f"node long, weight long, v array<{kind}>, dim int, tree array<int>, leaf array<long>"), "vector-leaves", spark)
    every = placed.select("*", F.explode(F.arrays_zip("tree", "leaf")).alias("at")).select(
        "node", "weight", "v", "dim", "tree", "leaf", F.col("at.tree").alias("in_tree"), F.col("at.leaf").alias("in_leaf"))
    place = ["dim", "in_tree", "in_leaf"]
    blocks = every.groupBy(*place).agg(F.count("*").alias("n")).select(
        *place, F.ceil(F.col("n") / TILE).cast("int").alias("n_blocks"))
    tiles = (every.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}))

    def links(key: tuple, t: pa.Table) -> pa.Table:
        _, tree, node, one, _ = (k.as_py() for k in key)
        earlier = _earlier(t.column("tree").combine_chunks(), t.column("leaf").combine_chunks(), tree, node)
        n, p = compare(_matrix(t.column("v")), earlier, t.column("block").to_numpy() == one, t.column("weight").to_numpy(), least)
        some = np.flatnonzero(n)
        ids = t.column("node").to_numpy()
        return pa.table({"a": pa.array(ids[some], pa.int64()), "b": pa.array(ids[p[some]], pa.int64()),
                         "n": pa.array(n[some], pa.int64())})

    found = scratch(tiles.select("node", "weight", "v", "tree", "leaf", "block", *place, "one", "two")
                    .repartition(partitions_for(spark), *place, "one", "two")
                    .groupBy(*place, "one", "two").applyInArrow(links, "a long, b long, n long"), "vector-links", spark)
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    joined = components(found.select("a", "b"))
    least_id = nodes.select("node", "first").join(joined, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch(nodes.select("node", "key", F.col("v").alias("v2"), "first", "weight")
                    .join(counts, "node", "left").join(joined, "node", "left").join(least_id, "component", "left")
                    .select(F.col("key").alias("key2"), "v2",
                            (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                            F.coalesce("component_id", "first").alias("component_id")), "vector-named", spark)
    return (rows.join(named, (rows["key"] == named["key2"]) & (rows["v"] == named["v2"]), "left")
            .select("vec", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec").alias("component_id")))
