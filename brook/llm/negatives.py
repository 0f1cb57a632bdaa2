"""Hard negatives through segment summaries: the mean and deviation of each
vector segment bound every inner product from both sides, and only pairs that
the bounds leave open are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brook.llm.common import NO_ID, partitions_for, ready, scratch

# Segments of a vector at each level of refinement (each level
# cuts those before into four), rows and anchors of a tile, components of each
# that a tile holds at most, anchors at once.
LEVELS = (1, 4, 16)
ROWS = 8_192
ANCHORS = 1_024
COMPONENTS = 4_000_000
STRIP = 64

# Fixed value: relative width that the bounds are given for rounding.
ROUNDING = 1e-9


def edges(dim: int, segments: int) -> np.ndarray:
    """Borders of the segments; those of a level are borders of all finer ones."""
    finest = np.arange(LEVELS[-1] + 1) * dim // LEVELS[-1]
    return finest[::LEVELS[-1] // segments]


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (the root of the summed squared differences from the
    mean) of the finest segments of each row; zero for a segment without
    components."""
    at = edges(x.shape[1], LEVELS[-1])
    mean, dev = np.zeros((len(x), LEVELS[-1])), np.zeros((len(x), LEVELS[-1]))
    for k, (i, j) in enumerate(zip(at, at[1:], strict=False)):
        if j > i:
            mean[:, k] = x[:, i:j].mean(axis=1)
            dev[:, k] = np.sqrt(((x[:, i:j] - mean[:, k:k + 1]) ** 2).sum(axis=1))
    return mean, dev


class Summaries:
    """Summaries of many rows at every level, the coarser ones from the finest."""

    def __init__(self, dim: int, mean: np.ndarray, dev: np.ndarray):
        size = np.diff(edges(dim, LEVELS[-1])).astype(float)
        total, squares = mean * size, dev ** 2 + mean ** 2 * size
        self.norm = np.sqrt(squares.sum(axis=1))
        self.mean, self.dev = [], []
        for n in LEVELS:
            fold = lambda y: y.reshape(len(y), n, -1).sum(axis=2)  # noqa: B023, E731
            length = np.maximum(fold(size[None, :]), 1)
            t = fold(total)
            # Scaled by the root of the length: a product of two is that of
            # the means times the length.
            self.mean.append(t / np.sqrt(length))
            self.dev.append(np.sqrt(np.maximum(fold(squares) - t ** 2 / length, 0)))

    def bounds(self, level: int, mine: np.ndarray, other: Summaries, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of the rows ``mine`` with ``theirs``
        of ``other``: over each segment the product of the means, plus or minus
        that of the deviations."""
        middle = self.mean[level][mine] @ other.mean[level][theirs].T
        width = self.dev[level][mine] @ other.dev[level][theirs].T
        width += ROUNDING * self.norm[mine][:, None] * other.norm[theirs][None, :] + ROUNDING
        return middle - width, middle + width


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles while no partial sum
    can pass 2 ** 53 (it is at most the product of the norms), else in longs."""
    most = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0)))
    if most(a) * most(b) < 2.0 ** 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _greatest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row (the least value if there are fewer)."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, -k] if k <= x.shape[1] else np.full(len(x), -np.inf)


def best(a: np.ndarray, sa: Summaries, mine: np.ndarray, b: np.ndarray, sb: Summaries, open_: np.ndarray,
         windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[int, int, int, int]]:
    """For each row i of ``mine`` and each window w, the k best-scored columns
    among the ``open_`` ones (a mask) with a score in ``[low[i], high[i]]``, as
    ``(i, w, column, score)``; earlier columns first among equal scores.

    A pair is given up when its bounds leave the window, or when k others are
    sure to be in the window with scores above its upper bound.  A level of
    finer segments is taken for the columns that are still open for some row."""
    keep = [open_.copy() for _ in windows]
    cols = np.arange(len(b))
    for level in range(len(LEVELS)):
        some = np.logical_or.reduce(keep).any(axis=0)
        cols, keep = cols[some], [x[:, some] for x in keep]
        if not len(cols):
            return
        least, most = sa.bounds(level, mine, sb, cols)
        for x, (low, high) in zip(keep, windows, strict=True):
            sure = np.where(x & (least >= low[:, None]) & (most <= high[:, None]), least, -np.inf)
            x &= (most >= np.maximum(low, _greatest(sure, k))[:, None]) & (least <= high[:, None])
    some = np.logical_or.reduce(keep).any(axis=0)
    cols, keep = cols[some], [x[:, some] for x in keep]
    score = products(a[mine], b[cols])
    for w, (x, (low, high)) in enumerate(zip(keep, windows, strict=True)):
        x &= (score >= low[:, None]) & (score <= high[:, None])
        for i in np.flatnonzero(x.any(axis=1)):
            at = np.flatnonzero(x[i])
            if len(at) > k:
                at = at[score[i, at] >= np.partition(score[i, at], len(at) - k)[-k]]
            for c in at[np.argsort(-score[i, at], kind="stable")][:k]:
                yield int(i), w, int(cols[c]), int(score[i, c])


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    x = column.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(x), -1)


def _side(t: pa.Table) -> tuple[pa.Table, np.ndarray, Summaries]:
    """Rows of a tile by id (a missing one last), their vectors and summaries."""
    vec = t.column("vec").combine_chunks()
    order = np.lexsort((t.column("row").to_numpy(), vec.fill_null(NO_ID).to_numpy(), vec.is_null().to_numpy(zero_copy_only=False)))
    t = t.take(pa.array(order))
    x = _matrix(t.column("q"), np.int64)
    return t, x, Summaries(x.shape[1], _matrix(t.column("means")), _matrix(t.column("devs")))


def _share(score: int, part: int, whole: int, up: bool) -> int:
    """``score * part / whole``, rounded up or down, in whole numbers."""
    return -(-score * part // whole) if up else score * part // whole


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10,
                   low: int = 30, high: int = 90, whole: int = 100) -> DataFrame:
    """``anchor, positive, rank, negative, positive_score, negative_score``.

    Components are taken as ``floor(scale * x)`` and scored by integer inner
    product, higher first, ties by smaller id (a missing id last).  Each row
    for which ``anchors`` holds (any expression over ``vectors``) gets its
    first ``positives`` other rows of its label; for each of them come the
    first ``negatives`` rows of other labels whose score lies from ``low`` to
    ``high`` ``whole``-ths of the positive's.

    Anchors are a query set against all rows, in tiles of at most about
    ``ANCHORS`` by ``ROWS`` rows (fewer of long vectors), dealt by a hash of a written row number: a
    label or an id with a third of all rows makes no larger tile.  A tile sends
    at most ``positives`` or ``negatives`` rows for an anchor (and positive),
    and a partial limit in the window cuts them before the shuffle.  Within a
    tile the segment summaries leave few pairs to score; nothing is missed,
    because bounds decide only what they prove.

    Rows with a null label or vector, or a null or non-finite component, take
    no part, nor do vectors whose integer form has a squared length of 2 ** 62
    or more (their scores would not fit 64 bits).  Only vectors of one length
    are compared.  Rows that repeat an id are separate rows; a null id takes
    part; equal vectors are ordered by id.  Columns of other names are not read.
    An empty table, or one without anchors, gives an empty result."""
    spark = ready(vectors)
    # A plain product: 2 ** 62 is far below where a double ends.
    given = vectors.select(
        F.col(id_col).cast("long").alias("vec"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"))
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0 ** 31))
    long = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    given = (given.where(F.coalesce(sound, F.lit(False)))
             .withColumn("q", F.transform("v", lambda x: F.floor(x).cast("int"))).where(long < 2.0 ** 62)
             .select(F.monotonically_increasing_id().alias("row"), "vec", F.xxhash64("label").alias("label"), "anchor",
                     F.size("q").alias("dim"), "q"))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = part.column("q").flatten().to_numpy().astype(np.float64).reshape(part.num_rows, -1)
                at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * LEVELS[-1])
                both = [pa.ListArray.from_arrays(at, pa.array(y.ravel())) for y in summaries(x)]
                yield pa.RecordBatch.from_arrays([*part.columns, *both], [*part.schema.names, "means", "devs"])

    rows = scratch(given.mapInArrow(summarised, "row long, vec long, label long, anchor boolean, dim int, q array<int>, "
                                                "means array<double>, devs array<double>"), "negative-rows", spark)
    asked = rows.where("anchor")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max("dim").alias("dim")).first()
    most = max(1, COMPONENTS // max(1, size["dim"] or 1))
    n_rows = max(1, -(-size["n"] // min(ROWS, most)))
    n_anchors = max(1, -(-size["a"] // min(ANCHORS, most)))
    tile = ["dim", "of", "block"]
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sent = ["row", "vec", "label", "q", "means", "devs"]

    def tiles(queries: DataFrame, run, kind: str) -> DataFrame:
        left = queries.withColumn("of", block(n_anchors)).withColumn("block", each(n_rows)).select(*tile, *[
            c for c in queries.columns if c in {*sent, "scores"}])
        right = rows.withColumn("block", block(n_rows)).withColumn("of", each(n_anchors)).select(*tile, *sent)
        deal = lambda x: x.repartition(max(partitions_for(spark), n_rows * n_anchors), *tile).groupBy(*tile)
        return deal(left).cogroup(deal(right)).applyInArrow(run, kind)

    def strips(label: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(label, kind="stable")
        for i in range(0, len(order), STRIP):
            yield order[i:i + STRIP]

    def found(out: list[tuple], names: list[str]) -> pa.Table:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            (ta, a, sa), (tb, b, sb) = _side(left), _side(right)
            row, label = ta.column("row").to_numpy(), ta.column("label").to_numpy()
            vec, theirs, labels = tb.column("vec").to_pylist(), tb.column("row").to_numpy(), tb.column("label").to_numpy()
            for mine in strips(label):
                open_ = (label[mine][:, None] == labels[None, :]) & (row[mine][:, None] != theirs[None, :])
                every = np.full(len(mine), -NO_ID), np.full(len(mine), NO_ID)
                out += [(int(row[mine[i]]), vec[c], int(theirs[c]), score)
                        for i, _, c, score in best(a, sa, mine, b, sb, open_, [every], positives)]
        return found(out, ["row", "vec", "other", "score"])

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            (ta, a, sa), (tb, b, sb) = _side(left), _side(right)
            row, label, scores = ta.column("row").to_numpy(), ta.column("label").to_numpy(), ta.column("scores").to_pylist()
            vec, theirs, labels = tb.column("vec").to_pylist(), tb.column("row").to_numpy(), tb.column("label").to_numpy()
            for mine in strips(label):
                windows = []
                for w in range(max(len(scores[m]) for m in mine)):
                    # A missing positive has an empty window.
                    of = [scores[m][w] if w < len(scores[m]) else None for m in mine]
                    windows.append((np.array([1 if s is None else _share(s, low, whole, True) for s in of]),
                                    np.array([0 if s is None else _share(s, high, whole, False) for s in of])))
                open_ = label[mine][:, None] != labels[None, :]
                out += [(int(row[mine[i]]), w + 1, vec[c], int(theirs[c]), score)
                        for i, w, c, score in best(a, sa, mine, b, sb, open_, windows, negatives)]
        return found(out, ["row", "place", "vec", "other", "score"])

    def first(x: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec"), "other")
        return x.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n)

    near = scratch(first(tiles(asked, nearest, "row long, vec long, other long, score long"), ["row"], positives, "place"),
                   "negative-positives", spark)
    scores = near.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))),
                                                 lambda x: x["score"]).alias("scores"))
    negative = first(tiles(scratch(asked.join(scores, "row"), "negative-anchors", spark), hard,
                           "row long, place long, vec long, other long, score long"), ["row", "place"], negatives, "rank")
    named = asked.select("row", F.col("vec").alias("anchor"))
    return (negative.select("row", "place", "rank", F.col("vec").alias("negative"), F.col("score").alias("negative_score"))
            .join(near.select("row", "place", F.col("vec").alias("positive"), F.col("score").alias("positive_score")), ["row", "place"])
            .join(named, "row").select("anchor", "positive", "rank", "negative", "positive_score", "negative_score"))
