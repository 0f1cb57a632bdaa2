"""Line deduplication by pairwise alignment: documents that share a rare line
or a run of lines are aligned by patience diff, and common blocks leave the
later one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.common import id_key, ready, scratch, spare, text_key
from brook.llm.quality import bind

# Fixed value: hash that stands for a line without a word.
BLANK = 0


def _once(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur once in ``x``, sorted, and where."""
    values, at, n = np.unique(x, return_index=True, return_counts=True)
    return values[n == 1], at[n == 1]


def _rising(x: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        tails[k:k + 1] = [v]
        ends[k:k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two sequences have in common from the start on."""
    n = min(len(a), len(b))
    if not n or a[0] != b[0]:
        return 0
    differ = a[:n] != b[:n]
    k = int(differ.argmax())
    return k if differ[k] else n


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned equal items ``(i, j)`` of two sequences, both rising: common
    head and tail, then the items that both sides hold once, in their longest
    common order, then the same between each two of them."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n = _agree(a[a0:a1], b[b0:b1])
        found += zip(range(a0, a0 + n), range(b0, b0 + n), strict=True)
        a0, b0 = a0 + n, b0 + n
        n = _agree(a[a0:a1][::-1], b[b0:b1][::-1])
        found += zip(range(a1 - n, a1), range(b1 - n, b1), strict=True)
        a1, b1 = a1 - n, b1 - n
        if a0 == a1 or b0 == b1:
            continue
        (va, ia), (vb, ib) = _once(a[a0:a1]), _once(b[b0:b1])
        _, xa, xb = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        if not len(xa):
            continue
        order = np.argsort(ia[xa])
        pa_, pb_ = ia[xa][order], ib[xb][order]
        keep = _rising(pb_.tolist())
        anchors = [(int(pa_[k]) + a0, int(pb_[k]) + b0) for k in keep]
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def common_lines(a: np.ndarray, b: np.ndarray, min_lines: int = 1) -> list[int]:
    """Lines of ``b`` in aligned blocks with ``a``: runs that are adjacent on
    both sides and hold at least ``min_lines`` lines with a word."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(b[k] != BLANK for k in run) >= min_lines:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of runs of lines from those of their halves."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + b.view(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


class Texts:
    """The line hashes of many texts, one after another, and what is asked of
    all of them at once."""

    def __init__(self, lines: pa.ListArray):
        lines = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
        self.size = lines.value_lengths().to_numpy()
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.x = lines.flatten().to_numpy(zero_copy_only=False)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        self.at = np.arange(len(self.x)) - self.start[self.text]

    def within(self, n: int) -> np.ndarray:
        """The places from which a text has ``n`` more lines."""
        return np.flatnonzero(self.at + n <= self.size[self.text])

    def once(self) -> np.ndarray:
        """The places of lines with a word that their text holds once."""
        order = np.lexsort((self.x, self.text))
        x, t = self.x[order], self.text[order]
        same = (x[1:] == x[:-1]) & (t[1:] == t[:-1])
        alone = ~(np.append(same, False) | np.append(False, same)) if len(x) else np.zeros(0, bool)
        return order[alone & (x != BLANK)]

    def heads(self, salt: int) -> np.ndarray:
        """For each line the hash of its text from the start up to it."""
        powers = np.cumprod(np.full(int(self.size.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
        total = np.cumsum(np.concatenate((np.zeros(1, np.uint64), self.x.view(np.uint64) * powers[self.at])))
        here = total[1:] - total[self.start[:-1][self.text]]
        return _joined(np.full(len(self.x), salt, np.int64), here.view(np.int64))

    def backwards(self) -> Texts:
        """The texts last line first, the last text first."""
        return Texts(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.size[::-1]))).astype(np.int32)),
                                              pa.array(self.x[::-1])))


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[:len(key)]
    return text[new], key[new]


def short_keys(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Keys that name partners, as texts and keys: the lines with a word that a
    text holds once, its runs of two lines, its first and last line."""
    once, two = t.once(), t.within(2)
    two = two[(t.x[two] != BLANK) | (t.x[two + 1] != BLANK)]
    out = [(t.text[once], t.x[once]), (t.text[two], _joined(t.x[two], t.x[two + 1]))]
    back = t.backwards()
    for y, salt, flip in ((t, 1, False), (back, 2, True)):
        first = y.start[:-1][y.size > 0]
        first = first[y.x[first] != BLANK]
        text = y.text[first]
        out.append((len(y.size) - 1 - text if flip else text, y.heads(salt)[first]))
    return _distinct(*(np.concatenate(x) for x in zip(*out, strict=True)))


def long_keys(t: Texts, shared: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of 4, 8, 16 ... lines of a text, and of its heads and
    tails of 2, 3, 4 ... lines (the whole text is one), in which all runs of two
    with a word are ``shared`` with another text: no other can be."""
    shared = shared.combine_chunks() if isinstance(shared, pa.ChunkedArray) else shared
    owner = np.repeat(np.arange(len(shared)), shared.value_lengths().to_numpy())
    known = np.unique(_joined(owner.astype(np.int64), shared.flatten().to_numpy(zero_copy_only=False)))
    run = np.zeros(len(t.x), np.int64)
    good = np.zeros(len(t.x), bool)
    two = t.within(2)
    run[two] = _joined(t.x[two], t.x[two + 1])
    mine = _joined(t.text[two].astype(np.int64), run[two])
    place = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
    # A run of two texts' hashes that agree by chance only makes one more key.
    good[two] = (known[place] == mine if len(known) else False) | ((t.x[two] == BLANK) & (t.x[two + 1] == BLANK))
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for y, link, flip, salt in ((t, good, False, 1), (t.backwards(), np.append(False, good[:-1])[::-1] if len(good) else good, True, 2)):
        # ``link``: a line and the one after it are shared.  A head lasts while all of its links are.
        broken = np.cumsum(~link)
        before = np.where(y.at > 0, broken - ~link, 0)
        base = (broken - ~link)[y.start[:-1][y.text]] if len(y.x) else broken
        whole = (y.at > 0) & (before == base)
        words = np.cumsum(y.x != BLANK)
        some = words - (words - (y.x != BLANK))[y.start[:-1][y.text]] > 0 if len(y.x) else whole
        place = np.flatnonzero(whole & some)
        out.append((len(y.size) - 1 - y.text[place] if flip else y.text[place], y.heads(salt)[place]))
    n, link = 2, good
    while good.any():
        fits = t.within(2 * n)
        fits = fits[good[fits] & good[fits + n] & (link[fits + 1] if n == 2 else True)]
        longer = _joined(run[fits], run[fits + n])
        out.append((t.text[fits], longer))
        run, good = np.zeros(len(t.x), np.int64), np.zeros(len(t.x), bool)
        run[fits], good[fits] = longer, True
        n *= 2
    return _distinct(*(np.concatenate(x) for x in zip(*out, strict=True)))


def left_keys(t: Texts, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lines with a word that a text holds once and that are not cut."""
    cut = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
    gone = np.zeros(len(t.x), bool)
    gone[np.repeat(t.start[:-1], cut.value_lengths().to_numpy()) + cut.flatten().to_numpy(zero_copy_only=False)] = True
    once = t.once()
    once = once[~gone[once]]
    return _distinct(t.text[once], t.x[once])


def line_cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1,
              whole: bool = True) -> DataFrame:
    """``doc, text_hash, n_lines, cut`` of every document: ``cut`` holds the
    numbers of the lines to delete (sorted), null if there are none."""
    spark = ready(docs)
    hashed = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
                         lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(x)).otherwise(F.lit(BLANK).cast("long")))
    lines = scratch(docs.select(id_key(id_col).alias("doc"), text_key(text_col).alias("text_hash"), hashed.alias("lines"))
                    .dropDuplicates(["doc", "text_hash"]), "line-hashes")
    earlier = lines.select(F.col("doc").alias("doc1"), F.col("text_hash").alias("text1"), F.col("lines").alias("lines1"))

    def listed(x: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return x.column(name)[i].values.to_numpy(zero_copy_only=False)

    def keys(rows: DataFrame, of, *names: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                text, key = of(Texts(x.column("lines")), *(x.column(c) for c in names))
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([x.column("doc").take(at), x.column("text_hash").take(at), pa.array(key)],
                                                 ["doc", "text_hash", "key"])
        return rows.mapInArrow(run, "doc long, text_hash long, key long")

    def met(rows: DataFrame, name: str) -> DataFrame:
        # Each key names the first document with it, not all pairs of its
        # holders, so the pairs grow with the lines and no frequency needs a
        # cap.  Written, so that the join has two plain sides and a hot key
        # can be split.
        rows = scratch(rows, name, spark)
        first = scratch(rows.groupBy("key").agg(F.min(F.struct("doc", "text_hash")).alias("f"), F.count("*").alias("n"))
                        .where("n > 1"), name + "-first")
        return rows.join(first, "key")

    def aligned(pairs: DataFrame) -> DataFrame:
        """``doc, text_hash, line``: what each document loses to its partners ``f``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                cuts = [common_lines(listed(x, "lines1", i), listed(x, "lines", i), min_lines) for i in range(x.num_rows)]
                yield pa.RecordBatch.from_arrays([x.column("doc"), x.column("text_hash"), pa.array(cuts, pa.list_(pa.int32()))],
                                                 ["doc", "text_hash", "cut"])

        later = (pairs.where(F.struct("doc", "text_hash") > F.col("f"))
                 .select(F.col("f.doc").alias("doc1"), F.col("f.text_hash").alias("text1"), "doc", "text_hash").distinct())
        both = later.join(earlier, ["doc1", "text1"]).select("doc", "text_hash", "lines1").join(lines, ["doc", "text_hash"])
        return both.mapInArrow(run, "doc long, text_hash long, cut array<int>").select(
            "doc", "text_hash", F.explode("cut").alias("line"))

    def collected(cut: DataFrame, name: str) -> DataFrame:
        return scratch(cut.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("cut")), name, spark)

    none = F.expr("CAST(array() AS array<int>)")
    # Patience aligns by lines that a text holds once; those name partners.
    if not whole:
        cut = collected(aligned(met(keys(lines.withColumn("cut", none), left_keys, "cut"), "line-once")), "line-cuts")
    else:
        # So do runs, heads and tails, which lead to a text with the same
        # lines in the same order, repeated ones included.
        near = scratch(met(keys(lines, short_keys), "line-keys"), "line-met")
        shared = near.groupBy("doc", "text_hash").agg(F.collect_set("key").alias("shared"))
        runs = met(keys(lines.join(shared, ["doc", "text_hash"]), long_keys, "shared"), "line-runs")
        cut = collected(aligned(near.unionByName(runs)), "line-cuts")
        # A line may cross others in its first holder.  What is left meets its
        # other holders, in slices of a hash that grow 16 times a round, until
        # it is cut or has met them all.
        share = F.shiftrightunsigned(F.xxhash64("doc", "text_hash"), 11) / F.lit(float(1 << 53))
        slices = F.floor(F.log(16.0, F.greatest(share * F.col("n"), F.lit(1.0)))).cast("int")
        holders = near.select("key", F.struct("doc", "text_hash").alias("f"), slices.alias("slice"))
        k = 0
        while True:
            rest = keys(lines.join(cut, ["doc", "text_hash"], "left").withColumn("cut", F.coalesce("cut", none)), left_keys, "cut")
            rest = scratch(rest.join(near.where(F.struct("doc", "text_hash") > F.col("f")).where(F.col("n") >= 16 ** k),
                                     ["doc", "text_hash", "key"]).select("doc", "text_hash", "key"), "line-left", spark)
            if rest.isEmpty():
                break
            more = aligned(rest.join(holders.where(F.col("slice") == k), "key"))
            cut = collected(more.union(cut.select("doc", "text_hash", F.explode("cut"))), "line-cuts")
            k += 1
    return lines.select("doc", "text_hash", F.size("lines").alias("n_lines")).join(cut, ["doc", "text_hash"], "left")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1,
                      whole: bool = True) -> DataFrame:
    """``docs`` with aligned common blocks deleted from the later document, and
    ``n_cut_lines`` (int, replacing a column of that name), the lines that it lost.

    Documents that share a line which both hold once are partners: every
    document meets, for each such line, the first document that has it (by id,
    a null id last, then by text hash).  The two are aligned line by line with
    patience diff; blocks of aligned lines, at least ``min_lines`` of them with
    a word, go from the later one with their line ends.  All comparisons are
    made on the input, not on what other cuts leave.  A rare line is here one
    that is not blank and that its text holds once; there is no limit on how
    many documents may share it.

    That is not all pairs: a line may cross others in its first holder, or be
    held twice, and stay.  So documents also meet (unless ``whole`` is false)
    the first one with each of their runs of 2, 4, 8 ... adjacent lines, their heads and their
    tails, repeated lines included; and a line that its text holds once and
    that is still there meets every earlier document that holds it once, until
    one of them takes it.  The last part reads more pairs than lines where many
    documents hold the same lines in crossing order.  Not met: holders of a
    line that is held twice, outside runs, heads and tails.

    Null texts stay null, empty ones empty; a text may become empty.  Repeated
    rows (same id and text) are one document and are cut alike;
    equal texts under different ids lose all lines from the second on (unless
    fewer than ``min_lines`` of them have a word).  Columns other than
    the text are carried through unread, whatever their names.  An empty table
    gives an empty result."""
    doc, text, cut = spare(docs, "_doc", "_text", "_cut")
    cuts = line_cuts(docs, id_col, text_col, min_lines, whole).where("cut IS NOT NULL").select(
        F.col("doc").alias(doc), F.col("text_hash").alias(text), F.col("cut").alias(cut))
    keyed = docs.withColumns({doc: id_key(id_col), text: text_key(text_col)}).join(cuts, [doc, text], "left")

    def rest(lines):
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    body = F.when(F.col(cut).isNull(), F.col(text_col)).otherwise(bind(F.split(F.col(text_col), "\n"), rest))
    return keyed.withColumns({text_col: body, "n_cut_lines": F.coalesce(F.size(cut), F.lit(0))}).drop(doc, text, cut)
