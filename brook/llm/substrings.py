"""Exact substring deduplication on a De Bruijn graph of word windows.

Every window of ``window`` consecutive words is an edge.  Edges are never
shuffled one by one: a text is first cut into pieces, runs of consecutive
edges that share their minimizer (the least hash of ``seed`` consecutive words
inside the window).  A minimizer depends on the window alone, so equal windows
of any two texts lie in pieces of one minimizer, and a piece is a nonbranching
path that its text has compacted already.  Joins on the minimizer then
compact further: where all pieces of a minimizer are equal, the path does not
branch and one row decides all its edges; where they differ, the distinct
pieces are fetched by their source coordinates and compared edge by edge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.common import NO_ID, id_key, ready, scratch, text_key

# Fixed value: an odd base of the rolling hash.
BASE = 0x9E3779B97F4A7C15
# Fixed value: words worked on at once.
CHUNK = 400_000


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (the finaliser of a public 64-bit mixer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any run of words of a sequence, from prefix sums."""

    def __init__(self, words: list[bytes]):
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.n = len(words)
        self.down = _powers(self.n + 1, pow(BASE, -1, 1 << 64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(self.n, BASE), dtype=np.uint64)))

    def of(self, start: np.ndarray, length) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.down[start]
        return _mixed(raw + np.asarray(length).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each run of ``width`` values."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def pieces(texts: list[list[bytes]], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """The pieces of some texts (lists of words): number of the text, first
    word, number of windows, hash of the minimizer, hash of the content."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    counts = np.maximum(sizes - window + 1, 0)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    roll = Rolling([w for t in texts for w in t])
    seeds = roll.of(np.arange(roll.n - seed + 1), seed)
    least = _least(seeds, window - seed + 1)
    text = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    chosen = least[at]
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    return (text[first], at[first] - starts[text[first]], n, seeds[chosen[first]].view(np.int64),
            roll.of(at[first], n + window - 1).view(np.int64))


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Lists of split texts of about CHUNK words, and the number of the first."""
    part: list[list[bytes]] = []
    n = begun = 0
    for i, t in enumerate(texts):
        part.append(t.split() if t else [])
        n += len(part[-1])
        if n >= CHUNK:
            yield begun, part
            part, n, begun = [], 0, i + 1
    if part:
        yield begun, part


def repeated_spans(docs: DataFrame, window: int = 50, seed: int = 8) -> DataFrame:
    """``doc, text_hash, spans`` of documents with words to remove: ``spans`` is
    an array of (first word, end) of what is covered by windows that also start
    in a document with a smaller id.  ``docs``: doc, text_hash, t (binary)."""
    spark = ready(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begun, texts in _chunks(b.column("t").to_pylist()):
                text, start, n, seed_hash, content = pieces(texts, window, seed)
                row = pa.array(text + begun)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc").take(row), b.column("text_hash").take(row), pa.array(start.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(seed_hash), pa.array(content)],
                    ["doc", "text_hash", "start", "n", "seed", "content"])

    edges = scratch(docs.mapInArrow(cut, "doc long, text_hash long, start int, n int, seed long, content long"),
                    "graph-pieces", spark)
    # Written, so that the join has two plain sides and a hot minimizer can be split.
    shared = scratch(edges.groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last"),
                                        F.min("content").alias("c1"), F.max("content").alias("c2"))
              .where("first < last").select("seed", "first", (F.col("c1") != F.col("c2")).alias("branches")),
                     "graph-shared", spark)
    paths = scratch(edges.join(shared, "seed"), "graph-paths", spark)
    straight = paths.where("NOT branches AND first < doc").select(
        "doc", "text_hash", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))

    # Branching: distinct contents, each with the coordinates of its first place.
    key = ["seed", "content", "n"]
    forks = paths.where("branches")
    source = forks.groupBy(*key).agg(F.min(F.struct("doc", "text_hash", "start")).alias("at"))
    wanted = (source.select(*key, "at.*").groupBy("doc", "text_hash")
              .agg(F.collect_list(F.struct(*key, "start")).alias("wanted")))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                roll = Rolling((b.column("t")[i].as_py() or b"").split())
                got = b.column("wanted")[i].values.flatten()
                s, c, n, start = (np.asarray(x) for x in got)
                reach = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(s, n)), pa.array(np.repeat(c, n)), pa.array(np.repeat(n, n)),
                     pa.array((reach - np.repeat(start, n)).astype(np.int32)),
                     pa.array(roll.of(reach, window).view(np.int64)), b.column("doc").take(pa.array([i] * int(n.sum()), pa.int64()))],
                    [*key, "i", "edge", "doc"])

    fork_edges = scratch(docs.join(wanted, ["doc", "text_hash"])
                         .mapInArrow(expand, "seed long, content long, n int, i int, edge long, doc long"),
                         "graph-fork-edges", spark)
    lowest = fork_edges.groupBy("seed", "edge").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    # An edge held by one content only has that content's first document.
    decided = (fork_edges.join(lowest.where("first < last").drop("last"), ["seed", "edge"], "left")
               .groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("i", F.coalesce("first", "doc").alias("first"))))
                                  .alias("edges")))
    decided = scratch(decided, "graph-decided", spark)
    hit = forks.drop("first").join(decided, key).select(
        "doc", "text_hash", F.explode(F.expr(
            f"transform(filter(edges, e -> e.first < doc), e -> struct(start + e.i AS start, start + e.i + {window} AS end))"))
        .alias("s")).select("doc", "text_hash", "s.start", "s.end")
    spans = straight.union(hit).groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    return scratch(spans, "graph-spans", spark)


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``doc, text_hash, n_words, n_removed, kept_text`` of every row of ``docs``.

    Words are what lies between ASCII white space, unchanged.  A word goes if a
    window of ``window`` consecutive words covers it whose words also start, in
    the same order, in a document with a smaller id; all windows are judged on
    the input.  ``kept_text`` is the words that stay, joined by one space.

    Null and empty texts have no words, texts shorter than a window lose none.
    A null id counts as larger than all others.  Repeated rows and rows that
    share an id are one document in this respect: they take nothing from each
    other.  Other columns are not read.  An empty table gives an empty result."""
    spark = ready(docs)
    base = docs.select(id_key(id_col).alias("doc"), text_key(text_col).alias("text_hash"),
                       F.col(text_col).cast("binary").alias("t"))
    spans = repeated_spans(base, window)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for t, cuts in zip(b.column("t").to_pylist(), b.column("spans"), strict=True):
                words = t.split() if t else []
                total.append(len(words))
                lost = 0
                if cuts.is_valid:
                    start, end = (np.asarray(x) for x in cuts.values.flatten())
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    lost = int(len(words) - stay.sum())
                    words = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
                gone.append(lost)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("text_hash"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "text_hash", "n_words", "n_removed", "kept_text"])

    out = base.join(spans, ["doc", "text_hash"], "left").mapInArrow(
        strip, "doc long, text_hash long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc", F.nullif("doc", F.lit(NO_ID)))
