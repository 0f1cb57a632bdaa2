"""Phrase collocations through prefix-free parsing: content-triggered
overlapping chunks form a dictionary with frequencies, and n-grams are counted
once inside each distinct chunk, weighted by how often it occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brook.llm.common import ready, scratch

# What ends a piece, and what separates words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \x09"

# One window of words in so many starts a chunk; text bytes
# worked on at once; bits of a filter for each phrase, and at most.
TRIGGER = 32
SLICE = 6_000_000
BITS = 32
MOST_BITS = 1 << 27

# Odd multipliers of the hashes, and the language of no language.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
UNKNOWN = "und"

CHUNKS = pa.schema([("lang", pa.string()), ("tail", pa.bool_()), ("chunk", pa.string())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``SLICE`` bytes of ``column``; one row at least."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE - size, "right")))
            kept.append(b.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - done, to
            if size >= SLICE:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def words_of(texts: pa.StringArray, breaks: bytes = BREAKS, lower: bool = True) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The words of all texts, the text of each, and the piece of each (rising;
    no piece goes over a text's end)."""
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)] = 1
    kind[list(breaks)] = 2
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))))
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = int(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]) if len(texts) else 0
    data = data[first:first + int(ends[-1])]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    is_word = kind[data] == 0
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edge = ends[:-1][ends[:-1] < ends[1:]]
    begins[edge] = is_word[edge]
    at = np.flatnonzero(begins)
    row = np.searchsorted(ends, at, "right") - 1
    piece = np.cumsum(kind[data] == 2)[at] + row
    before = np.cumsum(is_word)
    offsets = np.concatenate((before[at] - 1, before[-1:])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[is_word].tobytes()))
    return words, row, piece


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * MIX[0]
    return (h ^ (h >> np.uint64(29))) * MIX[1]


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _joined(words: pa.StringArray, starts: np.ndarray, sizes: np.ndarray) -> pa.StringArray:
    """Runs of words, joined by one space."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - ends[:-1], sizes) + np.arange(int(ends[-1]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(pa.array(at))), " ")


def chunk_bounds(hashes: np.ndarray, piece: np.ndarray, overlap: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks start and end, and whether their piece ends with them.

    A window of ``overlap`` words whose hash is a multiple of ``trigger`` ends
    one chunk and starts the next (prefix-free parsing), so the cuts depend on
    content alone and copies of a passage are cut alike.  Every phrase of up to
    ``overlap + 1`` words lies in the chunk that has its first word ahead of
    the last ``overlap`` ones, or in the last chunk of its piece, and is
    counted there alone."""
    n = len(piece)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    fresh = np.concatenate(([True], piece[1:] != piece[:-1]))
    cut = np.zeros(n, bool)
    if n >= overlap > 0:
        h = np.zeros(n - overlap + 1, np.uint64)
        for k in range(overlap):
            h = _mixed(h, hashes[k:n - overlap + 1 + k])
        cut[:n - overlap + 1] = ((h >> np.uint64(33)) % np.uint64(trigger) == 0) & (piece[:n - overlap + 1] == piece[overlap - 1:])
    starts = np.flatnonzero(fresh | cut)
    following = np.append(starts[1:], n)
    tail = np.append(fresh[starts[1:]], True)
    return starts, np.where(tail, following, following + overlap), tail


class Filter:
    """Which phrases may have been counted often enough: a bit for each hash.
    A set bit may be another phrase's, a clear one never lies."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def may(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(20)) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @classmethod
    def of(cls, phrases: DataFrame, n: int) -> Filter:
        """The filter of ``lang, phrase`` rows.  Its size follows their number
        ``n`` up to ``MOST_BITS`` (16 MB); beyond, more bits are shared and
        more phrases are counted in vain, with the same result."""
        bits = 1 << 10
        while bits < min(MOST_BITS, BITS * n):
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches, "phrase"):
                words, row, _ = words_of(b.column("phrase"), b"", False)
                code = words.dictionary_encode()
                h = _word_hashes(b.column("lang"))
                each = _word_hashes(code.dictionary)[code.indices.to_numpy()]
                sizes = np.bincount(row, minlength=b.num_rows)
                at = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(int(sizes.max(initial=0))):
                    some = sizes > k
                    h[some] = _mixed(h[some], each[at[:-1][some] + k])
                bit = np.unique((h >> np.uint64(20)) & np.uint64(bits - 1))
                place, one = (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(np.bitwise_or.reduceat(one, first).view(np.int64))],
                                                 ["place", "word"])

        got = phrases.select("lang", "phrase").mapInArrow(run, "place long, word long").groupBy("place").agg(
            F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(max(1, bits // 64), np.uint64)
        words[got.column("place").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
        return cls(bits, words)


def _sums(ids: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, ids, weights)
    return out


def count_phrases(b: pa.RecordBatch, overlap: int, sizes: range, filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    """``COUNTS`` of the phrases of ``sizes`` words in a batch of distinct
    chunks.  ``filters`` are those of 1, 2, ... words; a phrase is left out
    if a filter shows that a part of it is rare.  Within the batch phrases are
    told apart by exact numbers, not by hashes."""
    words, row, _ = words_of(b.column("chunk"), b"", False)
    if not len(words):
        return
    freq, tail = b.column("freq").to_numpy(), b.column("tail").to_numpy(zero_copy_only=False)
    n_words = np.bincount(row, minlength=b.num_rows)
    left = np.cumsum(n_words)[row] - np.arange(len(row))  # words from here to the chunk's end
    weight = np.where(tail[row] | (left > overlap), freq[row], 0)
    code = words.dictionary_encode()
    lang = b.column("lang").dictionary_encode()
    lang_of = lang.indices.to_numpy()[row].astype(np.int64)
    _, first, ids = np.unique(lang_of * len(code.dictionary) + code.indices.to_numpy(), return_index=True, return_inverse=True)
    single, at = ids, np.arange(len(ids))
    each = _word_hashes(code.dictionary)[code.indices.to_numpy()] if filters else None
    h = _mixed(_word_hashes(lang.dictionary)[lang_of[first]], each[first]) if filters else None
    for size in range(1, sizes.stop):
        if size > 1:
            # ``at`` holds the starts of phrases one word shorter, ``ids`` their
            # numbers; both of the shorter phrases must be open.
            where = np.full(len(row) + 1, -1)
            where[at] = np.arange(len(at))
            good = filters[size - 2].may(h)[ids] if size - 2 < len(filters) else np.ones(len(at), bool)
            nxt = where[at + 1]
            keep = good & (left[at] >= size) & (nxt >= 0)
            keep[keep] &= good[nxt[keep]]
            at, ids = at[keep], ids[keep]
            if not len(at):
                return
            _, new, numbers = np.unique(ids.astype(np.int64) << 32 | single[at + size - 1], return_index=True, return_inverse=True)
            if filters:
                h = _mixed(h[ids[new]], each[at[new] + size - 1])
            first, ids = at[new], numbers
        if size in sizes:
            f = _sums(ids, weight[at], len(first))
            some = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(lang_of[first[some]])),
                                              _joined(words, first[some], np.full(len(some), size)), pa.array(f[some])], schema=COUNTS)


def _counted(chunks: DataFrame, overlap: int, sizes: range, filters: list[Filter]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "chunk"):
            yield from count_phrases(b, overlap, sizes, filters)

    return (chunks.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase")
            .agg(F.sum("f").alias("f")))


def chunk_dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", overlap: int = 4,
                     trigger: int = TRIGGER) -> DataFrame:
    """``lang, tail, chunk, freq``: the distinct chunks of each language, as
    words joined by one space, and how often each occurs in the parse.  ``tail``
    tells chunks that end their piece, all of whose phrases are counted, from
    those whose last ``overlap`` words belong to the next chunk."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            words, row, piece = words_of(b.column("text"))
            if not len(words):
                continue
            code = words.dictionary_encode()
            starts, ends, tail = chunk_bounds(_word_hashes(code.dictionary)[code.indices.to_numpy()], piece, overlap, trigger)
            for i in range(0, len(starts), 50_000):
                part = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(row[starts[part]])), pa.array(tail[part]),
                                                  _joined(words, starts[part], (ends - starts)[part])], schema=CHUNKS)

    return (texts.mapInArrow(parse, "lang string, tail boolean, chunk string").groupBy("lang", "tail", "chunk")
            .agg(F.count("*").alias("freq")))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5,
                  least: int = 100, trigger: int = TRIGGER) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, f`` of all phrases of 1 to ``longest`` words
    that occur ``least`` times or more, and ``lang, n``, the words of each
    language.

    Words are counted first, then pairs, then longer phrases, all in distinct
    chunks; a phrase cannot be frequent if a part of it is not, and a filter of
    the frequent words (pairs) keeps the others from being made.  Counts come
    from sums over the phrases themselves, which combine map-side."""
    overlap = longest - 1
    chunks = scratch(chunk_dictionary(docs, text_col, lang_col, overlap, trigger), "phrase-chunks")
    words = scratch(_counted(chunks, overlap, range(1, 2), []), "phrase-words")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found, filters = [words.where(F.col("f") >= least).withColumn("n_words", F.lit(1))], []
    # Words, pairs, triples, and the rest together.
    steps = [range(k, k + 1) for k in range(2, min(longest, 3) + 1)] + ([range(4, longest + 1)] if longest > 3 else [])
    for sizes in steps:
        filters.append(Filter.of(found[-1], found[-1].count()))
        got = scratch(_counted(chunks, overlap, sizes, filters).where(F.col("f") >= least)
                      .withColumn("n_words", F.size(F.split("phrase", " "))), f"phrases-{sizes.start}")
        found.append(got)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.select("lang", "phrase", "n_words", "f"), total


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100,
                 covered: int = 100, top: int = 2000, factor: int = 1000, trigger: int = TRIGGER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each
    language by score, then frequency, then text.

    Texts are lower-cased (A-Z), split into pieces at ``BREAKS`` and into words
    at blanks.  A phrase of 2 to ``longest`` words within a piece that occurs
    ``least`` times or more is a candidate.  Cut in two, it scores
    ``floor(factor * a * n / (l * r))``, with its frequency, the words of the
    language and the frequencies of both parts; its lowest-scoring cut counts,
    the first one among equals.  Products are whole numbers of up to 38 digits.
    A candidate inside a longer one that has at least ``covered`` per cent of
    its frequency is dropped.

    All texts count, whole, whatever their length: frequencies come from the
    distinct chunks of ``chunk_dictionary``, each phrase occurrence in one chunk
    alone.  A null text is empty, a null language is ``und``; repeated rows
    count as often as they stand there.  Other columns are not read.  An empty
    table gives an empty result."""
    ready(docs)
    counts, total = phrase_counts(docs, text_col, lang_col, longest, least, trigger)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    cuts = counts.where("n_words > 1").select(
        "lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    ).select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
             F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    part = lambda side, c: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(c))
    parted = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    whole = (F.lit(factor).cast("decimal(6,0)") * (big("a") * big("n"))).cast("decimal(38,0)")
    parted = parted.withColumns({"above": whole, "below": (big("l") * big("r")).cast("decimal(38,0)")})
    scored = parted.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "n", "x.*")
    inner = counts.where("n_words > 2").select(
        "lang", "f", words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m")
    ).select("lang", "f", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("i")
             ).groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    free = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
