"""Packing by lexical retrieval: documents are put into fixed windows together
with the neighbours that a sharded BM25 index returns for them.

Two passes.  The first reads the words of every text: document frequencies of
the whole corpus, and for each document its smallest word hashes.  Documents
are dealt to index shards by these, so that texts which share words meet
wherever they stand in the input.  The second pass encodes, indexes and packs
shard by shard, with the frequencies of the whole corpus."""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.llm.arrays import Ragged, places, taken
from brook.llm.common import ready, scratch, text_key

# Characters of text in an index shard and in a partition of
# shards, characters that a row counts for beside its text, parts of words that
# a worker remembers, words encoded and rows taken out of a batch at
# once, and the usual constants of BM25.
SHARD = 4_000_000
PART = 16_000_000
ROW = 64
REMEMBERED = 500_000
ENCODED = 2_000
SLICE = 256
K1, B = 1.2, 0.75
# Document frequencies are kept by word hash, in this many
# buckets (4 MB however large the vocabulary is); word hashes that deal a
# document to its shard; the hash of no word; bytes hashed at once.
BUCKETS = 1 << 20
KEYS = 3
NONE = (1 << 63) - 1
HASHED = 250_000
# ASCII punctuation, which is cut off after a letter; a word of letters that
# are composed and whose lower case is one letter (ASCII and Latin-1).
TAIL = string.punctuation
LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def _hashes(data: np.ndarray, ends: np.ndarray, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes below 2^62 of all words of the UTF-8 texts that lie in ``data``
    one after another, A-Z as a-z, and how many words each text has.  A word's
    hash is a sum of its bytes by place with random weights (others for another
    ``kind``), then mixed; its low bits are its bucket."""
    space = (data == 32) | (data - np.uint8(9) <= 4)
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = ~space[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    at = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    at -= np.maximum.accumulate(at * begins)
    low = data + (data - np.uint8(65) <= 25) * np.uint8(32) + np.uint8(1)
    value = _weights(kind)[at & 0xFFFF] * low
    value[space] = 0
    h = np.add.reduceat(value, starts)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    counts = np.diff(np.searchsorted(starts, ends))
    return (h >> np.uint64(2)).astype(np.int64), counts


_WEIGHTS: dict[int, np.ndarray] = {}


def _weights(kind: int) -> np.ndarray:
    """Odd 64-bit numbers by place in a word; they repeat after 65,536."""
    if kind not in _WEIGHTS:
        random = np.random.default_rng(11 + kind)
        _WEIGHTS[kind] = random.integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
    return _WEIGHTS[kind]


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of large strings begins, where the last ends, and the bytes."""
    ends = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return ends, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def word_hashes(texts: pa.Array, kind: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_hashes`` of ``texts``, in runs of about ``HASHED`` bytes; a longer
    text is a run.  Null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends, data = _laid_out(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + HASHED, "right")) - 1)
        yield _hashes(data[ends[i]:ends[j]], ends[i:j + 1] - ends[i], kind)
        i = j


def _hash_each(words: pa.Array, kind: int = 0) -> np.ndarray:
    """One hash for each of ``words``, which hold no white space; 0 if empty."""
    out = np.zeros(len(words), np.int64)
    runs = list(word_hashes(words, kind))
    if runs:
        out[np.concatenate([n for _, n in runs]) > 0] = np.concatenate([h for h, _ in runs])
    return out


def word_hash(word: str) -> int:
    return int(_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0][0])


def smallest(hashes: np.ndarray, sizes: np.ndarray, k: int = KEYS) -> np.ndarray:
    """The ``k`` smallest distinct hashes of each run of ``sizes`` hashes."""
    out = np.full((len(sizes), k), NONE)
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    for j in range(k if len(starts) else 0):
        out[full, j] = np.minimum.reduceat(hashes, starts)
        hashes = np.where(hashes == np.repeat(out[full, j], sizes[full]), NONE, hashes)
    return out


class Corpus:
    """What BM25 has to know of all documents: their number, their mean length
    in words, and how many hold a word of each bucket."""

    def __init__(self, n: int, mean: float, held: np.ndarray):
        self.mean = max(1.0, mean)
        held = np.minimum(held, n)
        self.idf = np.log1p((n - held + 0.5) / (held + 0.5)).astype(np.float32)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models use for each byte: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words:
    """The distinct words of some texts: each text's word numbers, and each
    word's token ids and bucket."""

    def __init__(self, terms: list[np.ndarray], ids: np.ndarray, ends: np.ndarray, buckets: np.ndarray):
        self.terms, self.ids, self.ends, self.buckets = terms, ids, ends, buckets

    def tokens(self, terms: np.ndarray) -> np.ndarray:
        return taken(self.ends, self.ids, terms)


class WordIds:
    """Token ids by word, for tokenizers that drop white space.

    Such a tokenizer never joins characters across ASCII white space, so a
    text's ids are its words' ids.  Words are looked up in lower case if the
    tokenizer lower-cases them anyway, and punctuation after a letter, where
    the tokenizer splits as well, is encoded apart.  Each part is encoded once
    as long as it is remembered: by two hashes of 62 and 32 bits, in arrays,
    without its characters.  A word of letters alone, which normaliser and splitter
    leave whole, goes straight to the model.  Texts that may hold a special
    token are left as they are, and such words are not remembered."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.model = self.tok.model
        parts = json.loads(spec)
        norm = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        split = [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if norm != ["NFC", "Replace", "Lowercase"] or split != ["Split", "ByteLevel"]:
            raise ValueError("the tokenizer does not drop white space and case: its texts cannot be encoded by words")
        special = sorted(self.tok.get_added_tokens_decoder().items())
        self.sep_id, self.sep = special[0][0], special[0][1].content
        self.marks = {t.content[:2] for _, t in special}
        letters = _byte_letters()
        self.letters = {i: "".join(letters[b] for b in chr(i).lower().encode()) for i in range(0xC0, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.int64)  # of the parts remembered, sorted
        self.checks, self.at = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.table = Ragged()

    def _marked(self, texts: pa.Array) -> np.ndarray:
        """Which of ``texts`` may hold a special token."""
        out = np.zeros(len(texts), bool)
        for m in self.marks:
            out |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)
        return out

    def _of_letters(self, words: list[str]) -> None:
        flat, sizes = array("i"), array("q")
        for w in words:
            ids = [t.id for t in self.model.tokenize(w if w.isascii() else w.translate(self.letters))]
            flat.extend(ids)
            sizes.append(len(ids))
        self.table.extend(flat, sizes)

    def _of_others(self, words: list[str]) -> None:
        for i in range(0, len(words), ENCODED):
            part = words[i:i + ENCODED]
            ids = np.array(self.tok.encode(self.sep.join(part), add_special_tokens=False).ids, np.int32)
            cuts = np.flatnonzero(ids == self.sep_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the tokenizer does not keep its special token apart")
            self.table.extend(np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1)

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of distinct parts in ``table``; new ones are encoded."""
        hashes, checks = _hash_each(parts), _hash_each(parts, 1).astype(np.int32)
        out = np.full(len(parts), -1, np.int64)
        if len(self.hashes):
            k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where((self.hashes[k] == hashes) & (self.checks[k] == checks), self.at[k], out)
        new = np.flatnonzero(out < 0)
        some = parts.take(pa.array(new))
        words, marked = some.to_pylist(), self._marked(some)
        straight = np.fromiter((LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        first = self.table.n
        order = np.concatenate([np.flatnonzero(x) for x in (straight, ~straight & ~marked, marked)])
        self._of_letters([words[i] for i in np.flatnonzero(straight)])
        self._of_others([words[i] for i in np.flatnonzero(~straight & ~marked)])
        self.table.add([self.tok.encode(words[i], add_special_tokens=False).ids for i in np.flatnonzero(marked)])
        out[new[order]] = np.arange(first, first + len(new))
        new = new[~marked]
        new = new[np.argsort(hashes[new], kind="stable")]
        k = np.searchsorted(self.hashes, hashes[new])
        self.hashes = np.insert(self.hashes, k, hashes[new])
        self.checks = np.insert(self.checks, k, checks[new])
        self.at = np.insert(self.at, k, out[new])
        return out

    def words(self, texts: list[str | None]) -> Words:
        t = pa.array([x or "" for x in texts], pa.large_string())
        low = pc.if_else(pa.array(self._marked(t)), t, pc.ascii_lower(t))
        split = pc.ascii_split_whitespace(low)
        coded = split.values.dictionary_encode()
        words = coded.dictionary
        n = len(words)
        # Each word is cut into two parts; the second is empty if it has no
        # punctuation after a letter, or may hold a special token.
        starts, data = _laid_out(words)
        stems = pc.binary_length(pc.ascii_rtrim(words, TAIL)).to_numpy()
        cuts = starts[:-1] + stems
        tailed = stems > 0
        last = data[cuts[tailed] - 1]
        tailed[tailed] = (last >= 97) & (last <= 122)
        tailed &= ~self._marked(words)
        both = np.append(np.column_stack((starts[:-1], np.where(tailed, cuts, starts[1:]))).ravel(), starts[-1])
        parts = pa.Array.from_buffers(pa.large_string(), 2 * n, [None, pa.py_buffer(both), pa.py_buffer(data)]).dictionary_encode()
        numbers = self._numbers(parts.dictionary)[parts.indices.to_numpy()]
        ids = self.table.take(numbers)
        sizes = (self.table.ends[numbers + 1] - self.table.ends[numbers]).reshape(n, 2).sum(axis=1)
        every = coded.indices.to_numpy()
        real = (np.diff(starts) > 0)[every]  # white space at either end of a text leaves an empty word
        ends = np.concatenate(([0], np.cumsum(real)))[split.offsets.to_numpy()]
        return Words(np.split(every[real].astype(np.int64), ends[1:-1])[:len(texts)], ids, np.concatenate(([0], np.cumsum(sizes))),
                     (_hash_each(words) % BUCKETS).astype(np.int32))


class Index:
    """A BM25 index of some documents, given as arrays of term numbers.
    Frequencies and lengths are those of ``corpus`` (``buckets`` are the terms'
    buckets there), or of these documents if there is none."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None, buckets: array | None = None):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        every = np.concatenate(docs).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        top = int(every.max(initial=0)) + 1
        key, tf = np.unique(np.repeat(np.arange(self.n), lengths) * top + every, return_counts=True)
        doc, term = np.divmod(key, top)
        df = np.bincount(term, minlength=top)
        shared = df[term] > 1  # the others lead to no other document
        doc, term, tf = doc[shared], term[shared], tf[shared]
        self.doc_ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=self.n))))
        self.doc_terms = term
        if corpus is None:
            idf, mean = np.log1p((self.n - df + 0.5) / (df + 0.5)), max(1.0, lengths.mean() if self.n else 1.0)
        else:
            idf, mean = corpus.idf[np.frombuffer(buckets, np.int32, top)], corpus.mean
        norm = K1 * (1 - B + B * lengths / mean)
        order = np.argsort(term, kind="stable")
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=top))))
        self.docs = doc[order]
        self.weights = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order]

    def scores(self, doc: int) -> np.ndarray:
        terms = self.doc_terms[self.doc_ends[doc]:self.doc_ends[doc + 1]]
        at = places(self.ends, terms)
        return np.bincount(self.docs[at], self.weights[at], self.n)


class Packer:
    """Fills windows of ``size`` tokens; what does not fit goes on in the next."""

    def __init__(self, size: int):
        self.size, self.window, self.left, self.full = size, [], size, []

    def put(self, doc, start: int, length: int) -> int:
        """Put tokens of a document into the open window; how many fitted."""
        n = min(length, self.left)
        if n:
            self.window.append((doc, start, n, self.size - self.left))
            self.left -= n
        if not self.left:
            self.full.append(self.window)
            self.window, self.left = [], self.size
        return n

    def tail(self) -> None:
        """Split the open window at powers of two, which need no padding."""
        window, fill = self.window, self.size - self.left
        self.window, self.left = [], self.size
        for bit in reversed(range(fill.bit_length())):
            if not fill >> bit & 1:
                continue
            part, room = [], 1 << bit
            while room:
                doc, start, n, _ = window[0]
                take = min(n, room)
                part.append((doc, start, take, (1 << bit) - room))
                room -= take
                window[0:1] = [(doc, start + take, n - take, 0)] if take < n else []
            self.full.append(part)


def fill(packer: Packer, docs: list, terms: list[np.ndarray], sizes: list[int], corpus: Corpus | None = None,
         buckets: array | None = None) -> None:
    """Put all ``docs`` into windows.  The seed is what is left of the document
    that the last window cut, else the first unused one; the index returns its
    neighbours, best first, and those still unused fill the window."""
    index = Index(terms, corpus, buckets)
    unused = np.ones(len(docs), bool)
    ahead, seed, done = 0, None, 0
    while True:
        if seed is None:
            while ahead < len(docs) and not unused[ahead]:
                ahead += 1
            if ahead == len(docs):
                return
            seed, done = ahead, 0
            unused[seed] = False
        before = len(packer.full)
        done += packer.put(docs[seed], done, sizes[seed] - done)
        if done < sizes[seed]:
            continue
        own, seed = seed, None
        if len(packer.full) > before:
            continue
        scores = index.scores(own)
        rest = np.flatnonzero(unused)
        for i in rest[np.argsort(-scores[rest], kind="stable")].tolist():
            unused[i] = False
            before = len(packer.full)
            done = packer.put(docs[i], 0, sizes[i])
            if len(packer.full) > before:
                if done < sizes[i]:
                    seed = i
                break


def _keyed(docs: DataFrame, id_col: str, text_col: str, like_col: str | None) -> DataFrame:
    """Every row of ``docs`` with its number ``row``, words and word hashes,
    written; and, in rows of their own (``row`` null), the frequencies of the
    words by bucket, summed over a partition."""
    like = F.lit(0).cast("long") if like_col is None else F.xxhash64(F.col(like_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                       F.col(text_col).alias("t"), like.alias("part"))
    names = [f"k{j}" for j in range(KEYS)]
    fields = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("t", pa.string()),
                        ("part", pa.int64()), ("words", pa.int64()), ("size", pa.int64()), *[(x, pa.int64()) for x in names],
                        ("bucket", pa.list_(pa.int32())), ("held", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros(BUCKETS, np.int64), TaskContext.get().partitionId() << 33
        for b in batches:
            n, keys, sizes = b.num_rows, [np.zeros((0, KEYS), np.int64)], [np.zeros(0, np.int64)]
            for every, some in word_hashes(b.column("t")):
                keys.append(smallest(every, some))
                sizes.append(some)
                pairs = np.sort(np.repeat(np.arange(len(some)), some) * BUCKETS + every % BUCKETS)
                held += np.bincount(pairs[np.diff(pairs, prepend=-1) != 0] % BUCKETS, minlength=BUCKETS)
            keys, sizes = np.concatenate(keys), np.concatenate(sizes)
            chars = pc.fill_null(pc.utf8_length(b.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + n)), b.column("doc"), b.column("text_hash"), b.column("t").cast(pa.string()),
                b.column("part"), pa.array(sizes.astype(np.int64)), pa.array(chars), *[pa.array(keys[:, j]) for j in range(KEYS)],
                pa.nulls(n, fields.field("bucket").type), pa.nulls(n, fields.field("held").type)], schema=fields)
            number += n
        pa.default_memory_pool().release_unused()
        seen = np.flatnonzero(held).astype(np.int32)
        for i in range(0, len(seen), 1 << 16):
            some = seen[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, f.type) for f in fields][:-2] + [pa.array([some], fields.field("bucket").type),
                                                              pa.array([held[some]], fields.field("held").type)], schema=fields)

    types = {pa.string(): "string", pa.int64(): "long"}
    schema = ", ".join(f"{f.name} {types.get(f.type) or 'array<int>' if f.name != 'held' else 'array<long>'}" for f in fields)
    return scratch(rows.mapInArrow(run, schema), "packing-rows")


def _corpus(keyed: DataFrame, n: int, words: int) -> Corpus:
    """Frequencies by bucket of all documents: at most ``BUCKETS`` rows."""
    got = (keyed.where("row IS NULL").select(F.explode(F.arrays_zip("bucket", "held")).alias("x"))
           .groupBy("x.bucket").agg(F.sum("x.held").alias("held")).toArrow())
    held = np.zeros(BUCKETS, np.int64)
    held[got.column("bucket").to_numpy()] = got.column("held").to_numpy()
    return Corpus(n, words / max(1, n), held)


def _dealt(keyed: DataFrame) -> tuple[DataFrame, Corpus]:
    """The rows in partitions of about ``PART`` characters, sorted by their
    smallest word hashes.  All rows of one smallest hash come into the same
    partition, unless they are over a quarter of a partition: then they are cut
    by their other hashes into parts of that size.  Rows with the same hashes
    throughout are cut by row number beyond that size."""
    part = PART // 4
    rows = keyed.where("row IS NOT NULL").drop("bucket", "held")
    total = rows.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("size").alias("size")).first()
    corpus = _corpus(keyed, total["n"], total["words"] or 0)
    parts = max(1, -(-(total["size"] or 0) // PART))
    names = [f"k{j}" for j in range(KEYS)]

    def cuts(by: list[str], name: str) -> DataFrame:
        """Groups that are cut, at most four a partition, and into how many."""
        return F.broadcast(rows.groupBy(*by).agg(F.ceil(F.sum("size") / part).alias(name)).where(F.col(name) > 1))

    dealt = (rows.join(cuts(["part", "k0"], "cuts"), ["part", "k0"], "left")
             .join(cuts(["part", *names], "row_cuts"), ["part", *names], "left")
             .withColumn("cut", F.coalesce(F.pmod(F.xxhash64(*names), "cuts"), F.lit(0)))
             .withColumn("row_cut", F.coalesce(F.pmod(F.xxhash64("row"), "row_cuts"), F.lit(0)))
             .repartition(int(parts), "part", "k0", "cut", "row_cut")
             .sortWithinPartitions("part", *names, "text_hash", "doc", "row"))
    return dealt.select("doc", "text_hash", "t", *names), corpus


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text", like_col: str | None = None, shard: int = SHARD) -> DataFrame:
    """Every row of ``docs`` as pieces in sequences of at most ``size`` tokens:
    ``doc, text_hash, start, length, ids, doc_tokens, sequence_id, offset,
    shard``, one row per piece; ``ids`` are little-endian unsigned 32-bit numbers.

    A document is its token ids (tokenizers file ``tokenizer_path``, without
    special tokens) and then ``end_id``.  Documents are sorted by ``like_col``
    (a language, say; none: all are alike) and their smallest word hashes, so
    copies and texts that share most of their words stand together wherever
    they come from; an index shard is a run of ``shard`` to twice as many
    characters of that order, which ends where the smallest hash changes.  Document frequencies and the mean length are those of all
    documents.  Words share a frequency if they share one of 2^20 buckets.
    Within a shard each window starts from a seed and takes its unused BM25
    neighbours, best first; the last one is cut where the window is full and
    goes on as the next seed.  A window left open at the end of a shard goes on
    in the next one; at the end of a partition it is split at powers of two.
    So sequences are full or a power of two long, and nothing is padded.  Ties
    go by the order of the rows in their shard.

    The keyed texts are written once; a lost task is run again from there.  A
    word hash that holds a third of the rows is cut over many partitions.  Null
    and empty texts are the end id alone.  Texts longer than a window run on
    over several.  Repeated rows are packed row by row; null ids are carried
    through; other columns are not read.  An empty table gives an empty
    result."""
    ready(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    rows, corpus = _dealt(_keyed(docs, id_col, text_col, like_col))
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    fields = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("shard", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(spec)
        packer, number = Packer(size), TaskContext.get().partitionId() << 32
        first = number

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            got = []
            for k, window in enumerate(packer.full):
                got += [(d[0], d[1], start, n, d[2][start:start + n].astype("<u4").tobytes(), len(d[2]), number + k, offset,
                         d[3]) for d, start, n, offset in window]
            number += len(packer.full)
            packer.full = []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got, strict=True), fields,
                                                                                      strict=True)], schema=fields)

        for k, part in enumerate(_shards(batches, shard)):
            if words.table.n > REMEMBERED:
                words.forget()
            got = words.words([t for _, _, t in part])
            docs_ = [(d, h, np.append(got.tokens(x), np.int32(end_id)), first + k) for (d, h, _), x in zip(part, got.terms, strict=True)]
            fill(packer, docs_, got.terms, [len(d[2]) for d in docs_], shared.value, got.buckets)
            yield from out()
            del got, docs_, part
            pa.default_memory_pool().release_unused()
        packer.tail()
        yield from out()

    return rows.mapInArrow(run, "doc long, text_hash long, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long, shard long")


_WORD_IDS: dict[int, WordIds] = {}


def _word_ids(spec: str) -> WordIds:
    """One word table for all tasks of a worker."""
    key = hash(spec)
    if key not in _WORD_IDS:
        _WORD_IDS[key] = WordIds(spec)
    return _WORD_IDS[key]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    """Runs of at least ``limit`` characters.  A run ends where the smallest
    word hash changes; beyond one and a half times the limit where any hash
    does; at twice the limit."""
    part, n, last = [], 0, []
    names = ["doc", "text_hash", "t", *[f"k{j}" for j in range(KEYS)]]
    for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
        for doc, text_hash, t, *keys in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            if n >= limit and (keys[0] != last[0] or keys != last and 2 * n >= 3 * limit or n >= 2 * limit):
                yield part
                part, n = [], 0
            part.append((doc, text_hash, t))
            last = keys
            n += len(t or "") + ROW
    if part:
        yield part
