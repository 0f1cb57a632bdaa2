"""SentencePiece, packing and sharding: exact round trips."""

import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brook.llm import packing, sentencepieces, shards

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
ODD = ["", " ", "   a  b   ", "▁x ▁▁y\n\n z\t", "it's <|endoftext|> <|ENDOFTEXT|> Don't x'' é é ﬁ ② 3.14,,", "汉字 \u0000  z\x1cq 😀😀",
       "İstanbul ΑΣ ≮ É, ÀÉ! ß× ÷ µ", "a" * 20_000, "… , …, x.…", "Word, word. WORD!! (word) o'clock, it's. we'll"]


@pytest.fixture(scope="module")
def texts(spark, documents):
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    return documents.select("doc_id", "text").union(more)


def test_sentencepiece(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r["doc_id"]: r["text"] or "" for r in texts.collect()}
    got = {r["doc"]: (r["ids"], r["decoded"]) for r in sentencepieces.encode(texts, PIECES).collect()}
    assert got == {i: (sp.encode(t), sp.decode(sp.encode(t))) for i, t in rows.items()}


def test_sentencepiece_odd_rows(spark, table):
    got = sentencepieces.encode(table, PIECES)
    assert got.count() == table.count() and sentencepieces.encode(table.limit(0), PIECES).count() == 0
    back = sentencepieces.decode(got.select("ids"), PIECES)
    assert {r["decoded"] for r in back.collect()} == {(r["text"] or "").replace("▁", " ") for r in table.collect()}
    assert sentencepieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), PIECES).first()["decoded"] is None


def test_packing(texts):
    tok = Tokenizer.from_file(WORDS)
    rows = {r["doc_id"]: r["text"] or "" for r in texts.collect()}
    got = packing.pack(texts, WORDS).toPandas()
    assert set(got.doc) == set(rows)
    for doc, g in got.sort_values("start").groupby("doc"):
        ids = np.frombuffer(b"".join(g.ids), "<u4").tolist()
        assert ids == [*tok.encode(rows[doc], add_special_tokens=False).ids, 2]
        assert g.start.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and (g.doc_tokens == len(ids)).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist()
        total = int(g.length.sum())
        assert total <= 4096 and total & (total - 1) == 0  # full, or a power of two: no padding


def test_packing_neighbours():
    """A window takes the seed's best match first."""
    terms = [np.array(x) for x in ([1, 2, 3, 4], [9, 9, 8, 8], [1, 2, 3, 5], [7, 9, 6, 6])]
    packer = packing.Packer(8)
    packing.fill(packer, [(i, 0, None) for i in range(4)], terms, [4, 4, 4, 4])
    assert [[p[0][0] for p in w] for w in packer.full] == [[0, 2], [1, 3]]


def test_packing_scores():
    """Scores against BM25 written out, frequencies from a larger corpus."""
    rng = np.random.default_rng(3)
    every = [[f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 50] for _ in range(80)]
    held = np.zeros(packing.BUCKETS, np.int64)
    for d in every:
        for w in set(d):
            held[packing.word_hash(w) % packing.BUCKETS] += 1
    mean = np.mean([len(d) for d in every])
    names = sorted({w for d in every for w in d})
    buckets = packing.array("i", [packing.word_hash(w) % packing.BUCKETS for w in names])
    index = packing.Index([np.array([names.index(w) for w in d]) for d in every[:30]],
                          packing.Corpus(80, float(mean), held), buckets)
    for q in range(30):
        want = np.zeros(30)
        for w in set(every[q]):
            n = sum(w in d for d in every)
            for i, d in enumerate(every[:30]):
                tf = d.count(w)
                if sum(w in x for x in every[:30]) > 1:
                    want[i] += np.log1p((80 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(q), want, rtol=1e-5)


def test_packing_statistics_and_reach(spark, documents):
    """Frequencies of the whole corpus, whatever its partitions are; equal
    texts share a shard wherever they stand; a hot text is cut."""
    docs = documents.select("doc_id", "text").union(documents.select(F.col("doc_id") + 10_000, "text")).repartition(5)
    keyed = packing._keyed(docs, "doc_id", "text", None)
    dealt, corpus = packing._dealt(keyed)
    texts = [r["text"] or "" for r in docs.collect()]
    held = np.zeros(packing.BUCKETS, np.int64)
    for t in texts:
        held[list({packing.word_hash(w) % packing.BUCKETS for w in re.split(r"[\x20\x09-\x0D]+", t) if w})] += 1
    want = packing.Corpus(len(texts), sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts) / len(texts), held)
    assert np.array_equal(corpus.idf, want.idf) and abs(corpus.mean - want.mean) < 1e-9
    assert dealt.count() == len(texts)
    got = packing.pack(docs, WORDS, shard=60_000).select("doc", "shard").distinct().toPandas()
    assert got.shard.nunique() > 3
    shard = dict(zip(got.doc, got.shard, strict=True))
    short = [r["doc_id"] for r in documents.where("length(text) < 10000").collect()]  # longer ones may fill a run
    pairs = [(d, d + 10_000) for d in short]
    assert len(pairs) > 50
    assert all(shard[a] == shard[b] for a, b in pairs)
    hot = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("the same words " * 2_000).alias("text"))
    dealt, _ = packing._dealt(packing._keyed(hot, "doc_id", "text", None))
    sizes = dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(sizes) > 2 and sizes.sum() == 4_000 and sizes.max() < 2_500


def test_packing_word_hashes():
    """Equal words have equal hashes wherever they stand, A-Z as a-z; others differ."""
    texts = [*ODD, None, "", "x" * 70_000 + " y", "ab ba a b Ab\taB", " lead", "trail "]
    got = [(h.tolist(), n.tolist()) for h, n in packing.word_hashes(pa.array(["skipped", *texts], pa.large_string())[1:])]
    hashes, sizes = [h for x, _ in got for h in x], [n for _, x in got for n in x]
    words = [[w.lower() for w in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if w] for t in texts]
    assert sizes == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))
    assert hashes == [packing.word_hash(w.decode()) for w in flat] and min(hashes) >= 0


def test_packing_smallest_hashes():
    rng = np.random.default_rng(5)
    runs = [rng.integers(0, 9, n) for n in (0, 1, 5, 0, 30, 2, 0)]
    got = packing.smallest(np.concatenate(runs).astype(np.int64), np.array([len(r) for r in runs]))
    for r, g in zip(runs, got.tolist(), strict=True):
        assert g == (sorted(set(r.tolist())) + [packing.NONE] * 3)[:3]


def test_packing_remembers_little():
    """Remembered words cost few bytes each, and their ids stay the library's,
    from call to call, after forgetting, and if hashes are equal."""
    import tracemalloc

    tok = Tokenizer.from_file(WORDS)
    rng = np.random.default_rng(9)
    drawn = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyzéß"), (60_000, 9))]
    texts = [" ".join(drawn[i:i + 200]) + "," for i in range(0, len(drawn), 200)]
    with open(WORDS, encoding="utf-8") as f:
        words = packing.WordIds(f.read())

    def same(some):
        got = words.words(some)
        assert [got.tokens(t).tolist() for t in got.terms] == [tok.encode(t or "", add_special_tokens=False).ids for t in some]
        assert len(got.buckets) == len(got.ends) - 1

    words.words(["warm"])
    tracemalloc.start()
    words.words(texts)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert words.table.n > 60_000 and kept < 120 * 60_000
    n = words.table.n
    same([*texts[:20], *ODD, None])
    same([*ODD, None, *texts[:3], " ", "lead <| x|>", "Word word, <|x|>"])
    assert words.table.n < n + 200
    words.forget()
    assert words.table.n == 0
    same(texts[5:25])
    same([""])
    same([])


def test_packing_equal_hashes(monkeypatch):
    """Parts with one hash are told apart by the other."""
    tok = Tokenizer.from_file(WORDS)
    own = packing._hash_each
    monkeypatch.setattr(packing, "_hash_each", lambda words, kind=0: own(words, kind) % 3 if kind == 0 else own(words, kind))
    with open(WORDS, encoding="utf-8") as f:
        words = packing.WordIds(f.read())
    for texts in (["one two three four five", "six, seven."], ["five six seven eight nine ten", "two, eleven!"]):
        got = words.words(texts)
        assert [got.tokens(t).tolist() for t in got.terms] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_odd_rows(table):
    got = packing.pack(table, WORDS, size=64)
    assert got.groupBy().sum("length").first()[0] == sum(
        {(r["doc"], r["text_hash"]): r["doc_tokens"] * (2 if r["doc"] == 7 else 1) for r in got.collect()}.values())
    assert packing.pack(table.limit(0), WORDS).count() == 0


def test_shards(documents):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    got = shards.shard(documents, 6).toPandas()
    assert {r.doc: (r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples()} == {
        i: (len(t) + 8, zlib.crc32(t)) for i, t in rows.items()}
    by = got.groupby("shard").agg(n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"), size=("size", "sum"))
    assert len(by) == 6 and (by.n == by.top + 1).all() and (by.n == by.u).all()
    assert by["size"].max() <= 1.1 * by["size"].min()


def test_shards_hot_group(spark):
    """A third of all rows with one text is spread; smaller groups stay whole."""
    rows = [(i, "same text" if i % 3 == 0 else f"text number {i // 4}") for i in range(1200)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    by = got.groupby("shard").agg(n=("slot", "count"), top=("slot", "max"), size=("size", "sum"))
    assert (by.n == by.top + 1).all() and by["size"].max() <= 1.1 * by["size"].min()
    got["text"] = got.doc.map(dict(rows))
    assert (got[got.text != "same text"].groupby("text").shard.nunique() == 1).all()


def test_shards_odd_rows(table):
    got = shards.shard(table, 3)
    assert got.count() == table.count() and got.where("size = 8 AND text_crc32 = 0").count() == 2
    assert shards.shard(table.limit(0), 3).count() == 0
