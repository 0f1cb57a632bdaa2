"""Hard negatives, collocations and chat formatting against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brook.llm import chats, collocations, negatives


def plain_negatives(rows, anchor, positives=5, negatives_=10, low=30, high=90):
    """All pairs: rows of (id, vector, label)."""
    ok = [(i, np.floor(256 * np.array(v, float)).astype(np.int64).tolist(), lab) for i, v, lab in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = Counter()
    for k, (i, v, lab) in enumerate(ok):
        if i is None or not anchor(i):
            continue
        score = [(sum(x * y for x, y in zip(v, w, strict=True)), j, m, h) for h, (j, w, m) in enumerate(ok) if h != k and len(w) == len(v)]
        for s, j, _, _ in sorted((x for x in score if x[2] == lab), key=key)[:positives]:
            hard = sorted((x for x in score if x[2] != lab and low * s <= 100 * x[0] <= high * s), key=key)[:negatives_]
            for r, (t, n, _, _) in enumerate(hard):
                out[(i, j, r + 1, n, s, t)] += 1
    return out


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, score int")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **more)
    return Counter(map(tuple, got.select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("dim", [3, 20, 64])
def test_hard_negatives(spark, dim, monkeypatch):
    """Clusters, a vector that many rows hold, a label with half of the rows; in small tiles and in one."""
    rng = np.random.default_rng(dim)
    centre = rng.standard_normal((6, dim))
    rows = [(i, (centre[i % 6] + rng.standard_normal(dim) * rng.choice([0.1, 1.0])).tolist(), int(rng.choice([0, 0, 0, 1, 2, 3])))
            for i in range(400)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert sum(want.values()) > 500
    assert mined(spark, rows) == want
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 17)
    assert mined(spark, rows) == want


def test_hard_negatives_odd_rows(spark):
    """Nulls, non-finite and too long vectors, lengths that differ, ids that repeat or are missing, negative scores, an
    empty table, no anchors."""
    rows = [(0, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (10, [0.9, 0.5], 1), (None, [0.8, 0.4], 1), (3, [0.5, 0.1], 2), (4, [0.5, 0.1], 2),
            (4, [0.5, 0.1], 2), (5, None, 2), (6, [None, 1.0], 2), (7, [float("nan"), 1.0], 2), (8, [float("inf"), 1.0], 2),
            (9, [0.5, 0.2], None), (20, [1.0, 0.5, 0.5], 1), (21, [0.7, 0.5, 0.5], 1), (22, [0.4, 0.2, 0.3], 3), (30, [-1.0, -0.5], 4),
            (31, [0.0, 0.0], 4), (40, [], 5), (41, [], 5), (42, [], 6), (50, [0.4, 0.3], 2), (None, [0.3, 0.2], 2)]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows + [(60, [1e30, 1.0], 1), (61, [1e8, 2e8], 2)]) == want
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])


def test_exact_products():
    big = np.array([[2 ** 30, 3], [5, 7]])
    assert negatives.products(big, big).tolist() == [[2 ** 60 + 9, 5 * 2 ** 30 + 21], [5 * 2 ** 30 + 21, 74]]


@given(st.integers(0, 40), st.integers(0, 2 ** 32))
@settings(max_examples=60, deadline=None)
def test_bounds_hold(dim, seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.standard_normal((9, dim)) * rng.choice([1, 50, 3000], (9, 1)))
    s = negatives.Summaries(dim, *negatives.summaries(x))
    every = np.arange(9)
    true = x @ x.T
    last = None
    for level in range(len(negatives.LEVELS)):
        low, high = s.bounds(level, every, s, every)
        assert (low <= true).all() and (true <= high).all()
        if last is not None:  # finer segments never say less, but for rounding
            assert (low >= last[0] - 1e-6 * (1 + np.abs(true).max(initial=0))).all()
        last = low, high


def plain_collocations(docs, longest, least, covered, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inner = defaultdict(int)
    for (lang, w), v in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner[lang, w[i:i + m]] = max(inner[lang, w[i:i + m]], v)
    out = []
    for lang in n:
        rows = []
        for (of, w), a in f.items():
            if of == lang and len(w) > 1 and 100 * inner[lang, w] < covered * a:
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                s, k = min(cuts)
                rows.append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def ranked(docs, **more):
    got = collocations.collocations(docs, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("longest", "least", "trigger", "covered"), [(5, 4, 3, 100), (5, 3, 1, 80), (2, 5, 32, 100), (3, 3, 2, 100), (6, 4, 5, 100)])
def test_collocations(spark, longest, least, trigger, covered):
    """Copies, a passage in many texts, a word that is everywhere, pieces of one word repeated."""
    rng = np.random.default_rng(longest)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ÀB", "the", "the", "the"]
    text = lambda k: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(k))
    rows = [(lang, text(int(rng.integers(1, 120)))) for lang in ("en", "en", "de", None, "und") for _ in range(12)]
    rows += [("en", "Same Passage of some words that many hold, and more " + t) for _, t in rows[:9]] + rows[:5]
    rows += [("de", "a " * 60), ("xx", "a a a a a a"), ("yy", None), ("yy", ""), ("zz", " .,\n\t")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, chunk string")
    got = ranked(frame, longest=longest, least=least, covered=covered, trigger=trigger, top=30)
    assert got == plain_collocations(rows, longest, least, covered, 30)
    assert len(got) > 30


def test_collocations_of_corpus(documents):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    got = ranked(documents, least=8)
    assert got == plain_collocations(rows, 5, 8, 100, 2000) and got


def test_collocations_odd_tables(spark):
    kind = "lang string, text string"
    assert ranked(spark.createDataFrame([], kind)) == []
    assert ranked(spark.createDataFrame([("en", None), (None, "")], kind)) == []
    long = spark.createDataFrame([("en", "one two " * 200_000)], kind)
    assert ranked(long, longest=2, least=10) == [
        ("en", 1, "one two", 200_000, 200_000, 200_000, 400_000, 2000),
        ("en", 2, "two one", 199_999, 200_000, 200_000, 400_000, 1000 * 199_999 * 400_000 // 200_000 ** 2)]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=60), st.integers(1, 4), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_chunks_hold_each_phrase_once(words, overlap, trigger):
    hashes = np.array([h * 7919 + 1 for h, _ in words], np.uint64)
    piece = np.cumsum(np.array([step == 0 for _, step in words], int)) if words else np.zeros(0, int)
    starts, ends, tail = collocations.chunk_bounds(hashes, piece, overlap, trigger)
    seen = Counter()
    for s, e, last in zip(starts.tolist(), ends.tolist(), tail.tolist(), strict=True):
        assert len(set(piece[s:e].tolist())) == 1
        for i in range(s, e if last else e - overlap):
            seen.update((i, m) for m in range(1, overlap + 2) if i + m <= e)
    want = Counter((i, m) for i in range(len(words)) for m in range(1, overlap + 2) if i + m <= len(words) and piece[i] == piece[i + m - 1])
    assert seen == want


def test_filter_never_loses(spark):
    rows = [("en", f"w{i} x{i % 7}") for i in range(500)]
    kept = collocations.Filter.of(spark.createDataFrame(rows, "lang string, phrase string"), 500)
    h = lambda *w: np.uint64(xxhash.xxh64_intdigest(w[0].encode()))
    for lang, phrase in [*rows, ("en", "none here")]:
        x = np.array([h(lang)])
        for w in phrase.split(" "):
            x = collocations._mixed(x, np.array([h(w)]))
        assert kept.may(x)[0] or phrase == "none here"
    assert np.unpackbits(kept.words.view(np.uint8)).sum() <= 500


CONTROLS = ["### ", "</turn>", "\\", "\n", "### user\n", "\n</turn>\n", "x", " ", "é", "#", "<", "\r", "\u2028"]


@given(st.lists(st.tuples(st.lists(st.sampled_from(CONTROLS), max_size=4).map("".join), st.lists(st.sampled_from(CONTROLS), max_size=9).map("".join)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_chat_round_trip(turns):
    text = "".join(chats.settle(*t)[0] for t in turns)
    read = chats.parse(text)
    assert [(t.role, t.text) for t in read] == turns
    for t in read:
        assert chats.unescape(text[t.start:t.end]) == t.text
        assert all(m[0][0] == "\\" for m in chats.CONTROL.finditer(text[t.start:t.end]))
    for _, x in turns:
        assert chats.unescape(chats.escape(x)) == x


def test_chat_escapes_only_conflicts():
    assert chats.settle("user", "plain \\ text # 1")[0] == "### user\nplain \\ text # 1\n</turn>\n"
    assert chats.settle("a", "\\### Assistant: </turn> ok")[0] == "### a\n\\\\### Assistant: \\</turn> ok\n</turn>\n"
    assert chats.settle("a\nb", "")[0] == "### a\\nb\n\n</turn>\n"


@given(st.text(alphabet="#<\\/turn> \n", max_size=40))
def test_parser_reads_anything(text):
    assert "".join(text[t.start:t.end] for t in chats.parse(text)) is not None


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        by[conv].append((turn is not None, turn or 0, role, h - (1 << 64) * (h >> 63), text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for _, _, r, _, t in turns if r == "assistant")
        shown = sum(len(chats.settle(r, t)[0]) for _, _, r, _, t in turns)
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, _, t in turns)), len(learnt), sha(learnt), shown))
    return out


@pytest.mark.parametrize("part", [4_000_000, 50])
def test_chats(spark, part, monkeypatch):
    """Rows out of order, nulls, repeated turns and rows, control strings, a conversation with most rows, odd columns."""
    monkeypatch.setattr(chats, "PART", part)
    rng = np.random.default_rng(3)
    rows = [(c, t, ["user", "assistant", "system", None][int(rng.integers(4))], "".join(rng.choice(CONTROLS, 6)))
            for c in range(30) for t in range(int(rng.integers(1, 6)))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} </turn>") for t in range(1000)]
    rows += [(5, 1, "user", None), (5, 1, "user", "x"), (5, 1, "user", "x"), (None, 0, "user", "hi"), (None, None, "assistant", "yo"),
             (6, None, "assistant", ""), (7, 0, "assistant", "long " * 100_000)]
    frame = spark.createDataFrame([(*rows[i], 1, "y") for i in rng.permutation(len(rows))],
                                  "conv_id long, turn long, role string, text string, conv int, part string")
    parts = chats.format_chats(frame).cache()
    assert {tuple(r) for r in chats.read_back(parts).collect()} == plain_digests(rows)
    assert parts.where("conv = 99").count() > (1 if part == 50 else 0)
    of = defaultdict(list)
    for r in parts.orderBy("part").collect():
        of[r["conv"]].append(r)
        assert [(x["s"], x["e"]) for x in r["loss"]] == [(t.start, t.end) for t in chats.parse(r["formatted"]) if t.role == "assistant"]
    assert "".join(r["formatted"] for r in of[99]).count("### ") == 1000


def test_chats_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.read_back(chats.format_chats(empty)).collect() == []


def test_words_of_slices():
    """Arrays that start within their buffers, empty and null-free rows."""
    texts = pa.array(["skip me", "A b", "", "c.d  e", "..", "f"])[1:]
    words, row, piece = collocations.words_of(texts)
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"] and row.tolist() == [0, 0, 2, 2, 2, 4]
    assert [piece[i] == piece[i + 1] for i in range(5)] == [True, False, False, True, False]
