"""SimHash, line and substring deduplication against brute force."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brook.llm import common, lines, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def united(ids, pairs):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [4, 12])
def test_simhash_groups(documents, radius):
    rows = [(r["doc_id"], by_hand(r["text"])) for r in documents.collect()]
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= radius]
    want = united([i for i, _ in rows], pairs)
    got = {r["doc"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(documents, radius=radius).collect()}
    assert got == {i: (f, want[i]) for i, f in rows}


def test_simhash_odd_rows(table):
    got = simhash.simhash_groups(table).collect()
    assert len(got) == table.count()
    empty = {r["component_id"] for r in got if r["fp"] == 0}
    assert empty == {8}  # null, empty and blank texts are one group
    kept = simhash.drop_near_duplicates(table)
    assert kept.columns == table.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {5, 8} <= set(ids) and not {7, 9, 12} & set(ids) and None in ids
    assert simhash.drop_near_duplicates(table.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_roots(pairs):
    from brook.llm.links import roots

    a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    assert dict(enumerate(roots(13, a, b).tolist())) == united(range(13), pairs)


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + rng.integers(200, 400, (120, 2)).tolist()
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == united(ids, [p for p in pairs if p[0] != p[1]])
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_lines_by_hand(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    code, first, want = {}, {}, {}
    coded = {i: np.array([code.setdefault(x, len(code) + 1) if WORD.search(x) else 0 for x in t.split("\n")]) for i, t in rows}
    for i, t in rows:
        values, n = np.unique(coded[i], return_counts=True)
        once = [v for v in values[n == 1] if v]
        cut = {k for p in {first[v] for v in once if v in first} for k in lines.common_lines(coded[p], coded[i])}
        for v in once:
            first.setdefault(v, i)
        want[i] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
    got = {r["doc_id"]: r["text"] for r in lines.drop_common_lines(documents, whole=False).collect()}
    assert got == want and any(want[i] != t for i, t in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=14), st.lists(st.integers(1, 6), max_size=14))
def test_patience_aligns(a, b):
    got = lines.patience(np.array(a), np.array(b))
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    if a == b:
        assert len(got) == len(a)


@pytest.mark.parametrize("whole", [True, False])
def test_lines_odd_rows(table, whole):
    """Nulls in text and id, empty and very long texts, repeated rows, clashing columns, an empty table."""
    got = lines.drop_common_lines(table, whole=whole)
    assert got.columns == [*table.columns, "n_cut_lines"]
    rows = [(r["doc_id"], r["text"], r["n_cut_lines"]) for r in got.collect()]
    assert (6, "Other start\nend of it", 1) in rows
    assert rows.count((7, "", 3)) == 2 and (9, None, 0) in rows and (8, "", 0) in rows and (12, " \t\n ", 0) in rows
    assert (None, "text without an id, mail ann@example.org or +1 (415) 555-2671", 0) in rows
    assert len(rows) == table.count() and {n for i, _, n in rows if i in (5, 10, 11, 13)} == {0}
    assert lines.drop_common_lines(table.limit(0), whole=whole).count() == 0


def cut_by_hand(rows, window):
    first, out = {}, {}
    rows = sorted(rows, key=lambda r: r[0])
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    for i, t in rows:
        w = (t or "").encode().split()
        stay = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                stay[k:k + window] = [False] * window
        out[i] = (len(w), stay.count(False), b" ".join(x for x, ok in zip(w, stay, strict=True) if ok).decode())
    return out


def test_substrings_by_hand(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(75)]
    rows = []
    for i in range(60):
        words = [f"a{x}" for x in rng.integers(0, 400, rng.integers(0, 160))]
        k = int(rng.integers(0, 20))
        rows.append((i, " ".join(words + passage[k:k + int(rng.integers(40, 75))] + words[:5] * (i % 4))))
    rows += [(60, "the " * 300), (61, "the " * 120 + "end"), (62, rows[3][1]), (63, None), (64, "")]
    got = substrings.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()} == cut_by_hand(rows, 50)


def test_substrings_odd_rows(table):
    got = substrings.drop_repeated_windows(table)
    rows = [(r["doc"], r["n_words"], r["n_removed"]) for r in got.collect()]
    assert len(rows) == table.count()
    assert (10, 30_000, 0) in rows and (11, 30_001, 30_000) in rows and (None, 10, 0) in rows and rows.count((7, 10, 0)) == 2
    assert substrings.drop_repeated_windows(table.limit(0)).count() == 0
