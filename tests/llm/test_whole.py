"""Cases in which an operator once did less than the whole job."""

import re

import numpy as np
from pyspark.sql import functions as F

from brook.llm import lines, pii, shards


def all_pairs(rows):
    """Lines that each document loses to any earlier one that shares a line with a word."""
    code, out, before = {}, {}, []
    for i, t in sorted(rows):
        x = np.array([code.setdefault(v, len(code) + 1) if re.search(r"[^\x20\x09-\x0D]", v) else 0 for v in t.split("\n")])
        out[i] = {k for y in before if (np.intersect1d(x, y) > 0).any() for k in lines.common_lines(y, x)}
        before.append(x)
    return out


def test_lines_whole(spark, documents):
    """Later holders are met as well: the cut is that of all pairs."""
    hand = [(1, "A\nB"), (2, "B\nA"), (3, "B\nA"), (4, "P"), (5, "P\nR\nR"), (6, "P\nR\nR"), (7, "S\nS"), (8, "S\nS"), (9, " \n "),
            (10, "p\nK\nL\nM\nq"), (0, "L\nM\nK\nL"), (11, "r\nK\nL\nM\nt"), (12, "V\nown\nW"), (13, "W\nmine\nV"), (14, "W\nours\nV")]
    for rows in (hand, [(r["doc_id"], r["text"]) for r in documents.collect()]):
        got = lines.line_cuts(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
        assert {r["doc"]: set(r["cut"] or ()) for r in got} == all_pairs(rows)
    assert all_pairs(hand)[3] == {0, 1} and all_pairs(hand)[6] == {0, 1, 2} and all_pairs(hand)[14] == {0, 2}
    assert lines.line_cuts(spark.createDataFrame([], "doc_id long, text string"), whole=True).count() == 0


def test_email_hints(spark):
    """Each way to spell an address out is proposed without a hint elsewhere."""
    texts = ["ann@example.org", "john at example.com", "john at example dot com", "john at example (dot) com", "john at example [dot] com",
             "john (at) example.com", "john(at)example.com", "john [at] example dot com"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = rows.select("i", F.filter(pii.candidates(F.col("text")), lambda c: c["kind"] == 0).alias("c"))
    assert {r["i"]: [(c["s"], c["e"]) for c in r["c"]] for r in found.collect()} == {i: [(0, len(t))] for i, t in enumerate(texts)}


def test_personal_data_rare_kind(spark):
    """A kind with a small share of the spans gets a threshold of its own."""
    rows = [(i, f"pay {'%04d' % (i % 9973)} call +1 415 55{i:05d} or mail u{i}@example.org") for i in range(6000)]
    rows += [(10_000 + i, f"host 2001:db8:{i:x}:1:2:3:4:{i % 7} is up") for i in range(40)]
    rows += [(20_000 + i, f"order number {i:013d} of the day") for i in range(300)]
    got = {r["doc"]: [tuple(x) for x in r["added"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(any(x[0] == 1 for x in got[10_000 + i]) for i in range(40)) == 40


def test_added_past_base(spark):
    """A span that is dropped for a base span drops no other."""
    span = "struct<kind:int,s:int,e:int,base:boolean,holds:boolean,f:array<double>>"
    f = [0.0] * 19
    cands = [(0, 0, 5, True, True, f), (1, 3, 20, False, True, f), (2, 15, 22, False, True, f)]
    model = type("M", (), {"trees": [], "treeWeights": []})()
    row = spark.createDataFrame([(cands,)], f"c array<{span}>").select(pii.Selector(model, {1: 0.0, 2: 0.0}).added(F.col("c")).alias("a")).first()
    assert [(x["kind"], x["s"], x["e"]) for x in row["a"]] == [(2, 15, 22)]


def test_shards_hot_group_one_id(spark):
    """Rows of a hot text that share an id, or have none, are spread as well."""
    rows = [((None if i % 6 else 7) if i % 3 == 0 else i, "same text" if i % 3 == 0 else f"text number {i}") for i in range(1200)]
    got = shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    by = got.groupby("shard").agg(n=("slot", "count"), top=("slot", "max"), u=("slot", "nunique"), size=("size", "sum"))
    assert len(got) == 1200 and (by.n == by.top + 1).all() and (by.n == by.u).all()
    assert by["size"].max() <= 1.1 * by["size"].min()
