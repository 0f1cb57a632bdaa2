"""Quality rules, personal data, licences, vectors, the pipeline."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brook.llm import embeddings, licenses, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(documents, table):
    for docs in (documents, table):
        rows = Counter()
        for r in docs.select("doc_id", "text").collect():
            t = r["text"] or ""
            w = WORD.findall(t)
            at = {}
            for i in range(len(w) - 7):
                at.setdefault(tuple(w[i:i + 8]), []).append(i)
            again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
            ls = [x for x in t.split("\n") if WORD.search(x)]
            rows[(r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(again))] += 1
        got = quality.quality_verdicts(docs)
        assert Counter((r["doc"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                       for r in got.collect()) == rows
    assert quality.quality_verdicts(table.limit(0)).count() == 0


def test_host_verdicts(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    heavy = " ".join(f"w#rd{i}" for i in range(30))
    rows = [(i, heavy if i < 190 else clean, "bad") for i in range(200)] + [(1000 + i, clean, "good") for i in range(200)]
    rows += [(2000, heavy, "good"), (2001, heavy, "small"), (2002, heavy, None), (2003, "too short", "good")]
    got = {r["doc"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i] for i in range(190)) and all(got[i] for i in range(190, 200))  # clean documents stay
    assert got[2000] and got[2002] and not got[2003]
    kept = quality.drop_rejected(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, ok in got.items() if ok}


def test_host_limit_follows_the_corpus(spark):
    """Hosts whose odds of failure are above twice the corpus's are not trusted, whatever the corpus's rate; equal hosts,
    few documents and a host near the mean are. Every document without a failed rule stays."""
    clean = " ".join(f"word{i}" for i in range(30))
    heavy = " ".join(f"w#rd{i}" for i in range(30))

    def verdicts(rates, n=400):
        rows = [(1000 * h + i, heavy if i < rate * n else clean, f"h{h}") for h, rate in enumerate(rates) for i in range(n)]
        rows += [(-1, heavy, "tiny"), (-2, heavy, "tiny")]
        got = {r["doc"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert all(got[i] for i, t, _ in rows if t == clean) and got[-1] and got[-2]
        return [got[1000 * h] for h in range(len(rates))]

    assert verdicts([0.03, 0.05, 0.04, 0.25, 0.03, 0.05]) == [True, True, True, False, True, True]  # far below one half
    assert verdicts([0.16, 0.17, 0.16, 0.18, 0.15]) == [True] * 5
    assert verdicts([0.5, 0.55, 0.9, 0.5, 0.6]) == [True, True, False, True, True]
    assert verdicts([0.1, 0.1, 0.14]) == [True] * 3


def test_personal_data(spark, table):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")),
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    odd = ["a@b.c_d@e.f x@y.z@q.r é bob@x.org. 1.2.3.4.5.6.7.8 256.1.1.1 000.00255.1.0", "4111 1111 1111 1111 and 4111-1111-1111-1111x",
           "+49 (0)30 1234-567 . +1 2 +1234567890123456", "x" * 3000 + "@" + "a." * 2000, None, ""]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for d in (docs, table):
        rows = {r["doc_id"]: r["text"] or "" for r in d.collect()}
        for r in pii.find(d).collect():
            t = rows[r["doc"]]
            want = [(i, m.start(), m.end()) for i, k in enumerate(plain) for m in re.finditer(plain[k], t) if holds(k, m.group())]
            assert [tuple(x) for x in r["base"]] == want
    assert pii.find(table.limit(0)).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert out[1] == "<CARD> and <CARD>x" and out[4] is None and out[5] == ""


def test_personal_data_added(spark):
    """Numbers that the base misses are added; their neighbours are not."""
    def card(i):
        body = f"4{i:014d}"
        return next(body + str(c) for c in range(10) if sum(
            (int(x) * (2 if k % 2 == 0 else 1) - 9 * (k % 2 == 0 and int(x) > 4)) for k, x in enumerate(body + str(c))) % 10 == 0)

    rows = [(i, f"pay by card {card(i * 7919)} {card(i * 104729)} please") for i in range(400)]
    rows += [(1000 + i, f"order number {i:013d} of the day") for i in range(400)]
    got = {r["doc"]: [tuple(x) for x in r["added"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(got[i] == [(2, 12, 28), (2, 29, 45)] for i in range(400))
    wrong = sum(bool(got[1000 + i]) for i in range(400))
    assert right >= 380 and wrong <= 60


def test_licences_by_hand(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "no notice"), (3, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0."),
            (4, "z/x.py", "nothing"), (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/q.py", ""),
            (7, None, None), (8, "top.py", "x"), (None, "a/b/c/d/e.py", "x"), (6, "a/q.py", "")]
    files = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, path string, text string, licence int")
    got = Counter((r["doc"], r["own_licence"], r["licence"], r["inherited_from"]) for r in licenses.scan(files).collect())
    assert got == Counter({(1, "MIT", "MIT", None): 1, (2, None, "GPL-3.0", "a/b"): 1, (3, "Apache-2.0", "Apache-2.0", None): 1,
                           (4, None, None, None): 1, (5, "GPL-3.0", "GPL-3.0", None): 1, (6, None, "MIT", "a"): 2,
                           (7, None, None, None): 1, (8, None, None, None): 1, (None, None, "GPL-3.0", "a/b"): 1})
    assert licenses.scan(files.limit(0)).count() == 0


def _wrapped(text, mark, width=68, blank_after=()):
    """A text in comment lines, a blank comment line after some words."""
    out, line = [], mark
    for k, w in enumerate(text.split()):
        if len(line) + len(w) > width or k in blank_after:
            out += [line] + ([mark.rstrip()] if k in blank_after else [])
            line = mark
        line += (" " if line else "") + w
    return "\n".join([*out, line])


def test_licence_files_and_headers(spark):
    """Whole licence files, headers wrapped in comments of several kinds, identifier lines; and texts that only mention one."""
    of = licenses.TEMPLATES
    long = lambda name: max(of[name], key=len)
    own = "Copyright (c) 2021 Ann Example <ann@example.org>. All rights reserved."
    code = "\n\nimport os\n\n\ndef main():\n    return os.getcwd()\n"
    files = {
        "MIT": "MIT License\n\n" + own + "\n\n" + _wrapped(long("MIT"), ""), "ISC": own + "\n\n" + _wrapped(long("ISC"), "", 80),
        "BSD-2-Clause": own + "\n\n" + _wrapped(long("BSD-2-Clause"), ""), "BSD-3-Clause": own + "\n" + _wrapped(long("BSD-3-Clause"), "")}
    headers = {
        "GPL-3.0": "# frob - a tool\n#\n" + _wrapped(long("GPL-3.0"), "#", 60, (40, 70)) + code,
        "GPL-2.0": "/*\n" + _wrapped(long("GPL-2.0"), " *", 70) + "\n */" + code,
        "LGPL-2.1": "/*\n" + _wrapped(long("LGPL-2.1"), "   ", 64) + "\n*/" + code,
        "AGPL-3.0": "<!--\n" + _wrapped(long("AGPL-3.0"), "", 66) + "\n-->" + code,
        "MPL-2.0": _wrapped(long("MPL-2.0"), "//", 50) + code, "Apache-2.0": "# " + own + "\n#\n" + _wrapped(long("Apache-2.0"), "#", 72) + code,
        "EPL-2.0": _wrapped(long("EPL-2.0"), " *", 60) + code, "MIT": "--\n" + _wrapped(long("MIT"), "--", 60, (30, 60)) + code,
        "BSD-3-Clause": "; " + own + "\n;\n" + _wrapped(long("BSD-3-Clause"), ";", 60) + code,
        "Unlicense": _wrapped(long("Unlicense"), "%", 60) + code}
    lines = {"MIT": "// SPDX-License-Identifier: MIT" + code, "GPL-2.0": "/* SPDX-License-Identifier: GPL-2.0-or-later */" + code,
             "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0" + code, "ISC": "<!-- SPDX-License-Identifier: ISC -->" + code}
    titles = {"GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy.",
              "Apache-2.0": "   Apache License\n   Version 2.0, January 2004\n   \n   TERMS AND CONDITIONS"}
    none = ["# SPDX-License-Identifier: Nobody-9" + code, "The licence office of the town opens at nine, and a driving licence costs ten.",
            own, "# " + "word " * 30 + "\n" * 3 + "license", "", "\x00 # license \x00"]
    rows = [(f"{name}/LICENSE", text, name) for name, text in files.items()]
    rows += [(f"{kind}{name}/x.src", text, name) for kind, group in (("h", headers), ("l", lines), ("t", titles)) for name, text in group.items()]
    rows += [(f"n{i}/x.src", text, None) for i, text in enumerate(none)]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["path"]: r["own_licence"] for r in licenses.scan(frame).collect()}
    assert got == {p: name for p, _, name in rows}


def test_licence_cosine(spark):
    passages = [(1, "Licensed under the MIT licence of old", 3), (2, "All copyright reserved by nobody", 1)]
    got = licenses.match_passages(spark.createDataFrame(passages, "unit long, passage string, n long")).collect()
    terms = lambda t: Counter(re.findall(licenses.WORD, t.lower()))
    docs = [(terms(p), n) for _, p, n in passages] + [(terms(t), 1) for ts in licenses.TEMPLATES.values() for t in ts]
    df = Counter()
    for c, n in docs:
        for w in c:
            df[w] += n
    total = sum(n for _, n in docs)
    weight = lambda c: {w: f * (math.log((1 + total) / (1 + df[w])) + 1) for w, f in c.items()}
    cosine = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.hypot(*a.values()) / math.hypot(*b.values())
    want = {}
    for u, p, _ in passages:
        best = max((round(cosine(weight(terms(p)), weight(terms(t))), 6), k) for k, ts in licenses.TEMPLATES.items() for t in ts)
        if best[0] >= licenses.LEAST:
            want[u] = best
    assert {r["unit"]: (r["cosine"], r["licence"]) for r in got} == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((900, 16))
    near = np.concatenate([base[:60] + 0.09 * rng.standard_normal((60, 16)) for _ in range(6)])
    x = np.concatenate([base, near, base[:20]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, []), (5005, [1.0, 2.0]),
             (5006, [2.0, 4.0]), (None, [float(v) for v in x[0]])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vectors(vectors):
    x, frame = vectors
    got = {r["vec"]: (r["n_links"], r["component_id"]) for r in embeddings.link_vectors(frame).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (y @ y.T >= 0.95) & ~np.eye(len(y), dtype=bool)
    n = linked.sum(axis=1) + linked[0] + (np.arange(len(y)) == 0)  # one more copy of vector 0, without an id
    found = sum(got[i][0] for i in range(len(y)))
    assert found >= 0.99 * n.sum() and all(got[i][0] <= n[i] for i in range(len(y)))
    comp = np.arange(len(y))
    while True:
        low = np.array([min(comp[i], comp[linked[i]].min(initial=len(y))) for i in range(len(y))])
        if (low == comp).all():
            break
        comp = low
    assert np.mean([got[i][1] == comp[i] for i in range(len(y))]) >= 0.99
    assert [got[i] for i in (5000, 5001, 5002, 5003, 5004)] == [(0, i) for i in (5000, 5001, 5002, 5003, 5004)]
    assert got[5005] == (1, 5005) and got[5006] == (1, 5005) and got[None][1] == 0
    assert embeddings.link_vectors(frame.limit(0)).count() == 0


def test_vectors_of_doubles(vectors, spark):
    """Doubles are compared as doubles; ids that repeat are rows of their own; columns named like the operator's are not read."""
    x, frame = vectors
    some = frame.where("vec_id < 300")
    wide = some.selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding", "1 AS node", "2 AS key", "3 AS dim", "'x' AS v")
    assert sorted(tuple(r) for r in embeddings.link_vectors(wide).collect()) == sorted(tuple(r) for r in embeddings.link_vectors(some).collect())
    # The second component differs beyond the precision of floats: cosines of 0.95 with the first vector, one just below.
    y = (1 / 0.95 ** 2 - 1) ** 0.5
    rows = [(1, [1.0, 0.0]), (2, [1.0, y - 1e-10]), (3, [1.0, y + 1e-10]), (3, [-1.0, 0.0]), (4, [-1.0, -0.0])]
    got = sorted(tuple(r) for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (3, 1, 3), (4, 1, 3)]
    assert sorted(r["vec"] for r in embeddings.link_vectors(spark.createDataFrame([(7, [3, 4]), (8, [6, 8])], "vec_id long, embedding array<int>")).where("n_links = 1").collect()) == [7, 8]


def test_vector_tiles(vectors, monkeypatch):
    """A leaf beyond a tile is compared in blocks, with the same links."""
    _, frame = vectors
    some = frame.where("vec_id < 400")
    want = sorted(tuple(r) for r in embeddings.link_vectors(some).collect())
    monkeypatch.setattr(embeddings, "TILE", 60)
    assert sorted(tuple(r) for r in embeddings.link_vectors(some).collect()) == want


def test_pipeline_stages(spark, documents, table):
    import corpus_pipeline

    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == documents.columns
        seen.append((name, docs, out := spark.createDataFrame(out.collect(), documents.schema)))
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = seen
    kept = {r["doc"] for r in quality.quality_verdicts(a).where("kept").collect()}
    assert {r["doc_id"] for r in b.collect()} == kept
    assert c.count() == b.count() and d.count() < c.count() and e.count() == d.count()
    assert e.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.[a-z]+")).count() == 0
    assert e.where(F.length("text") != F.col("n_chars")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, e, "")
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == {r["doc_id"] for r in e.collect()}
