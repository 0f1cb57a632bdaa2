import os

import pytest
from pyspark.sql import functions as F

from brook.operators import clean as C
from brook.operators import quality as Q
from brook.plans import views as V
from brook.plans.jobs import run_elt, run_scrape
from brook.sources import feeds as FD
from brook.sources import lake as L
from paths import SF001


def test_dated_path():
    assert L.dated_path("s3a://b/raw/", "2026-06-05") == "s3a://b/raw/2026/06/05/"
    assert L.dated_path(None, None, "s3a://x/") == "s3a://x/"
    with pytest.raises(ValueError):
        L.dated_path(None, "2026-06-05")


def test_landing_round_trip_and_split(spark, tmp_dir):
    a = V.articles(spark, SF001).withColumn("_source", F.lower(F.trim("category")))
    L.write_raw(a, f"{tmp_dir}/raw", "2024-06-01")
    back = L.raw_scan(spark, f"{tmp_dir}/raw")
    r = back.agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("bad"), F.count("id").alias("n")).first()
    assert (r.bad, r.n) == (0, a.count())
    assert set(back.columns) >= {"scrape_date", "_source", "_source_path"}
    cleaned = C.clean(back)
    good, bad = C.split(cleaned)
    audit = Q.audit(cleaned).first()
    assert audit.good_rows + audit.rejected_rows == audit.raw_rows == a.count()
    assert good.count() == audit.good_rows and bad.count() == audit.quarantined_rows
    assert good.join(bad, "id").count() == 0


def test_elt_job_gate_and_outputs(spark, tmp_dir):
    a = V.articles(spark, SF001).withColumn("_source", F.lower(F.trim("category")))
    L.write_raw(a, f"{tmp_dir}/raw/2024/06/01", "2024-06-01")
    # the articles view rejects ~21.5 %: above the 20 % gate
    with pytest.raises(Q.GateError):
        run_elt(spark, f"{tmp_dir}/cur", source_base=f"{tmp_dir}/raw", date="2024-06-01")
    res = run_elt(spark, f"{tmp_dir}/cur", source_base=f"{tmp_dir}/raw", date="2024-06-01", max_reject_pct=50.0)
    assert res["good_rows"] + res["quarantined_rows"] == res["raw_rows"] == a.count()
    cur = L.curated_scan(spark, f"{tmp_dir}/cur", required=["title", "published_date"])
    assert cur.count() == res["good_rows"]
    # the trainer's way in: a partition glob with basePath keeps the partition column
    glob = L.curated_scan(spark, f"{tmp_dir}/cur/run_date=*/published_date=*/*.parquet", required=["title", "published_date"],
                          base_path=f"{tmp_dir}/cur")
    assert glob.count() == res["good_rows"]
    q = spark.read.parquet(L.quarantine_path(f"{tmp_dir}/cur"))
    assert {r._reject_reason for r in q.select("_reject_reason").distinct().collect()} <= set(C.REJECT_REASONS)


def test_quarantine_only_when_bad_rows(spark, tmp_dir):
    empty = spark.createDataFrame([], "id string, _reject_reason string")
    assert L.write_quarantine(empty, f"{tmp_dir}/d", run="r") == 0
    assert not os.path.exists(L.quarantine_path(f"{tmp_dir}/d"))


def test_curated_scan_errors(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        L.curated_scan(spark, f"{tmp_dir}/nothing")
    spark.range(3).write.parquet(f"{tmp_dir}/p")
    with pytest.raises(ValueError):
        L.curated_scan(spark, f"{tmp_dir}/p", required=["title"])


def test_manifest_scan_and_empty(spark, tmp_dir):
    with open(f"{tmp_dir}/m.json", "w") as fh:
        fh.write('[\n {"url": "u1", "format": "xml", "source": "a"},\n {"url": "u2", "format": "csv"}\n]\n')
    rows = sorted(L.manifest_scan(spark, f"{tmp_dir}/m.json").collect())
    assert [(r.url, r.format, r.source) for r in rows] == [("u1", "xml", "a"), ("u2", "csv", None)]
    with open(f"{tmp_dir}/e.json", "w") as fh:
        fh.write("[]")
    with pytest.raises(ValueError):
        L.manifest_scan(spark, f"{tmp_dir}/e.json")


FEEDS = {"http://feed/rss": b"<rss><channel><item><title>T1</title><link>http://a</link>"
                            b"<pubDate>Fri, 05 Jun 2026 21:00:00 +0000</pubDate></item></channel></rss>",
         "http://feed/csv": b"title,date\nT2,2026-06-05\n"}


def test_scrape_job(spark, tmp_dir):
    feeds = dict(FEEDS)

    def _fetch(url):  # a closure, so it ships to the workers by value
        return feeds[url]

    with open(f"{tmp_dir}/m.json", "w") as fh:
        fh.write('[{"url": "http://feed/rss", "format": "xml", "source": "r"},'
                 ' {"url": "http://feed/csv", "format": "csv", "source": "c"},'
                 ' {"url": "http://feed/missing", "format": "xml", "source": "m"}]')
    dest = run_scrape(spark, f"{tmp_dir}/m.json", dest_base=f"{tmp_dir}/raw", date="2026-06-05", fetcher=_fetch,
                      parallelism=2, payload_path=f"{tmp_dir}/payloads")
    assert dest.endswith("/2026/06/05/")
    back = L.raw_scan(spark, dest)
    rows = sorted((r._source, r.title) for r in back.collect())
    assert rows == [("c", "T2"), ("r", "T1")]


def test_payload_files_of_a_store(spark, tmp_dir):
    """Bytes are decoded as their declaration says; a missing file is an error row."""
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>caf\u00e9</title></item></channel></rss>'
    with open(f"{tmp_dir}/a.xml", "wb") as fh:
        fh.write(text.encode("latin-1"))
    rows = [(f"file:{tmp_dir}/a.xml", "XML", "s"), (f"file:{tmp_dir}/b.xml", None, None)]
    got = {r.url[-5:]: r for r in FD.read_payload_files(spark.createDataFrame(rows, "url string, format string, source string"),
                                                       tmp_dir).collect()}
    assert got["a.xml"].body == text and got["a.xml"].format == "xml" and got["a.xml"].error is None
    assert got["b.xml"].body is None and "no such file" in got["b.xml"].error and got["b.xml"].source.endswith("b.xml")


def test_payload_files_are_written_by_tasks(spark, tmp_dir):
    """One file a row in bounded folders, listed as Spark lists them; neither checksums nor a commit per file."""
    rows = [("xml", f"body {i} \u00e9") for i in range(25)] + [(None, None), ("XML", "a\nb"), ("XML", "a\nb")]
    listed = L.write_payload_files(spark.createDataFrame(rows, "format string, body string").coalesce(2), f"{tmp_dir}/f", files_per_folder=4)
    files = spark.read.format("binaryFile").load(f"{tmp_dir}/f")
    assert sorted(r.url for r in listed.collect()) == sorted(r.path for r in files.collect())
    got = FD.read_payload_files(listed.withColumn("source", F.lit("s")), f"{tmp_dir}/f").collect()
    assert sorted((r.format, r.body) for r in got) == sorted((f.lower() if f else "", f"{b or ''}\n") for f, b in rows)
    assert {r.error for r in got} == {None}
    folders = [names for _, _, names in os.walk(f"{tmp_dir}/f") if names]
    assert max(map(len, folders)) == 4 and not [x for names in folders for x in names if x.endswith(".crc")]


def test_elt_counts_every_row_and_keeps_rejects(spark, tmp_dir):
    """Counts come from the curated write; an input without rejects makes no quarantine."""
    schema = ("id string, source string, title string, link string, published_at string, summary string, category string,"
              " _scraped_at string, _source string")
    good = [(str(i), "s", "t", "l", "2024-01-02", None, "c", "x", "s") for i in range(3)]
    L.write_raw(spark.createDataFrame(good, schema), f"{tmp_dir}/r1", "2024-06-01")
    got = run_elt(spark, f"{tmp_dir}/c", source_path=f"{tmp_dir}/r1", run="1")
    assert (got["raw_rows"], got["good_rows"], got["quarantined_rows"]) == (3, 3, 0)
    assert not os.path.exists(L.quarantine_path(f"{tmp_dir}/c"))
    bad = [("9", "s", None, "l", "2024-01-02", None, "c", "x", "s")]
    L.write_raw(spark.createDataFrame(good + bad, schema), f"{tmp_dir}/r2", "2024-06-01")
    got = run_elt(spark, f"{tmp_dir}/c", source_path=f"{tmp_dir}/r2", run="2", gate=False)
    assert (got["raw_rows"], got["good_rows"], got["quarantined_rows"]) == (4, 3, 1)
    assert [r.id for r in spark.read.parquet(L.quarantine_path(f"{tmp_dir}/c")).collect()] == ["9"]


def test_curated_runs_keep_each_others_rows(spark, tmp_dir):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")  # even against a static session
    try:
        d1 = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, published_date string")
        L.write_curated(d1, f"{tmp_dir}/c", "published_date", run="1")
        L.write_curated(d1, f"{tmp_dir}/c", "published_date", run="1")
        L.write_curated(spark.createDataFrame([("c", "2024-01-02")], d1.schema), f"{tmp_dir}/c", "published_date", run="2")
        got = sorted((r.id, str(r.published_date)) for r in spark.read.parquet(f"{tmp_dir}/c").collect())
        assert got == [("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-02")]
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")


def test_quarantine_keeps_other_runs(spark, tmp_dir):
    rows = lambda *ids: spark.createDataFrame([(i, "bad_date") for i in ids], "id string, _reject_reason string")
    L.write_quarantine(rows("a", "b"), f"{tmp_dir}/d", run="1")
    L.write_quarantine(rows("c"), f"{tmp_dir}/d", run="2")
    L.write_quarantine(rows().limit(0), f"{tmp_dir}/d", run="2")  # the second run again, now without rejects
    assert sorted(r.id for r in spark.read.parquet(L.quarantine_path(f"{tmp_dir}/d")).collect()) == ["a", "b"]


def test_audit_and_gate_agree(spark):
    from brook.operators.clean import REASON_COL

    rows = spark.range(100_000).select(F.when(F.col("id") < 20_004, "bad_date").alias(REASON_COL))
    assert Q.audit(rows).first().gate_passed is False
    with pytest.raises(Q.GateError):
        Q.reject_gate(100_000, 79_996)


def test_compaction_keeps_rows_and_follows_later_runs(spark, tmp_path):
    """Same rows in fewer files; a repeated run replaces its compacted rows, a new one is added, a second compaction takes both."""
    path = str(tmp_path / "store")
    rows = lambda run, n, v: spark.createDataFrame([(f"{run}-{i}", v, f"2024-01-0{i % 3 + 1}") for i in range(n)], "id string, v int, published_date string")
    for run in ("2024-06-01", "2024-06-02", "path-abc"):
        L.write_curated(rows(run, 9, 1), path, run=run)
    seen = lambda: sorted((r.id, r.v, str(r.published_date), str(r.run_date)) for r in L.curated_scan(spark, path).collect())
    before, files = seen(), len(L.curated_scan(spark, path).inputFiles())
    pointer = L.compact_curated(spark, path)
    assert seen() == before and len(L.curated_scan(spark, path).inputFiles()) < files
    assert set(pointer["covered"]) == {"2024-06-01", "2024-06-02", "path-abc"} and pointer["number"] == 1
    L.write_curated(rows("2024-06-02", 4, 2), path, run="2024-06-02")
    L.write_curated(rows("2024-06-03", 2, 3), path, run="2024-06-03")
    want = sorted([r for r in before if r[3] != "2024-06-02"] + [(f"2024-06-02-{i}", 2, f"2024-01-0{i % 3 + 1}", "2024-06-02") for i in range(4)]
                  + [(f"2024-06-03-{i}", 3, f"2024-01-0{i % 3 + 1}", "2024-06-03") for i in range(2)])
    assert seen() == want
    assert L.compact_curated(spark, path)["number"] == 2 and seen() == want
    with pytest.raises(FileNotFoundError):
        L.curated_scan(spark, str(tmp_path / "nothing"))


def test_manifest_is_one_array_a_file(spark, tmp_path):
    import json as J

    rows = [(f"http://u{i}", "xml", None if i % 2 else f"s{i}") for i in range(7)]
    path = str(tmp_path / "manifest")
    L.write_manifest(spark.createDataFrame(rows, "url string, format string, source string"), path, files=2)
    files = [p for p in (tmp_path / "manifest").iterdir() if p.name.startswith("part-")]
    assert sorted(x["url"] for p in files for x in J.loads(p.read_text() or "[]")) == [r[0] for r in rows]
    assert sorted(map(tuple, L.manifest_scan(spark, path).collect()), key=str) == sorted(rows, key=str)


def test_only_new_leaves_the_store_where_it_is(spark):
    """The store is cut down in its scan; keys of several columns, nulls, a batch beyond the broadcast bound."""
    from brook.operators.dedup import only_new

    store = spark.createDataFrame([(i, f"s{i % 3}", "x" * 50) for i in range(1000)] + [(None, "s1", "")], "id int, source string, body string")
    batch = spark.createDataFrame([(5, "s2", "old"), (5, "s1", "new"), (2000, "s1", "new"), (None, "s1", "null"), (7, None, "null")], "id int, source string, kind string")
    for most in (100, 0):
        assert sorted(r.kind for r in only_new(batch, store, ["id", "source"], most).collect()) == ["new", "new", "null", "null"]
    plan = only_new(batch, store, ["id", "source"])._jdf.queryExecution().sparkPlan().toString()
    cut = plan[plan.index("LeftAnti"):]
    assert "BroadcastHashJoin" in cut and "LeftSemi" in cut
