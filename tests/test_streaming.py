import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brook.streaming import jobs as SJ


def test_latest_status_change_only(spark, tmp_dir):
    rows = [("r1", 1, datetime(2024, 1, 1, 0, 0, 1), "Running"), ("r1", 2, datetime(2024, 1, 1, 0, 0, 2), "Running"),
            ("r1", 3, datetime(2024, 1, 1, 0, 0, 3), "Failed"), ("r2", 4, datetime(2024, 1, 1, 0, 0, 1), "Pending")]
    rows += [(r, i + 10, t, p, "other") for r, i, t, p in rows[1:3]]  # the same names in another namespace
    df = spark.createDataFrame([(*r, "ns")[:5] for r in rows], "run string, event_id long, ts timestamp, phase string, namespace string")
    df.write.parquet(f"{tmp_dir}/src1")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/src1")
    SJ.run_to_parquet(SJ.latest_status(s, ["phase"]), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == [1, 3, 4, 12, 13]
    # a second batch continues from the stored state: no repeat of "Failed"
    later = spark.createDataFrame([("r1", 5, datetime(2024, 1, 1, 0, 0, 5), "Failed", "ns"),
                                   ("r1", 6, datetime(2024, 1, 1, 0, 0, 6), "Running", "ns")], df.schema)
    later.write.mode("append").parquet(f"{tmp_dir}/src1")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/src1")
    SJ.run_to_parquet(SJ.latest_status(s, ["phase"]), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == [1, 3, 4, 6, 12, 13]


def _triggers(spark, tmp_dir, batches, schema, cols, **more):
    """Each of ``batches`` lands and is streamed in a run of its own; what came out so far, after each."""
    out = []
    for rows in batches:
        spark.createDataFrame([("ns", *r) for r in rows], "namespace string, " + schema).write.mode("append").parquet(f"{tmp_dir}/src")
        s = spark.readStream.schema("namespace string, " + schema).parquet(f"{tmp_dir}/src")
        SJ.run_to_parquet(SJ.latest_status(s, cols, **more), f"{tmp_dir}/out", f"{tmp_dir}/ck")
        out.append(sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/out").collect()))
    return out


def test_quiet_runs_are_forgotten(spark, tmp_dir):
    """State goes when a run has had no news for its time; rows behind the watermark are dropped."""
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[("quiet", 1, at(0), "Running"), ("busy", 2, at(0), "Running")],
               [("busy", 3, at(50), "Running")],      # the watermark (0:49) has passed quiet's last status plus 30 minutes
               [("busy", 4, at(60), "Running"), ("quiet", 5, at(61), "Running")],
               [("busy", 6, at(40), "Failed"), ("quiet", 7, at(62), "Running")]]
    got = _triggers(spark, tmp_dir, batches, "run string, event_id long, ts timestamp, phase string", ["phase"], delay="1 minute", keep="30 minutes")
    # quiet's status of 1:01 is a first one again, busy's row of 0:40 is late.
    assert [x for x in got[-1] if x in (1, 2, 5, 6, 7)] == [1, 2, 5]


def test_hot_run_in_many_frames_over_triggers(spark, tmp_dir, monkeypatch):
    """A run with nearly all rows, out of order, in frames far smaller than it, over three triggers."""
    rng = random.Random(7)
    monkeypatch.setattr(SJ, "BLOCK_ROWS", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        rows = [("hot", i, datetime(2024, 1, 1) + timedelta(seconds=i // 2), rng.choice(["Running", "Failed", None]), rng.choice([1.5, None])) for i in range(3000)]
        rows += [(f"cold{i % 5}", 5000 + i, datetime(2024, 1, 1) + timedelta(seconds=i * 10), "Running", None) for i in range(200)]
        third = lambda k: [r for r in rows if r[2].minute * 60 + r[2].second in range(500 * k, 500 * k + 500)]
        batches = [rng.sample(x, len(x)) for x in map(third, range(3))]
        got = _triggers(spark, tmp_dir, batches, "run string, event_id long, ts timestamp, phase string, cost double", ["phase", "cost"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = [], {}
    for r in sorted((r for b in batches for r in b), key=lambda r: (r[2], r[1])):
        if last.get(r[0], "none") != r[3:]:
            want.append(r[1])
        last[r[0]] = r[3:]
    assert got[-1] == sorted(want)


def test_late_status_of_a_later_batch_changes_nothing(spark, tmp_dir):
    """A row older than the stored status is not a change, and the status that
    follows is compared with the newest one; nulls equal nulls."""
    schema = "namespace string, run string, event_id long, ts timestamp, phase string, cost double"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    days = [[("r", 1, at(1), "Pending", None), ("r", 2, at(5), "Running", None)],
            [("r", 3, at(3), "Pending", None), ("r", 4, at(6), "Running", None)],
            [("r", 5, at(6), "Running", 1.5), ("r", 6, at(7), "Running", 1.5)]]
    for rows in days:
        spark.createDataFrame([("ns", *r) for r in rows], schema).write.mode("append").parquet(f"{tmp_dir}/src")
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/src")
        SJ.run_to_parquet(SJ.latest_status(s, ["phase", "cost"]), f"{tmp_dir}/out", f"{tmp_dir}/ck")
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_dir}/out").collect()) == [1, 2, 5]


def test_error_rate_over_batches_keeps_the_last_version(spark, tmp_dir):
    schema = "event_id long, ts timestamp, result string"
    for k in range(2):  # the second batch adds to the windows of the first
        rows = [(10 * k + i, datetime(2024, 1, 1, 0, i, k), "error" if i % 2 else "success") for i in range(8)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_dir}/ev")
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/ev")
        SJ.run_to_parquet(SJ.error_rate(s), f"{tmp_dir}/er", f"{tmp_dir}/ck", mode="update")
    got = sorted(tuple(r) for r in SJ.latest_rows(spark, f"{tmp_dir}/er", ["window_start", "window_end"]).collect())
    assert got == sorted(tuple(r) for r in SJ.error_rate(spark.read.parquet(f"{tmp_dir}/ev")).collect())
    assert len(got) == 2 and [g[2] for g in got] == [10, 6]


def test_error_rate_stream_equals_batch(spark, tmp_dir):
    rows = [(i, datetime(2024, 1, 1, 0, i % 20, 0), "error" if i % 3 == 0 else "success") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, result string")
    df.write.parquet(f"{tmp_dir}/ev")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/ev")
    SJ.run_to_parquet(SJ.error_rate(s), f"{tmp_dir}/er", f"{tmp_dir}/ck2", mode="update")
    got = sorted(tuple(r) for r in SJ.latest_rows(spark, f"{tmp_dir}/er", ["window_start", "window_end"]).collect())
    want = sorted(tuple(r) for r in SJ.error_rate(df).collect())
    assert got == want and len(got) == 4


def test_dedup_within_watermark(spark, tmp_dir):
    rows = [("a", datetime(2024, 1, 1, 0, 0)), ("a", datetime(2024, 1, 1, 0, 5)), ("b", datetime(2024, 1, 1, 0, 1))]
    df = spark.createDataFrame(rows, "id string, ts timestamp")
    df.write.parquet(f"{tmp_dir}/d")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_dir}/d")
    SJ.run_to_parquet(SJ.stream_dedup(s, ["id"], "ts", "1 hour"), f"{tmp_dir}/dd", f"{tmp_dir}/ck3")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_dir}/dd").collect()) == ["a", "b"]


def test_stream_elt_is_incremental(spark, tmp_dir):
    from brook.plans import views as V
    from brook.sources import lake as L
    from paths import SF001

    a = V.articles(spark, SF001).withColumn("_source", F.lower(F.trim("category")))
    day1 = a.filter(F.col("id").cast("long") % 2 == 0)
    day2 = a.filter(F.col("id").cast("long") % 2 == 1)
    raw, dest, ck = f"{tmp_dir}/raw", f"{tmp_dir}/cur", f"{tmp_dir}/ck"
    L.write_raw(day1, raw, "2024-06-01", mode="append")
    SJ.await_all(SJ.stream_elt(spark, raw, dest, ck))
    n1 = spark.read.parquet(dest).count()
    L.write_raw(day2, raw, "2024-06-02", mode="append")
    SJ.await_all(SJ.stream_elt(spark, raw, dest, ck))
    good = spark.read.parquet(dest)
    bad = spark.read.parquet(L.quarantine_path(dest))
    assert 0 < n1 < good.count()
    assert good.count() + bad.count() == a.count()  # every row once: no file processed twice
    assert good.select("id").distinct().count() == good.count()


def test_stream_elt_batch_replay_is_idempotent(spark, tmp_dir):
    """Re-running the same epoch of the same query (as after a failure) does not duplicate rows; the same
    epoch of another checkpoint replaces nothing."""
    from brook.plans import views as V
    from brook.sources import lake as L
    from paths import SF001

    a = V.articles(spark, SF001).withColumn("_source", F.lower(F.trim("category")))
    raw, dest = f"{tmp_dir}/raw", f"{tmp_dir}/cur"
    L.write_raw(a, raw, "2024-06-01")
    SJ.await_all(SJ.stream_elt(spark, raw, dest, f"{tmp_dir}/ck"))
    n = spark.read.parquet(dest).count()
    # forget that epoch 0 was committed: the query runs it again
    for name in os.listdir(f"{tmp_dir}/ck/commits"):
        os.remove(f"{tmp_dir}/ck/commits/{name}")
    SJ.await_all(SJ.stream_elt(spark, raw, dest, f"{tmp_dir}/ck"))
    assert spark.read.parquet(dest).count() == n
    SJ.await_all(SJ.stream_elt(spark, raw, dest, f"{tmp_dir}/ck2"))
    assert spark.read.parquet(dest).count() == 2 * n


def test_counter_rate_by_hand(spark):
    """Restarts, usual and unusual gaps to the edges, the zero bound, one sample, repeated instants."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    series = {"steady": [(s, 100 + s / 10) for s in range(0, 300, 30)],              # 0.1 a second throughout
              "restart": [(10, 50), (40, 56), (70, 2), (100, 8)],                    # 6 + 2 + 6, long gap behind
              "young": [(100, 1), (130, 31), (160, 61)],                             # would have been zero a second earlier
              "once": [(5, 1)], "flat": [(0, 3), (0, 7), (290, 7)]}
    rows = [("ns", k, at(s), float(v)) for k, xs in series.items() for s, v in xs]
    df = spark.createDataFrame(rows, "namespace string, run string, ts timestamp, value double")
    got = {r.run: (r.n_samples, r.increase, r.rate) for r in SJ.counter_rate(df, "5 minutes", "5 minutes").collect()}
    assert set(got) == {"steady", "restart", "young", "flat"}
    assert got["steady"] == (10, 27.0, 0.1)
    assert got["restart"] == (4, 14.0, round(14 * (90 + 10 + 15) / 90 / 300, 9))
    assert got["young"] == (3, 60.0, round(60 * (60 + 1 + 15) / 60 / 300, 9))
    assert got["flat"] == (2, 0.0, 0.0)


def test_counter_rate_streamed_in_parts(spark, tmp_dir):
    """Samples of a window that come in several triggers give the rate of all of them."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("ns", f"r{i % 2}", at(15 * i), float((i * 7) % 40)) for i in range(80)]
    schema = "namespace string, run string, ts timestamp, value double"
    for k in range(3):
        spark.createDataFrame(rows[k * 27:(k + 1) * 27], schema).write.mode("append").parquet(f"{tmp_dir}/src")
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/src")
        SJ.run_to_parquet(SJ.counter_rate(s, "5 minutes", "1 minute"), f"{tmp_dir}/out", f"{tmp_dir}/ck", mode="update")
    keys = ["namespace", "run", "window_start", "window_end"]
    got = sorted(tuple(r) for r in SJ.latest_rows(spark, f"{tmp_dir}/out", keys).collect())
    assert got == sorted(tuple(r) for r in SJ.counter_rate(spark.createDataFrame(rows, schema), "5 minutes", "1 minute").collect()) and len(got) > 20
