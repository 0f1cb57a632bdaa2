from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brook.operators import fleet as FL
from brook.operators.sequence import previous_values, row_number_within

SIZING = [  # executors, min, max, input MB, wanted
    (0, 1, 4, 512, 2), (5, 0, 0, 0, 5), (0, 1, 4, 2048, 4), (0, 3, 0, 0, 3), (0, 0, 0, 0, 1),
    (0, 0, 0, 100, 0), (0, 2, 10, 500, 2), (0, 3, 8, 50, 3),
]


def test_desired_executors(spark):
    df = spark.createDataFrame(SIZING, "executors int, min_executors int, max_executors int, input_size_mb long, want int")
    got = [(r.want, r.d) for r in df.select("want", FL.desired_executors().alias("d")).collect()]
    assert all(w == d for w, d in got), got


def test_cost(spark):
    rows = [(None, None, 3, "0.5"), (datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 2), 3, "0.5"),
            (datetime(2024, 1, 1, 0), None, 1, "0"), (datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 2), 1, "1"),
            (datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1), 2, "n/a")]
    df = spark.createDataFrame(rows, "s timestamp, e timestamp, pods int, rate string")
    c = FL.cost_usd(F.col("s"), F.col("e"), F.col("pods"), FL.rate_per_hour("rate"), F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert [r.c for r in df.select(c.alias("c")).collect()] == [0.0, 3.0, 1.0, 0.0, 0.2]


def now():
    return F.lit("2024-01-01 10:00:00").cast("timestamp")


def test_job_status_rollup(spark):
    """Names repeat in another namespace; times are observed once, costs follow them."""
    at = lambda h: datetime(2024, 1, 1, h)
    runs = [("j1", "Running", 0, 2, at(8), None), ("j2", "Running", 2, 2, at(8), None), ("j3", "Succeeded", 0, 2, at(5), at(6)),
            ("j4", "Pending", 0, 1, None, None), ("j5", "Running", 0, 0, at(9), None), ("j6", "Pending", 0, 0, None, None)]
    kind = ("namespace string, name string, phase string, retries int, max_retries int, start_time timestamp, completion_time timestamp, "
            "executors int, min_executors int, max_executors int, input_size_mb int, cost_per_hour string")
    pods = [("a", "j1", "d1", "uid-d1", "driver", [], "Failed"), ("a", "j2", "d2", "uid-d2", "driver", [], "Failed"),
            ("a", "j3", "d3", "uid-d3", "driver", [], "Failed"), ("a", "j4", "d4", "uid-d4", "driver", [], "Running"),
            ("a", "j4", "e1", "uid-e1", "executor", ["uid-d4", "uid-d4"], "Running"),
            ("a", "j4", "e2", "uid-e2", "executor", ["uid-d4"], "Pending"),
            ("a", "j5", "d5", "uid-d5", "driver", [], "Succeeded"), ("a", "j6", "d6", "uid-d6", "driver", [], "Unknown"),
            ("b", "j4", "d4", "uid-b4", "driver", [], "Running"),
            *[("b", "j4", f"e{i}", f"uid-b4-{i}", "executor", ["uid-b4"], "Running") for i in range(3)]]
    runs = spark.createDataFrame([("a", *r, 0, 0, 0, 0, "0.5") for r in runs] + [("b", *runs[3], 0, 0, 0, 0, "")], kind)
    pods = spark.createDataFrame(pods, "namespace string, run string, name string, uid string, role string, owner_uids array<string>, phase string")
    got = {(r.namespace, r.name): (r.phase, r.retries, r.running, r.start_time, r.completion_time, r.cost_usd)
           for r in FL.job_status(runs, pods, now()).collect()}
    assert got == {("a", "j1"): ("Resuming", 1, 0, at(8), None, 1.0), ("a", "j2"): ("Failed", 2, 0, at(8), at(10), 1.0),
                   ("a", "j3"): ("Succeeded", 0, 0, at(5), at(6), 0.5), ("a", "j4"): ("Running", 0, 1, at(10), None, 0.0),
                   ("a", "j5"): ("Succeeded", 0, 0, at(9), at(10), 0.5), ("a", "j6"): ("Pending", 0, 0, None, None, 0.0),
                   ("b", "j4"): ("Running", 0, 3, at(10), None, 0.0)}


def test_training_status_precedence(spark):
    at = datetime(2024, 1, 1, 8)
    runs = spark.createDataFrame([(ns, n, 2, i, 1, None if n == "d" else at, None, "1", f"ck-{n}")
                                  for ns in "xy" for n, i in (("a", 0), ("b", 0), ("c", 1), ("d", 0), ("e", 0))],
                                 "namespace string, name string, world_size int, resumes int, max_retries int, start_time timestamp, "
                                 "completion_time timestamp, cost_per_hour string, last_checkpoint string")
    ready = [("Ready", "True")]
    pods = spark.createDataFrame([("x", *p) for p in [
        ("a", "Succeeded", []), ("a", "Succeeded", []),
        ("b", "Failed", []), ("b", "Running", ready),
        ("c", "Failed", []),
        ("d", "Running", ready), ("d", "Running", ready),
        ("e", "Succeeded", []), ("e", "Running", ready)]],
        "namespace string, run string, phase string, conditions array<struct<type: string, status: string>>")
    rows = FL.training_status(runs, pods, now()).collect()
    got = {r.name: (r.phase, r.resumes, r.cost_usd) for r in rows if r.namespace == "x"}
    assert got == {"a": ("Succeeded", 0, 4.0), "b": ("Resuming", 1, 4.0), "c": ("Failed", 1, 4.0), "d": ("Running", 0, 0.0),
                   "e": ("Pending", 0, 4.0)}
    assert {(r.phase, r.ready_workers) for r in rows if r.namespace == "y"} == {("Pending", 0)}  # the other namespace has no pods
    assert {r.name: (r.completion_time is not None, r.last_checkpoint) for r in rows if r.namespace == "x"} == {
        "a": (True, "ck-a"), "b": (False, "ck-b"), "c": (True, "ck-c"), "d": (False, "ck-d"), "e": (False, "ck-e")}


def test_rank_diff(spark):
    runs = spark.createDataFrame([("a", "r", 3), ("b", "r", 1), ("b", "none", 0)], "namespace string, name string, world_size int")
    pods = spark.createDataFrame([("a", "r", 0), ("a", "r", 2), ("a", "r", 4), ("b", "r", 0), ("b", "r", 1)], "namespace string, run string, rank int")
    got = sorted((r.namespace, r["rank"], r.action) for r in FL.rank_diff(runs, pods).collect())
    assert got == [("a", 1, "create"), ("a", 4, "delete"), ("b", 1, "delete")]


def test_missing_dependencies_first_in_order(spark):
    refs = spark.createDataFrame([("ns", "r1", 0, "Secret", "s1", False), ("ns", "r1", 1, "ConfigMap", "c1", False),
                                  ("ns", "r2", 0, "Secret", "s2", True), ("ns", "r2", 1, "ConfigMap", "c1", False),
                                  ("other", "r1", 1, "ConfigMap", "c1", False), ("other", "r1", 0, "Secret", "s9", False)],
                                 "namespace string, run string, pos int, kind string, ref_name string, optional boolean")
    objs = spark.createDataFrame([("ns", "Secret", "s9"), ("other", "Secret", "s9")], "namespace string, kind string, obj_name string")
    got = {(r.namespace, r.run): r.message for r in FL.missing_dependencies(refs, objs).collect()}
    assert got == {("ns", "r1"): 'waiting for Secret "s1"', ("ns", "r2"): 'waiting for ConfigMap "c1"',
                   ("other", "r1"): 'waiting for ConfigMap "c1"'}


def test_retention_keeps_newest(spark):
    runs = spark.createDataFrame(
        [(f"j{i}", "t", "Succeeded" if i % 2 else "Failed", datetime(2024, 1, 1, i)) for i in range(12)]
        + [("live", "t", "Running", datetime(2024, 1, 2))],
        "name string, template string, phase string, created timestamp").withColumn("namespace", F.lit("a"))
    tmpl = spark.createDataFrame([("a", "t", 1, None), ("b", "t", 0, 2)],
                                 "namespace string, template string, keep_succeeded int, keep_failed int")
    # The same names in another namespace, under other limits.
    rows = FL.retention(runs.union(runs.withColumn("namespace", F.lit("b"))), tmpl).collect()
    assert {r.name for r in rows if r.namespace == "b" and r.keep} == {"j10", "j8"}
    assert len(rows) == 24
    got = {r.name: r.keep for r in rows if r.namespace == "a"}
    assert "live" not in got
    assert {n for n, k in got.items() if k} == {"j11", "j10", "j8", "j6"}


def test_retention_keeps_many(spark):
    """One template keeps all but a few of its many runs; runs without a time are the oldest."""
    runs = spark.createDataFrame([("a", f"j{i:05d}", "hot", "Failed", datetime(2024, 1, 1) + timedelta(seconds=i // 2)) for i in range(3000)]
                                 + [("a", "x", "hot", "Failed", None), ("a", "y", "few", "Failed", None)],
                                 "namespace string, name string, template string, phase string, created timestamp")
    tmpl = spark.createDataFrame([("a", "hot", None, 2998)], "namespace string, template string, keep_succeeded int, keep_failed int")
    got = {r.name for r in FL.retention(runs, tmpl).collect() if not r.keep}
    # The newest 2998 of 3000 stay; of the two of the first second the first name goes ahead.
    assert got == {"j00000", "j00001", "x"}


def test_sequence_over_keys_nulls_and_batches(spark):
    """Several keys, null keys and values, strings, arrays, empty frames, small Arrow batches, one partition and many."""
    rows = [(None if i % 7 == 0 else f"n{i % 2}", i % 3 if i % 5 else None, i, None if i % 4 == 0 else f"v{i // 3}", [i, i // 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "namespace string, run int, ts long, v string, xs array<int>")
    w = Window.partitionBy("namespace", "run").orderBy("ts")
    want = sorted(repr(tuple(r)) for r in df.select("*", F.lag("v").over(w), F.lag("xs").over(w), F.row_number().over(w) > 1).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, parts in ((7, 3), (10_000, None), (1, 40)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = previous_values(df, ["namespace", "run"], "ts", ["v", "xs"], num_partitions=parts)
            assert sorted(repr(tuple(r)) for r in got.collect()) == want
            rn = row_number_within(df, ["namespace", "run"], "ts", num_partitions=parts)
            assert sorted(repr(tuple(r)) for r in rn.collect()) == sorted(repr(tuple(r)) for r in df.withColumn("rn", F.row_number().over(w)).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert row_number_within(df.limit(0), ["namespace", "run"], "ts").collect() == []


def test_one_exchange_of_the_rows(spark):
    """The rows are shuffled once, by range; nothing else moves them."""
    df = spark.range(1000).select((F.col("id") % 3).alias("run"), F.col("id").alias("ts"))
    plan = previous_values(df, "run", "ts", ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") <= 2  # the cached plan is printed under both of its readers
    assert "hashpartitioning(_pid" not in plan


def test_segmented_sequence_equals_window_on_skew(spark):
    # one hot key holds most rows and spans every partition
    rows = [("hot", i, i % 3) for i in range(3000)] + [(f"k{j}", i, (i // 2) % 2) for j in range(20) for i in range(7)]
    df = spark.createDataFrame(rows, "run string, ts long, v int")
    w = Window.partitionBy("run").orderBy("ts")
    want = {(r.run, r.ts): (r.rn, r.pv) for r in df.select("run", "ts", F.row_number().over(w).alias("rn"),
                                                                 F.lag("v").over(w).alias("pv")).collect()}
    rn = {(r.run, r.ts): r.rn for r in row_number_within(df, "run", ["ts"], num_partitions=8).collect()}
    pv = {(r.run, r.ts): (r.prev_v, r.has_prev) for r in previous_values(df, "run", ["ts"], ["v"], num_partitions=8).collect()}
    assert {k: v[0] for k, v in want.items()} == rn
    assert {k: v[1] for k, v in want.items()} == {k: v[0] for k, v in pv.items()}
    assert all(hp == (rn[k] > 1) for k, (_, hp) in pv.items())


def test_status_changes_and_attempts(spark):
    h = spark.createDataFrame([("r", 1, 1, "Running", 2), ("r", 2, 2, "Running", 2), ("r", 3, 3, "Failed", 2),
                               ("r", 4, 4, "Failed", 2), ("r", 5, 5, "Failed", 2)],
                              "run string, event_id long, ts long, phase string, max_retries int").withColumn("namespace", F.lit("a"))
    # The same run of another namespace is another run.
    h = h.union(spark.createDataFrame([("r", 6, 2, "Failed", 0, "b"), ("r", 7, 3, "Running", 0, "b")], h.schema))
    ch = [r.event_id for r in FL.status_changes(h, ["phase"]).orderBy("event_id").collect()]
    assert ch == [1, 3, 6, 7]
    att = [(r.attempt, r.phase) for r in FL.attempts(h.filter("phase = 'Failed' AND namespace = 'a'")).orderBy("attempt").collect()]
    assert att == [(1, "Resuming"), (2, "Resuming"), (3, "Failed")]


def test_overlay_and_gauge(spark):
    layers = spark.createDataFrame([("a", "r", 0, "k", "a"), ("a", "r", 2, "k", "c"), ("a", "r", 1, "k", "b"), ("a", "r", 0, "x", "d"),
                                    ("b", "r", 0, "k", "z")],
                                   "namespace string, run string, layer int, key string, value string")
    assert {(r.namespace, r.key, r.value) for r in FL.config_overlay(layers).collect()} == {("a", "k", "c"), ("a", "x", "d"), ("b", "k", "z")}
    g = FL.phase_gauge(spark.createDataFrame([("a", "r", "Running"), ("b", "r", None)], "namespace string, name string, phase string")).collect()
    assert len(g) == 12 and sum(r.value for r in g) == 1
    samples = spark.createDataFrame([("a", "r", 1, 1, 0.1), ("a", "r", 2, 2, 0.2), ("b", "r", 3, 3, 0.3)],
                                    "namespace string, run string, ts long, event_id long, value double")
    live = FL.live_series(samples, spark.createDataFrame([("a", "r")], "namespace string, run string"))
    assert [(r.namespace, r.value) for r in live.collect()] == [("a", 0.2)]


def test_capacity_of_driver_and_executors(spark):
    kind = ("namespace string, name string, executors int, min_executors int, max_executors int, input_size_mb int, exec_cpu string, "
            "exec_memory string, driver_cpu string, driver_memory string")
    df = spark.createDataFrame([("a", "j", 0, 0, 0, 0, "500m", "1e9", "25e-1", "1Ei"), ("b", "j", 2, 0, 0, 0, None, None, "3", None)], kind)
    got = {r.namespace: tuple(r)[2:] for r in FL.capacity_plan(df).collect()}
    assert got == {"a": (1, 1, "953m", 3, "1073741824g"), "b": (2, None, None, 3, None)}


def test_checkpoint_materialise_matches_persist(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "run string, ts long")
    a = {(r.run, r.ts): r.rn for r in row_number_within(df, "run", ["ts"], num_partitions=6).collect()}
    b = {(r.run, r.ts): r.rn for r in row_number_within(df, "run", ["ts"], num_partitions=6,
                                                          materialise="checkpoint").collect()}
    assert a == b and a[("hot", 499)] == 500
    assert spark.sparkContext.getCheckpointDir() is not None
