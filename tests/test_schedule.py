from datetime import datetime, timedelta

from pyspark.sql import functions as F

from brook.operators import schedule as S

NOW = datetime(2024, 3, 7, 12, 0, 30)
SCHEMA = ("template string, schedule string, time_zone string, suspend boolean, concurrency_policy string, "
          "starting_deadline_s long, created timestamp")


def templates(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("namespace", F.lit("ns"))


def fires(spark, rows, start="2024-03-01 00:00:00", end="2024-03-08 00:00:00"):
    t = templates(spark, rows)
    return t, S.fire_calendar(t, start, end)


def test_impossible_and_rejects(spark):
    t, f = fires(spark, [("feb31", "0 0 31 2 *", None, False, "", None, NOW),
                         ("garbage", "not a cron", None, False, "", None, NOW),
                         ("badzone", "0 0 * * *", "Mars/Olympus", False, "", None, NOW),
                         ("range", "0 0 5-2 * *", None, False, "", None, NOW)])
    assert f.count() == 0
    rej = {r.template: r.reject_reason for r in S.schedule_rejects(t).collect()}
    assert rej == {"garbage": "bad_cron", "badzone": "bad_zone", "range": "bad_cron"}
    nxt = {r.template: r.next_ts for r in S.next_fire(t, NOW.isoformat(sep=" ")).collect()}
    assert nxt == {"feb31": None}


def test_utc_default_zone_names_and_dom_dow(spark):
    _, f = fires(spark, [("daily", "0 0 * * *", None, False, "", None, NOW),
                         ("ny", "30 6 * * 1-5", "America/New_York", False, "", None, NOW),
                         ("names", "0 12 * MAR SUN", "", False, "", None, NOW),
                         ("either", "0 0 6 * FRI", None, False, "", None, NOW),
                         ("paused", "* * * * *", None, True, "", None, NOW)])
    got = {}
    for r in f.collect():
        got.setdefault(r.template, []).append(r.fire_ts)
    assert sorted(got["daily"]) == [datetime(2024, 3, d) for d in range(1, 8)]
    # weekdays 1-5 in New York (UTC-5 before DST) -> 11:30 UTC
    assert sorted(got["ny"]) == [datetime(2024, 3, d, 11, 30) for d in (1, 4, 5, 6, 7)]
    assert got["names"] == [datetime(2024, 3, 3, 12)]  # the only Sunday
    assert sorted(got["either"]) == [datetime(2024, 3, 1), datetime(2024, 3, 6)]  # Friday 1st OR the 6th
    assert "paused" not in got


def test_due_fire_cases(spark):
    rows = [("every5", "* * * * *", None, False, "", None, NOW - timedelta(minutes=5)),
            ("every10", "* * * * *", None, False, "", None, NOW - timedelta(minutes=10)),
            ("yearly", "0 0 1 1 *", None, False, "", None, NOW),
            ("late", "0 0 * * *", None, False, "", 60, NOW - timedelta(days=2))]
    t = templates(spark, rows)
    due = {r.template: r.due_ts for r in S.due_fire(t, NOW.isoformat(sep=" ")).collect()}
    assert due == {"every5": datetime(2024, 3, 7, 12, 0), "every10": datetime(2024, 3, 7, 12, 0)}


def test_next_fire(spark):
    t = templates(spark, [("hourly", "0 * * * *", None, False, "", None, NOW),
                          ("yearly", "0 0 1 1 *", "Asia/Tokyo", False, "", None, NOW)])
    nxt = {r.template: r.next_ts for r in S.next_fire(t, NOW.isoformat(sep=" ")).collect()}
    assert nxt == {"hourly": datetime(2024, 3, 7, 13), "yearly": datetime(2024, 12, 31, 15)}


def test_concurrency_and_children(spark):
    t = templates(spark, [("a", "* * * * *", None, False, "Allow", None, NOW), ("f", "* * * * *", None, False, "", None, NOW),
                          ("r", "* * * * *", None, False, "Replace", None, NOW)])
    due = spark.createDataFrame([(x, datetime(2024, 3, 7, 12)) for x in "afr"], "template string, due_ts timestamp").withColumn("namespace", F.lit("ns"))
    runs = spark.createDataFrame([("a", "a-1", "Running"), ("f", "f-1", "Pending"), ("r", "r-1", "Running"),
                                  ("r", "r-0", "Succeeded")], "template string, name string, phase string").withColumn("namespace", F.lit("ns"))
    d = {r.template: (r.action, r.n_replaced) for r in S.fire_concurrency(due, t, runs).collect()}
    assert d == {"a": ("run", 0), "f": ("skip", 0), "r": ("run", 1)}
    dec = S.fire_concurrency(due.unionByName(due), t, runs)
    kids = {r.child for r in S.child_runs(dec).collect()}
    assert kids == {f"a-{int(datetime(2024, 3, 7, 12).timestamp())}", f"r-{int(datetime(2024, 3, 7, 12).timestamp())}"}
    assert [r.name for r in S.replaced_runs(S.fire_concurrency(due, t, runs), runs).collect()] == ["r-1"]


def test_clock_changes(spark):
    """A template fires at every instant whose local time matches: skipped minutes never, repeated ones twice."""
    # New York: 10 March 2024 skips 02:00-03:00 (07:00 UTC), 3 November repeats 01:00-02:00 (06:00 UTC).
    # Berlin: 31 March skips 02:00-03:00 (01:00 UTC), 27 October repeats 02:00-03:00 (01:00 UTC).
    # Lord Howe: half an hour, 7 April 2024 repeats 01:30-02:00 (15:00 UTC the day before).
    ny, berlin = "America/New_York", "Europe/Berlin"
    rows = [("gap", "30 2 * * *", ny, False, "", None, NOW), ("hourly", "0 * * * *", ny, False, "", None, NOW),
            ("twice", "30 1 * * *", ny, False, "", None, NOW), ("bgap", "15 2 * * *", berlin, False, "", None, NOW),
            ("half", "45 1 * * *", "Australia/Lord_Howe", False, "", None, NOW), ("utc", "30 2 * * *", None, False, "", None, NOW)]
    at = lambda f, name: sorted(r.fire_ts for r in f.collect() if r.template == name)
    _, f = fires(spark, rows, "2024-03-09 05:00:00", "2024-03-12 00:00:00")
    assert at(f, "gap") == [datetime(2024, 3, 9, 7, 30), datetime(2024, 3, 11, 6, 30)]
    hours = at(f, "hourly")
    assert len(hours) == 67 and all(b - a == timedelta(hours=1) for a, b in zip(hours, hours[1:]))
    assert at(f, "utc") == [datetime(2024, 3, d, 2, 30) for d in (10, 11)]
    _, f = fires(spark, rows, "2024-03-30 00:00:00", "2024-04-02 00:00:00")
    assert at(f, "bgap") == [datetime(2024, 3, 30, 1, 15), datetime(2024, 4, 1, 0, 15)]
    _, f = fires(spark, rows, "2024-10-26 12:00:00", "2024-11-04 12:00:00")
    assert at(f, "bgap")[:3] == [datetime(2024, 10, 27, 0, 15), datetime(2024, 10, 27, 1, 15), datetime(2024, 10, 28, 1, 15)]
    assert [x for x in at(f, "twice") if x >= datetime(2024, 11, 2)] == [
        datetime(2024, 11, 2, 5, 30), datetime(2024, 11, 3, 5, 30), datetime(2024, 11, 3, 6, 30), datetime(2024, 11, 4, 6, 30)]
    _, f = fires(spark, rows, "2024-04-06 00:00:00", "2024-04-07 00:00:00")
    assert at(f, "half") == [datetime(2024, 4, 6, 14, 45), datetime(2024, 4, 6, 15, 15)]


def test_next_and_due_across_clock_changes(spark):
    ny = "America/New_York"
    t = templates(spark, [("gap", "30 2 * * *", ny, False, "", None, datetime(2024, 1, 1)), ("twice", "30 1 * * *", ny, False, "", None, datetime(2024, 1, 1)),
                          ("once", "30 2 10 3 *", ny, False, "", None, datetime(2022, 1, 1)), ("month", "0 2 10 * *", ny, False, "", None, datetime(2023, 1, 1))])
    nxt = lambda now: {r.template: r.next_ts for r in S.next_fire(t, now).collect()}
    got = nxt("2024-03-09 07:30:00")
    assert got["gap"] == datetime(2024, 3, 11, 6, 30) and got["once"] == datetime(2025, 3, 10, 6, 30) and got["month"] == datetime(2024, 4, 10, 6)
    assert nxt("2024-11-03 05:30:00")["twice"] == datetime(2024, 11, 3, 6, 30)
    due = lambda now: {r.template: r.due_ts for r in S.due_fire(t, now).collect()}
    got = due("2024-03-10 12:00:00")
    assert got["gap"] == datetime(2024, 3, 9, 7, 30) and got["once"] == datetime(2023, 3, 10, 7, 30) and got["month"] == datetime(2024, 2, 10, 7)
    assert due("2024-11-03 06:45:00")["twice"] == datetime(2024, 11, 3, 6, 30)


def test_fire_history_against_all_pairs(spark):
    """Fires on and next to creations and completions, runs that end as they start or never, bins without runs, a hot template."""
    t0 = datetime(2024, 3, 1)
    runs, fires_ = [], []
    for i in range(300):
        key = ("n", "hot") if i % 3 else (f"n{i % 2}", "cold")
        start = t0 + timedelta(minutes=7 * i, seconds=i % 60, microseconds=i % 2)
        end = None if i % 11 == 0 else start + timedelta(minutes=(i * 37) % 400 - 5)
        runs.append((*key, f"r{i}", start, end, "Running" if end is None else "Failed" if i % 2 else "Succeeded"))
        fires_ += [(*key, start), (*key, start + timedelta(microseconds=1)), (*key, start - timedelta(hours=1)), (*key, t0 + timedelta(hours=5 * i))]
    runs.append(("n", "hot", "odd", t0, None, "Failed"))
    kind = "namespace string, template string, name string, created timestamp, completion_time timestamp, phase string"
    tmpl = spark.createDataFrame([("n", "hot", "Replace"), ("n0", "cold", ""), ("n1", "cold", "Allow")], "namespace string, template string, concurrency_policy string")
    policy = {("n", "hot"): "Replace", ("n0", "cold"): "Forbid", ("n1", "cold"): "Allow"}
    want = set()
    for ns, name, at in set(fires_):
        n = sum(1 for r in runs if r[:2] == (ns, name) and r[3] <= at
                and (r[5] == "Running" or max(r[4] or r[3], r[3]) > at))
        p = policy[ns, name]
        want.add((ns, name, at, p, n, "skip" if n and p == "Forbid" else "run", n if p == "Replace" else 0))
    got = S.fire_history(spark.createDataFrame(fires_, "namespace string, template string, fire_ts timestamp"), tmpl, spark.createDataFrame(runs, kind))
    assert {tuple(r) for r in got.collect()} == want


def test_due_fire_has_no_window(spark):
    t = templates(spark, [("monthly", "0 0 1 * *", None, False, "", None, datetime(2024, 1, 15)),
                          ("leap", "0 6 29 2 *", None, False, "", None, datetime(2016, 2, 28)),
                          ("never", "0 0 31 2 *", None, False, "", None, datetime(2016, 2, 28)),
                          ("gap", "30 2 * * *", "America/New_York", False, "", None, datetime(2024, 3, 9, 12))])
    due = lambda now: {r.template: r.due_ts for r in S.due_fire(t, now).collect()}
    assert due("2024-02-28 00:00:00") == {"monthly": datetime(2024, 2, 1), "leap": datetime(2020, 2, 29, 6)}
    # The 02:30 of 10 March is skipped: nothing is due until the next day's.
    assert "gap" not in due("2024-03-10 07:30:00") and "gap" not in due("2024-03-11 06:29:00")
    assert due("2024-03-11 06:30:00")["gap"] == datetime(2024, 3, 11, 6, 30)


def test_next_fire_across_2100(spark):
    t = templates(spark, [("leap", "0 6 29 2 *", None, False, "", None, NOW)])
    assert [r.next_ts for r in S.next_fire(t, "2096-03-01 00:00:00").collect()] == [datetime(2104, 2, 29, 6)]


def test_names_repeat_across_namespaces(spark):
    rows = [("a", "x", "* * * * *", None, False, "Forbid", None, datetime(2024, 3, 1), None),
            ("b", "x", "0 * * * *", None, False, "Replace", None, datetime(2024, 3, 1), datetime(2024, 3, 7, 12))]
    t = spark.createDataFrame(rows, "namespace string, " + SCHEMA + ", last_schedule_time timestamp")
    now = NOW.isoformat(sep=" ")
    due = S.due_fire(t, now)
    assert [(r.namespace, r.due_ts) for r in due.collect()] == [("a", datetime(2024, 3, 7, 12))]
    runs = spark.createDataFrame([("b", "x", "x-1", "Running")], "namespace string, template string, name string, phase string")
    dec = S.fire_concurrency(due, t, runs)
    assert [(r.namespace, r.action, r.n_active) for r in dec.collect()] == [("a", "run", 0)]
    got = {r.namespace: (r.phase, r.last_schedule_ts) for r in S.template_status(t, dec, runs, S.next_fire(t, now)).collect()}
    # Nothing ran in b: its last fire on record stays.
    assert got == {"a": ("Running", datetime(2024, 3, 7, 12)), "b": ("Running", datetime(2024, 3, 7, 12))}


def test_calendar_of_one_schedule_is_spread_over_tasks(spark):
    """Templates of one file and one schedule: their fires do not all come from one task, and show as asked."""
    t = spark.range(12_000).coalesce(1).selectExpr("'n' AS namespace", "concat('t', id) AS template", "'*/15 * * * *' AS schedule",
                                                   "CAST(NULL AS string) AS time_zone", "false AS suspend")
    fires = S.fire_calendar(t, "2024-03-01 00:00:00", "2024-03-01 03:00:00", shown=lambda c: F.date_format(c, "HH:mm"))
    n = [r["n"] for r in fires.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(n) == 12 * 12_000 and max(n) < 4 * sum(n) // spark.sparkContext.defaultParallelism
    assert [r.fire_ts for r in fires.select("fire_ts").distinct().orderBy("fire_ts").limit(3).collect()] == ["00:00", "00:15", "00:30"]


def test_fire_history_of_repeated_fires_templates_and_instants(spark):
    """A repeated fire counts once, a repeated template once for each of its rows; changes of an instant come before its fire;
    a bin begins with what is open."""
    fires_ = [("n", "a", d) for d in ("2024-03-01 00:00:00", "2024-03-01 00:00:00", "2024-03-03 23:59:00", "2024-03-05 00:00:00")] + [(None, "a", "2024-03-01 00:00:00"), ("n", "b", None)]
    runs = [("n", "a", "2024-03-01 00:00:00", "Running", None), ("n", "a", "2024-03-01 00:00:00", "Failed", "2024-03-03 23:59:00"),
            ("n", "a", "2024-02-01 00:00:00", "Succeeded", "2024-03-04 00:00:00")]
    times = lambda d, *c: d.withColumns({x: F.col(x).cast("timestamp") for x in c})
    got = S.fire_history(times(spark.createDataFrame(fires_, "namespace string, template string, fire_ts string"), "fire_ts"),
                         spark.createDataFrame([("n", "a", ""), ("n", "a", "Replace"), ("n", "b", "Allow")], "namespace string, template string, concurrency_policy string"),
                         times(spark.createDataFrame(runs, "namespace string, template string, created string, phase string, completion_time string"), "created", "completion_time"))
    rows = sorted((r.fire_ts.strftime("%d %H:%M"), r.policy, r.n_active, r.action, r.n_replaced) for r in got.collect())
    assert rows == [(d, p, n, "run" if p == "Replace" else "skip", n if p == "Replace" else 0)
                    for d, n in (("01 00:00", 3), ("03 23:59", 2), ("05 00:00", 1)) for p in ("Forbid", "Replace")]
