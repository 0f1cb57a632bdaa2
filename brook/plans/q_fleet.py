"""Run-fleet queries: job runs (orders), pods (lineitem), status history
(events), dependencies (orders, customer), config layers (lineitem, part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.operators import fleet as FL
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
DUCK_TS_FMT = "%Y-%m-%d %H:%M:%S.%f"


# What the sample requests are worth, by hand.
_CORES = """CASE {} WHEN '500m' THEN 1 WHEN '2' THEN 2 WHEN '1500m' THEN 2 WHEN '0' THEN 1 WHEN '250m' THEN 1 WHEN '1e0' THEN 1
    WHEN '2500m' THEN 3 WHEN '1.5' THEN 2 WHEN '25e-1' THEN 3 END"""
_MEMORY = """CASE {} WHEN '512Mi' THEN '512m' WHEN '2Gi' THEN '2g' WHEN '1536Mi' THEN '1536m' WHEN '1G' THEN '953m' WHEN '1Gi' THEN '1g'
    WHEN '1.5Gi' THEN '1536m' WHEN '2e9' THEN '1907m' WHEN '1Ei' THEN '1073741824g' WHEN '4096Mi' THEN '4g' WHEN '3E9' THEN '2861m'
    WHEN '1048576Ki' THEN '1g' END"""

_DESIRED = """CAST(CASE WHEN executors > 0 THEN executors
    WHEN input_size_mb > 0 THEN least(greatest(CAST(input_size_mb // 256 AS INTEGER), min_executors), max_executors)
    WHEN min_executors > 0 THEN min_executors ELSE 1 END AS INTEGER)"""

_RUNNING = """
  owned AS (SELECT owner_uid, count(*) FILTER (WHERE phase = 'Running') AS running
            FROM (SELECT unnest(list_distinct(owner_uids)) AS owner_uid, phase FROM pods WHERE role = 'executor')
            GROUP BY 1),
  drivers AS (SELECT namespace, run AS name, uid AS owner_uid, name AS driver_pod, phase AS driver_phase
              FROM pods WHERE role = 'driver'),
  rx AS (SELECT j.*, d.driver_pod, d.driver_phase, CAST(coalesce(o.running, 0) AS BIGINT) AS running
         FROM job_runs j LEFT JOIN drivers d ON d.namespace = j.namespace AND d.name = j.name
         LEFT JOIN owned o ON o.owner_uid = d.owner_uid)"""

_RATE = """CASE WHEN TRY_CAST(cost_per_hour AS DOUBLE) IS NULL OR TRY_CAST(cost_per_hour AS DOUBLE) <= 0
    THEN 0.10 ELSE TRY_CAST(cost_per_hour AS DOUBLE) END"""


def _cost_sql(pods: str, start: str = "start_time", end: str = "completion_time") -> str:
    return f"""CASE WHEN {start} IS NULL THEN 0.0 ELSE round(greatest((epoch_us(coalesce({end},
    TIMESTAMP '{V.AS_OF}')) - epoch_us({start})) / 3.6e9, 0.0) * {_RATE} * ({pods}), 4) END"""


def _when(df, *cols: str):
    """Times as text."""
    return df.withColumns({c: F.date_format(c, TS_FMT) for c in cols})


def _as_of():
    return F.lit(V.AS_OF).cast("timestamp")


def _w(views, ctes, body):
    """WITH <views>, <extra ctes> <body>"""
    head = with_views("", *views).rstrip()
    return f"{head},{ctes}\n{body}"


@register("capacity_plan", with_views(f"""
  SELECT namespace, name, {_DESIRED} AS desired_executors, CAST({_CORES.format('exec_cpu')} AS BIGINT) AS executor_cores,
    {_MEMORY.format('exec_memory')} AS executor_memory, CAST({_CORES.format('driver_cpu')} AS BIGINT) AS driver_cores,
    {_MEMORY.format('driver_memory')} AS driver_memory
  FROM job_runs""", "job_runs"))
def capacity_plan(spark, sf):
    return FL.capacity_plan(V.job_runs(spark, sf))


def _runs_with_executors(spark, sf):
    return FL.running_executors(V.job_runs(spark, sf), V.pods(spark, sf))


@register("running_executors", _w(["job_runs", "pods"], _RUNNING, """
  SELECT namespace, name, driver_pod, running FROM rx"""))
def running_executors(spark, sf):
    return _runs_with_executors(spark, sf).select("namespace", "name", "driver_pod", "running")


@register("scheduling_drag", _w(["job_runs", "pods"], _RUNNING, f"""
  SELECT namespace, name, {_DESIRED} AS desired, running, {_DESIRED} - running AS drag FROM rx"""))
def scheduling_drag(spark, sf):
    r = _runs_with_executors(spark, sf)
    d = FL.desired_executors()
    return r.select("namespace", "name", d.alias("desired"), "running", (d - F.col("running")).alias("drag"))


@register("run_cost", _w(["job_runs", "pods"], _RUNNING, f"""
  SELECT namespace, name, {_cost_sql('1 + running')} AS cost_usd FROM rx"""))
def run_cost(spark, sf):
    r = _runs_with_executors(spark, sf)
    cost = FL.cost_usd(F.col("start_time"), F.col("completion_time"), 1 + F.col("running"),
                       FL.rate_per_hour("cost_per_hour"), _as_of())
    return r.select("namespace", "name", cost.alias("cost_usd"))


@register("fleet_cost", _w(["job_runs", "pods", "training_runs"], _RUNNING, f"""
  SELECT namespace, CAST(round(sum(CAST(job_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS job_cost,
    CAST(round(sum(CAST(training_cost AS DECIMAL(18,4))), 2) AS DOUBLE) AS training_cost,
    CAST(round(sum(CAST(job_cost AS DECIMAL(18,4))) + sum(CAST(training_cost AS DECIMAL(18,4))), 2) AS DOUBLE)
      AS total_cost
  FROM (SELECT namespace, {_cost_sql('1 + running')} AS job_cost, 0.0 AS training_cost FROM rx
        UNION ALL
        SELECT namespace, 0.0, {_cost_sql('world_size')} FROM training_runs) GROUP BY 1"""))
def fleet_cost(spark, sf):
    """Cost of all job runs and all training runs, paired or not."""
    as_of = _as_of()

    # Sum in exact decimals (per-run costs carry 4 digits), so the rounded
    # totals do not depend on the order the partial sums are added in.
    def costs(runs, pods, job: bool):
        cost = FL.cost_usd(F.col("start_time"), F.col("completion_time"), pods, FL.rate_per_hour("cost_per_hour"), as_of)
        cost, none = cost.cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")
        return runs.select("namespace", (cost if job else none).alias("j"), (none if job else cost).alias("t"))

    both = costs(_runs_with_executors(spark, sf), 1 + F.col("running"), True).union(
        costs(V.training_runs(spark, sf), F.col("world_size"), False))
    return (both.groupBy("namespace").agg(F.sum("j").alias("j"), F.sum("t").alias("t"))
                .select("namespace", F.round("j", 2).cast("double").alias("job_cost"),
                        F.round("t", 2).cast("double").alias("training_cost"),
                        F.round(F.col("j") + F.col("t"), 2).cast("double").alias("total_cost")))


_JOB_STATUS_SQL = f"""
  SELECT namespace, name, phase, retries, running, desired, driver_pod, strftime(started, '{DUCK_TS_FMT}') AS start_time,
    strftime(completed, '{DUCK_TS_FMT}') AS completion_time, {_cost_sql('1 + running', 'started', 'completed')} AS cost_usd
  FROM (
    SELECT namespace, name, cost_per_hour, running, {_DESIRED} AS desired, driver_pod,
      CASE WHEN NOT live THEN phase
        WHEN driver_phase IN ('Pending', 'Running', 'Succeeded') THEN driver_phase
        WHEN driver_phase = 'Failed' AND retries < max_retries THEN 'Resuming'
        WHEN driver_phase = 'Failed' THEN 'Failed' ELSE phase END AS phase,
      CASE WHEN live AND driver_phase = 'Failed' AND retries < max_retries THEN retries + 1 ELSE retries END AS retries,
      coalesce(start_time, CASE WHEN live AND driver_phase = 'Running' THEN TIMESTAMP '{V.AS_OF}' END) AS started,
      coalesce(completion_time, CASE WHEN live AND (driver_phase = 'Succeeded' OR driver_phase = 'Failed' AND retries >= max_retries)
        THEN TIMESTAMP '{V.AS_OF}' END) AS completed
    FROM (SELECT *, phase NOT IN ('Succeeded', 'Failed') AS live FROM rx))"""


@register("job_status", _w(["job_runs", "pods"], _RUNNING, _JOB_STATUS_SQL))
def job_status(spark, sf):
    return _when(FL.job_status(V.job_runs(spark, sf), V.pods(spark, sf), _as_of()), "start_time", "completion_time")


@register("phase_counts", _w(["job_runs", "pods"], _RUNNING, f"""
  SELECT phase, count(*) AS n_runs FROM ({_JOB_STATUS_SQL}) GROUP BY 1"""))
def phase_counts(spark, sf):
    return FL.phase_counts(FL.job_status(V.job_runs(spark, sf), V.pods(spark, sf), _as_of()))


@register("phase_gauge", with_views(f"""
  SELECT namespace, name, g AS gauge_phase, CAST(g = phase AS INTEGER) AS value
  FROM job_runs, (SELECT unnest({FL.PHASES!r}) AS g)""".replace('"', "'"), "job_runs"))
def phase_gauge(spark, sf):
    return FL.phase_gauge(V.job_runs(spark, sf))


@register("training_status", with_views(f"""
  SELECT namespace, name, phase, ready_workers, resumes, strftime(started, '{DUCK_TS_FMT}') AS start_time,
    strftime(completed, '{DUCK_TS_FMT}') AS completion_time, last_checkpoint, {_cost_sql('world_size', 'started', 'completed')} AS cost_usd
  FROM (
    SELECT namespace, name, world_size, cost_per_hour, last_checkpoint, ready_workers, new_phase AS phase,
      CASE WHEN new_phase = 'Resuming' THEN resumes + 1 ELSE resumes END AS resumes,
      coalesce(start_time, CASE WHEN new_phase = 'Running' THEN TIMESTAMP '{V.AS_OF}' END) AS started,
      coalesce(completion_time, CASE WHEN new_phase IN ('Succeeded', 'Failed') THEN TIMESTAMP '{V.AS_OF}' END) AS completed
    FROM (
      SELECT t.*, CAST(coalesce(p.ready_workers, 0) AS BIGINT) AS ready_workers,
        CASE WHEN coalesce(p.succeeded, 0) = world_size AND world_size > 0 THEN 'Succeeded'
          WHEN coalesce(p.failed, 0) > 0 AND resumes < max_retries THEN 'Resuming'
          WHEN coalesce(p.failed, 0) > 0 THEN 'Failed'
          WHEN coalesce(p.ready_workers, 0) = world_size AND world_size > 0 THEN 'Running' ELSE 'Pending' END AS new_phase
      FROM training_runs t LEFT JOIN (
        SELECT namespace, run, count(*) FILTER (WHERE phase = 'Running' AND ready) AS ready_workers,
          count(*) FILTER (WHERE phase = 'Failed') AS failed, count(*) FILTER (WHERE phase = 'Succeeded') AS succeeded
        FROM pods GROUP BY namespace, run) p ON p.namespace = t.namespace AND p.run = t.name))""", "training_runs", "pods"))
def training_status(spark, sf):
    return _when(FL.training_status(V.training_runs(spark, sf), V.pods(spark, sf), _as_of()), "start_time", "completion_time")


@register("rank_diff", with_views("""
  SELECT namespace, name, CAST(rank AS INTEGER) AS rank, 'create' AS action
  FROM (SELECT namespace, name, unnest(range(0, world_size)) AS rank FROM training_runs) w
  WHERE NOT EXISTS (SELECT 1 FROM pods p WHERE p.namespace = w.namespace AND p.run = w.name AND p.rank = w.rank)
  UNION ALL
  SELECT t.namespace, t.name, p.rank, 'delete' FROM pods p JOIN training_runs t ON p.namespace = t.namespace AND p.run = t.name
  WHERE p.rank >= t.world_size""",
  "training_runs", "pods"))
def rank_diff(spark, sf):
    return FL.rank_diff(V.training_runs(spark, sf), V.pods(spark, sf))


@register("missing_deps", with_views("""
  SELECT namespace, run, kind, ref_name, 'waiting for ' || kind || ' "' || ref_name || '"' AS message
  FROM (SELECT r.*, row_number() OVER (PARTITION BY namespace, run ORDER BY pos) AS rn FROM dependency_refs r
        WHERE NOT optional AND NOT EXISTS (SELECT 1 FROM live_objects o
          WHERE o.namespace = r.namespace AND o.kind = r.kind AND o.obj_name = r.ref_name))
  WHERE rn = 1""", "dependency_refs", "live_objects"))
def missing_deps(spark, sf):
    return FL.missing_dependencies(V.dependency_refs(spark, sf), V.live_objects(spark, sf))


@register("run_times", with_views(f"""
  SELECT namespace, run, strftime(min(ts) FILTER (WHERE phase = 'Running'), '{DUCK_TS_FMT}') AS start_time,
    strftime(min(ts) FILTER (WHERE phase IN ('Succeeded', 'Failed')), '{DUCK_TS_FMT}') AS completion_time
  FROM status_history GROUP BY namespace, run""", "status_history"))
def run_times(spark, sf):
    return _when(FL.run_times(V.status_history(spark, sf)), "start_time", "completion_time")


@register("history_retention", with_views("""
  SELECT r.name, r.namespace, r.template, r.phase,
    r.rn <= CASE WHEN r.phase = 'Succeeded' THEN coalesce(t.keep_succeeded, 3) ELSE coalesce(t.keep_failed, 3) END AS keep
  FROM (SELECT name, namespace, template, phase,
          row_number() OVER (PARTITION BY namespace, template, phase ORDER BY created DESC, name) AS rn
        FROM job_runs WHERE phase IN ('Succeeded', 'Failed')) r
  LEFT JOIN cron_templates t ON t.namespace = r.namespace AND t.template = r.template""", "job_runs", "cron_templates"))
def history_retention(spark, sf):
    return FL.retention(V.job_runs(spark, sf), V.cron_templates(spark, sf))


@register("status_changes", with_views("""
  SELECT event_id, namespace, run, phase, running, desired, driver_pod, retries, cost FROM (
    SELECT *, row_number() OVER w AS rn, lag(phase) OVER w AS p1, lag(running) OVER w AS p2,
      lag(desired) OVER w AS p3, lag(driver_pod) OVER w AS p4, lag(retries) OVER w AS p5, lag(cost) OVER w AS p6
    FROM status_history WINDOW w AS (PARTITION BY namespace, run ORDER BY ts, event_id))
  WHERE rn = 1 OR p1 IS DISTINCT FROM phase OR p2 IS DISTINCT FROM running OR p3 IS DISTINCT FROM desired
    OR p4 IS DISTINCT FROM driver_pod OR p5 IS DISTINCT FROM retries OR p6 IS DISTINCT FROM cost""",
  "status_history"))
def status_changes(spark, sf):
    h = V.status_history(spark, sf)
    return FL.status_changes(h).select("event_id", "namespace", "run", "phase", "running", "desired", "driver_pod",
                                       "retries", "cost")


@register("attempts", with_views("""
  SELECT namespace, run, event_id, attempt, CASE WHEN attempt <= user_id % 4 THEN 'Resuming' ELSE 'Failed' END AS phase
  FROM (SELECT *, row_number() OVER (PARTITION BY namespace, run ORDER BY ts, event_id) AS attempt
        FROM status_history WHERE phase = 'Failed')""", "status_history"))
def attempts(spark, sf):
    f = V.status_history(spark, sf).filter(F.col("phase") == "Failed") \
         .withColumn("max_retries", F.col("user_id") % 4)
    return FL.attempts(f).select("namespace", "run", "event_id", "attempt", "phase")


@register("outcome_counts", with_views("""
  SELECT result, count(*) AS n_passes FROM status_history GROUP BY 1""", "status_history"))
def outcome_counts(spark, sf):
    return FL.outcome_counts(V.status_history(spark, sf))


@register("live_series", with_views(f"""
  SELECT namespace, run, strftime(ts, '{DUCK_TS_FMT}') AS last_ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace, run ORDER BY ts DESC, event_id DESC) AS rn FROM status_history
    WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'))
  WHERE rn = 1""", "status_history"))
def live_series(spark, sf):
    cu = V.table(spark, sf, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    runs = V.named_runs(cu, F.col("c_custkey"))
    s = FL.live_series(V.status_history(spark, sf), runs)
    return s.select("namespace", "run", F.date_format("last_ts", TS_FMT).alias("last_ts"), "value")


@register("config_overlay", with_views("""
  SELECT namespace, run, key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY namespace, run, key ORDER BY layer DESC, value DESC) AS rn FROM config_layers)
  WHERE rn = 1""", "config_layers"))
def config_overlay(spark, sf):
    return FL.config_overlay(V.config_layers(spark, sf))


# ----------------------------------------------------------- skewed forms
# A third of the rows folded onto one key, as a hot run / template would be.
_HOT_HISTORY = """status_hot AS (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 THEN 'run-hot' ELSE run END AS run)
                   FROM status_history)"""
_HOT_RUNS = """runs_hot AS (SELECT * REPLACE (CASE WHEN CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 3 = 0
                 THEN 'tmpl-hot' ELSE template END AS template,
                 CASE WHEN CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 3 = 0
                 THEN 'team-0' ELSE namespace END AS namespace) FROM job_runs)"""


def _hot_history(spark, sf):
    h = V.status_history(spark, sf)
    return h.withColumn("run", F.when(F.col("user_id") % 3 == 0, F.lit("run-hot")).otherwise(F.col("run")))


@register("status_changes_skewed", _w(["status_history"], _HOT_HISTORY, """
  SELECT event_id, namespace, run, phase, running, desired, driver_pod, retries, cost FROM (
    SELECT *, row_number() OVER w AS rn, lag(phase) OVER w AS p1, lag(running) OVER w AS p2,
      lag(desired) OVER w AS p3, lag(driver_pod) OVER w AS p4, lag(retries) OVER w AS p5, lag(cost) OVER w AS p6
    FROM status_hot WINDOW w AS (PARTITION BY namespace, run ORDER BY ts, event_id))
  WHERE rn = 1 OR p1 IS DISTINCT FROM phase OR p2 IS DISTINCT FROM running OR p3 IS DISTINCT FROM desired
    OR p4 IS DISTINCT FROM driver_pod OR p5 IS DISTINCT FROM retries OR p6 IS DISTINCT FROM cost"""))
def status_changes_skewed(spark, sf):
    """Status changes when one run holds a third of all statuses."""
    return FL.status_changes(_hot_history(spark, sf)).select(
        "event_id", "namespace", "run", "phase", "running", "desired", "driver_pod", "retries", "cost")


@register("phase_changes_skewed", _w(["status_history"], _HOT_HISTORY, """
  SELECT event_id, namespace, run, phase FROM (
    SELECT *, lag(phase) OVER (PARTITION BY namespace, run ORDER BY ts, event_id) AS p1 FROM status_hot)
  WHERE p1 IS DISTINCT FROM phase"""))
def phase_changes_skewed(spark, sf):
    """Phase-only changes on the hot run (a selective change filter)."""
    return FL.status_changes(_hot_history(spark, sf), ["phase"]).select("event_id", "namespace", "run", "phase")


@register("attempts_skewed", _w(["status_history"], _HOT_HISTORY, """
  SELECT namespace, run, event_id, attempt, CASE WHEN attempt <= user_id % 4 THEN 'Resuming' ELSE 'Failed' END AS phase
  FROM (SELECT *, row_number() OVER (PARTITION BY namespace, run ORDER BY ts, event_id) AS attempt
        FROM status_hot WHERE phase = 'Failed')"""))
def attempts_skewed(spark, sf):
    f = _hot_history(spark, sf).filter(F.col("phase") == "Failed").withColumn("max_retries", F.col("user_id") % 4)
    return FL.attempts(f).select("namespace", "run", "event_id", "attempt", "phase")


@register("history_retention_skewed", _w(["job_runs", "cron_templates"], _HOT_RUNS, """
  SELECT r.name, r.namespace, r.template, r.phase,
    r.rn <= CASE WHEN r.phase = 'Succeeded' THEN coalesce(t.keep_succeeded, 3) ELSE coalesce(t.keep_failed, 3) END AS keep
  FROM (SELECT name, namespace, template, phase,
          row_number() OVER (PARTITION BY namespace, template, phase ORDER BY created DESC, name) AS rn
        FROM runs_hot WHERE phase IN ('Succeeded', 'Failed')) r
  LEFT JOIN cron_templates t ON t.namespace = r.namespace AND t.template = r.template"""))
def history_retention_skewed(spark, sf):
    """Retention when one template owns a third of all runs."""
    j = V.job_runs(spark, sf)
    k = F.regexp_extract(F.col("name"), r"(\d+)$", 1).cast("bigint")
    j = j.withColumns({c: F.when(k % 3 == 0, F.lit(hot)).otherwise(F.col(c))
                       for c, hot in (("template", "tmpl-hot"), ("namespace", "team-0"))})
    return FL.retention(j, V.cron_templates(spark, sf))


_HOT_PODS = """pods_hot AS (SELECT * REPLACE (
    CASE WHEN role = 'executor' AND CAST(regexp_extract(run, '(\\d+)$', 1) AS BIGINT) % 3 = 0 THEN 'team-0' ELSE namespace END AS namespace,
    CASE WHEN role = 'executor' AND CAST(regexp_extract(run, '(\\d+)$', 1) AS BIGINT) % 3 = 0
      THEN [(SELECT arg_min(uid, CAST(regexp_extract(run, '(\\d+)$', 1) AS BIGINT)) FROM pods WHERE role = 'driver' AND namespace = 'team-0')]
      ELSE owner_uids END AS owner_uids) FROM pods),
  owned AS (SELECT owner_uid, count(*) FILTER (WHERE phase = 'Running') AS running
            FROM (SELECT unnest(list_distinct(owner_uids)) AS owner_uid, phase FROM pods_hot WHERE role = 'executor')
            GROUP BY 1),
  drivers AS (SELECT namespace, run AS name, uid AS owner_uid, name AS driver_pod FROM pods_hot WHERE role = 'driver')"""


@register("running_executors_skewed", _w(["job_runs", "pods"], _HOT_PODS, """
  SELECT j.namespace, j.name, d.driver_pod, CAST(coalesce(o.running, 0) AS BIGINT) AS running
  FROM job_runs j LEFT JOIN drivers d ON d.namespace = j.namespace AND d.name = j.name LEFT JOIN owned o ON o.owner_uid = d.owner_uid"""))
def running_executors_skewed(spark, sf):
    """Executor counts when one driver owns a third of all executors."""
    p = V.pods(spark, sf)
    k = F.regexp_extract(F.col("run"), r"(\d+)$", 1).cast("bigint")
    # the hot owner: the driver of the lowest order of its namespace that has one (one scalar)
    hot = p.filter((F.col("role") == "driver") & (F.col("namespace") == "team-0")).agg(F.min_by("uid", k).alias("u")).first().u
    moved = (F.col("role") == "executor") & (k % 3 == 0)
    p = p.withColumns({"owner_uids": F.when(moved, F.array(F.lit(hot))).otherwise(F.col("owner_uids")),
                       "namespace": F.when(moved, F.lit("team-0")).otherwise(F.col("namespace"))})
    return FL.running_executors(V.job_runs(spark, sf), p).select("namespace", "name", "driver_pod", "running")


# ------------------------------------------------------- training changes
@register("training_changes", with_views("""
  SELECT event_id, namespace, run, phase, ready_workers, resumes, cost, last_checkpoint FROM (
    SELECT *, row_number() OVER w AS rn, lag(phase) OVER w AS p1, lag(ready_workers) OVER w AS p2, lag(resumes) OVER w AS p3,
      lag(cost) OVER w AS p4, lag(last_checkpoint) OVER w AS p5
    FROM (SELECT event_id, namespace, run, ts, phase, running // 2 AS ready_workers, 0 AS resumes, CAST(user_id % 2 AS VARCHAR) AS cost,
            CASE WHEN event_id % 4 > 0 THEN 's3a://ck/' || CAST(user_id AS VARCHAR) END AS last_checkpoint FROM status_history)
    WINDOW w AS (PARTITION BY namespace, run ORDER BY ts, event_id))
  WHERE rn = 1 OR p1 IS DISTINCT FROM phase OR p2 IS DISTINCT FROM ready_workers OR p3 IS DISTINCT FROM resumes
    OR p4 IS DISTINCT FROM cost OR p5 IS DISTINCT FROM last_checkpoint""", "status_history"))
def training_changes(spark, sf):
    """Statuses of training runs that differ from the one before, a new or a lost checkpoint included."""
    h = V.status_history(spark, sf).select(
        "event_id", "namespace", "run", "ts", "phase", F.floor(F.col("running") / 2).cast("int").alias("ready_workers"),
        F.lit(0).alias("resumes"), (F.col("user_id") % 2).cast("string").alias("cost"),
        F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("s3a://ck/"), F.col("user_id").cast("string"))).alias("last_checkpoint"))
    return FL.status_changes(h, FL.TRAINING_FIELDS).select("event_id", "namespace", "run", *FL.TRAINING_FIELDS)
