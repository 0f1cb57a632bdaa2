"""Run-fleet analytics over job / training run records, pods and status
history: sizing, cost, status rollups, joins between runs and pods,
retention, attempts, change detection, gauges, config overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brook.functions.quantity import spark_memory, whole_cores
from brook.operators.sequence import previous_values, row_number_within

# Run phases in their declared order, the terminal ones, the
# default rate per pod-hour, executors per MB of input, and history limits.
PHASES = ["Pending", "Running", "Checkpointing", "Resuming", "Succeeded", "Failed"]
TERMINAL = ["Succeeded", "Failed"]
DEFAULT_RATE = 0.10
MB_PER_EXECUTOR = 256
DEFAULT_KEEP = 3

# What names a run; names alone repeat across namespaces.
RUN = ["namespace", "name"]
RUN_OF = ["namespace", "run"]


# ------------------------------------------------------------- sizing
def desired_executors(executors="executors", min_e="min_executors", max_e="max_executors",
                      hint="input_size_mb") -> Column:
    """Explicit count if > 0; else input hint div 256 raised to min then cut
    to max; else min if > 0; else 1."""
    ex, lo, hi, mb = (F.col(c) for c in (executors, min_e, max_e, hint))
    by_hint = F.least(F.greatest((mb / MB_PER_EXECUTOR).cast("int"), lo), hi)
    return (F.when(ex > 0, ex).when(mb > 0, by_hint).when(lo > 0, lo).otherwise(F.lit(1))).cast("int")


def capacity_plan(specs: DataFrame) -> DataFrame:
    """Executors wanted, and the cores and memory of executors and driver; a
    request that is not made sizes nothing."""
    def asked(size: Column, request: str) -> Column:
        return F.when(F.col(request).isNotNull(), size)

    return specs.select(
        *RUN, desired_executors().alias("desired_executors"),
        asked(whole_cores("exec_cpu"), "exec_cpu").alias("executor_cores"),
        asked(spark_memory("exec_memory"), "exec_memory").alias("executor_memory"),
        asked(whole_cores("driver_cpu"), "driver_cpu").alias("driver_cores"),
        asked(spark_memory("driver_memory"), "driver_memory").alias("driver_memory"))


# --------------------------------------------------------------- cost
def rate_per_hour(col) -> Column:
    r = F.expr(f"try_cast({col} AS DOUBLE)") if isinstance(col, str) else col.try_cast("double")
    return F.when(r.isNull() | (r <= 0), F.lit(DEFAULT_RATE)).otherwise(r)


def cost_usd(start: Column, end: Column, pods: Column, rate: Column, as_of: Column) -> Column:
    """hours x rate x pods, 4 digits; not started -> 0; end defaults to as_of;
    negative durations count 0."""
    stop = F.coalesce(end, as_of)
    hours = F.greatest((F.unix_micros(stop) - F.unix_micros(start)) / 3.6e9, F.lit(0.0))
    return F.when(start.isNull(), F.lit(0.0)).otherwise(F.round(hours * rate * pods, 4))


# ------------------------------------------------------- pods and runs
def running_executors(runs: DataFrame, pods: DataFrame) -> DataFrame:
    """Per run: executors owned by the run's driver pod that are Running.

    Running executors are counted by (namespace, owner uid), an owner listed
    twice once; the count is a hash aggregate that combines map-side, so a
    driver owning a third of all pods sends one row per task.  Drivers are a
    filter of the pods; both filters reach the scan.  Runs join last by
    (namespace, name), so names may repeat across namespaces and runs without
    pods keep 0.
    """
    drivers = pods.filter(F.col("role") == "driver").select(
        "namespace", F.col("run").alias("name"), F.col("uid").alias("_uid"), F.col("name").alias("driver_pod"),
        F.col("phase").alias("driver_phase"))
    owned = (pods.filter((F.col("role") == "executor") & (F.col("phase") == "Running"))
                 .select("namespace", F.explode(F.array_distinct("owner_uids")).alias("_uid"))
                 .groupBy("namespace", "_uid").agg(F.count(F.lit(1)).alias("running")))
    return (runs.join(drivers.join(owned, ["namespace", "_uid"], "left").drop("_uid"), RUN, "left")
                .withColumn("running", F.coalesce(F.col("running"), F.lit(0)).cast("bigint")))


def _observed(start: Column, completion: Column, as_of: Column) -> dict[str, Column]:
    """Times as first observed: one that is known stays."""
    return {"start_time": F.coalesce("start_time", F.when(start, as_of)),
            "completion_time": F.coalesce("completion_time", F.when(completion, as_of))}


def job_status(runs: DataFrame, pods: DataFrame, as_of: Column) -> DataFrame:
    """Driver pod phase -> job phase: Failed becomes Resuming while retries
    are left (and consumes one); terminal runs are frozen; an unknown driver
    phase keeps the previous phase.  A driver first seen Running starts the run
    at ``as_of``, one that succeeded or finally failed completes it; the cost
    counts the driver and its running executors from then to then."""
    r = running_executors(runs, pods)
    live = ~F.coalesce(F.col("phase").isin(*TERMINAL), F.lit(False))
    dp = F.col("driver_phase")
    retry = (dp == "Failed") & (F.col("retries") < F.col("max_retries"))
    phase = (F.when(~live, F.col("phase"))
             .when(dp.isin("Pending", "Running", "Succeeded"), dp)
             .when(retry, F.lit("Resuming"))
             .when(dp == "Failed", F.lit("Failed"))
             .otherwise(F.col("phase")))
    retries = F.when(live & retry, F.col("retries") + 1).otherwise(F.col("retries"))
    times = _observed(live & (dp == "Running"), live & ((dp == "Succeeded") | ((dp == "Failed") & ~retry)), as_of)
    out = r.select(*RUN, phase.alias("phase"), retries.alias("retries"), "running", desired_executors().alias("desired"),
                   "driver_pod", *[c.alias(n) for n, c in times.items()], "cost_per_hour")
    cost = cost_usd(F.col("start_time"), F.col("completion_time"), 1 + F.col("running"), rate_per_hour("cost_per_hour"), as_of)
    return out.withColumn("cost_usd", cost).drop("cost_per_hour")


def training_status(runs: DataFrame, pods: DataFrame, as_of: Column) -> DataFrame:
    """Worker phases -> run phase, first match wins: all succeeded;
    any failed (Resuming while resumes are left, else Failed); all ready;
    else Pending.  Ready = Running with condition Ready=True.  All ready starts
    the run at ``as_of``, success or the last failure completes it; the cost
    counts every worker.  The last checkpoint is carried on."""
    ready = (F.col("phase") == "Running") & F.exists("conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    per_run = (pods.groupBy("namespace", F.col("run").alias("name"))
                   .agg(F.count_if(ready).alias("ready_workers"),
                        F.count_if(F.col("phase") == "Failed").alias("failed"),
                        F.count_if(F.col("phase") == "Succeeded").alias("succeeded")))
    j = runs.join(per_run, RUN, "left").fillna(0, ["ready_workers", "failed", "succeeded"])
    ws = F.col("world_size")
    done = (F.col("succeeded") == ws) & (ws > 0)
    failed = ~done & (F.col("failed") > 0)
    resume = failed & (F.col("resumes") < F.col("max_retries"))
    running = ~done & ~failed & (F.col("ready_workers") == ws) & (ws > 0)
    phase = (F.when(done, "Succeeded").when(resume, "Resuming").when(failed, "Failed").when(running, "Running").otherwise("Pending"))
    resumes = F.when(resume, F.col("resumes") + 1).otherwise(F.col("resumes"))
    out = j.select(*RUN, phase.alias("phase"), F.col("ready_workers").cast("bigint").alias("ready_workers"), resumes.alias("resumes"),
                   *[c.alias(n) for n, c in _observed(running, done | (failed & ~resume), as_of).items()], "last_checkpoint",
                   "world_size", "cost_per_hour")
    cost = cost_usd(F.col("start_time"), F.col("completion_time"), ws, rate_per_hour("cost_per_hour"), as_of)
    return out.withColumn("cost_usd", cost).drop("world_size", "cost_per_hour")


def rank_diff(runs: DataFrame, pods: DataFrame) -> DataFrame:
    """Ranks 0..world_size-1 without a worker (create) and workers whose rank
    is at or above the world size (delete)."""
    want = runs.filter("world_size > 0").select(*RUN, F.explode(F.sequence(F.lit(0), F.col("world_size") - 1)).alias("rank"))
    have = pods.select("namespace", F.col("run").alias("name"), "rank")
    missing = want.join(have, [*RUN, "rank"], "left_anti").withColumn("action", F.lit("create"))
    excess = (have.join(runs.select(*RUN, "world_size"), RUN)
                  .filter(F.col("rank") >= F.col("world_size"))
                  .select(*RUN, "rank", F.lit("delete").alias("action")))
    return missing.unionByName(excess)


def missing_dependencies(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """First non-optional reference (declared order) with no object, per run."""
    need = refs.filter(~F.col("optional"))
    miss = need.join(objects.withColumnRenamed("obj_name", "ref_name"),
                     ["namespace", "kind", "ref_name"], "left_anti")
    first = miss.groupBy(*RUN_OF).agg(F.min(F.struct("pos", "kind", "ref_name")).alias("m"))
    return first.select(*RUN_OF, F.col("m.kind").alias("kind"), F.col("m.ref_name").alias("ref_name"),
                        F.format_string('waiting for %s "%s"', F.col("m.kind"), F.col("m.ref_name")).alias("message"))


# ------------------------------------------------------------- history
def run_times(history: DataFrame) -> DataFrame:
    """First time seen Running = start; first time seen terminal = completion."""
    return history.groupBy(*RUN_OF).agg(
        F.min(F.when(F.col("phase") == "Running", F.col("ts"))).alias("start_time"),
        F.min(F.when(F.col("phase").isin(*TERMINAL), F.col("ts"))).alias("completion_time"))


def retention(runs: DataFrame, templates: DataFrame) -> DataFrame:
    """Per template (named within its namespace) and outcome keep the newest N
    finished runs (template limits, default 3, 0 keeps none); the others are
    victims.  Unfinished runs are not listed.

    Runs are numbered from the newest on with the segmented row number, which
    cuts a template with a third of all runs into many tasks and costs the same
    whatever the limits are: a template that keeps 100,000 runs costs the
    others nothing.
    """
    keys = ["namespace", "template"]
    limits = templates.select(*keys, *[F.coalesce(c, F.lit(DEFAULT_KEEP)).alias(c) for c in ("keep_succeeded", "keep_failed")])
    done = runs.filter(F.col("phase").isin(*TERMINAL)).select("name", *keys, "phase", "created")
    # Newest first, runs without a time last.
    age = F.coalesce(-F.unix_micros("created"), F.lit((1 << 63) - 1))
    numbered = row_number_within(done.withColumn("_age", age), [*keys, "phase"], ["_age", "name"], "_place")
    limit = F.coalesce(F.when(F.col("phase") == "Succeeded", F.col("keep_succeeded")).otherwise(F.col("keep_failed")), F.lit(DEFAULT_KEEP))
    return numbered.join(limits, keys, "left").select("name", *keys, "phase", (F.col("_place") <= limit).alias("keep"))


# The fields whose change makes a status of a job, of a training run.
STATUS_FIELDS = ["phase", "running", "desired", "driver_pod", "retries", "cost"]
TRAINING_FIELDS = ["phase", "ready_workers", "resumes", "cost", "last_checkpoint"]


def status_changes(history: DataFrame, cols=STATUS_FIELDS, key=RUN_OF, order=("ts", "event_id")) -> DataFrame:
    """Statuses that differ (null-safe) from the previous one of the same run
    in one of ``cols``; the first status of a run is always a change."""
    p = previous_values(history, key, list(order), cols)
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return p.filter(~F.col("has_prev") | changed).drop(*[f"prev_{c}" for c in cols], "has_prev")


def attempts(failures: DataFrame, max_col: str = "max_retries", key=RUN_OF, order=("ts", "event_id")) -> DataFrame:
    """k-th failure of a run: Resuming while k <= max retries, else Failed."""
    n = row_number_within(failures, key, list(order), "attempt")
    return n.withColumn("phase", F.when(F.col("attempt") <= F.col(max_col), "Resuming").otherwise("Failed"))


# ------------------------------------------------------------- gauges
def phase_gauge(status: DataFrame, phase="phase") -> DataFrame:
    """Per run one row per phase: 1 for its phase, 0 for the others."""
    phases = F.array(*[F.lit(p) for p in PHASES])
    return status.select(*RUN, F.explode(phases).alias("gauge_phase"), F.col(phase).alias("_p")) \
                 .select(*RUN, "gauge_phase", F.coalesce(F.col("gauge_phase") == F.col("_p"), F.lit(False)).cast("int").alias("value"))


def phase_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("phase").agg(F.count(F.lit(1)).alias("n_runs"))


def outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("result").agg(F.count(F.lit(1)).alias("n_passes"))


def live_series(samples: DataFrame, runs: DataFrame, key=RUN_OF) -> DataFrame:
    """Latest sample per run, for runs that still exist (left semi join)."""
    # Reduce to one row per run first (rn = 1 gets a partial WindowGroupLimit
    # before the shuffle, so a run holding a third of the samples sends one
    # row per map task), then keep the runs that still exist.
    w = Window.partitionBy(*key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    latest = samples.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return (latest.join(runs.select(*key), key, "left_semi")
                  .select(*key, F.col("ts").alias("last_ts"), "value"))


def config_overlay(layers: DataFrame) -> DataFrame:
    """Effective config: per run and key the value of the highest layer
    (defaults < derived < user); ties in a layer take the greatest value.
    ``row_number() = 1`` gets a partial group limit before the shuffle."""
    w = Window.partitionBy(*RUN_OF, "key").orderBy(F.col("layer").desc(), F.col("value").desc())
    return (layers.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
                  .select(*RUN_OF, "key", "value"))
