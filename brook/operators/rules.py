"""Rule reports over tables of run specs: one row per violated rule with its
severity (error / warning), field and the value found there.  Every rule is a
row-local expression; the report is an ``explode`` of the rules that fired.
Values that specs share and that are dear to check (schedules, zones, CPU
requests) are checked once each and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.functions.cron import with_parsed_cron
from brook.functions.quantity import millicores
from brook.operators.fleet import RUN
from brook.operators.schedule import valid_zone

# Accepted concurrency policies, checkpoint / dataset URI
# schemes, and the built-in trainers.
POLICIES = ["", "Allow", "Forbid", "Replace"]
S3_SCHEMES = ["s3://", "s3a://"]
BUILTIN_TRAINERS = ["BERTClassifier"]
# The column that each field of a report is found in.
FIELD_COLUMNS = {
    "spec.mainApplicationFile": "main_file", "spec.mainClass": "main_class", "spec.executors": "executors",
    "spec.minExecutors": "min_executors", "spec.maxExecutors": "max_executors", "spec.spot.maxRetries": "max_retries",
    "spec.checkpoint.s3URI": "checkpoint_uri", "spec.resourceHint.costPerHourUSD": "cost_per_hour",
    "spec.executorResources.requests.cpu": "exec_cpu", "spec.schedule": "schedule", "spec.concurrencyPolicy": "concurrency_policy",
    "spec.startingDeadlineSeconds": "starting_deadline_s", "spec.successfulJobsHistoryLimit": "keep_succeeded",
    "spec.failedJobsHistoryLimit": "keep_failed", "spec.timeZone": "time_zone", "spec.image": "image", "spec.worldSize": "world_size",
    "spec.datasetS3URI": "dataset_s3_uri", "spec.command": "command", "spec.builtinTrainer": "builtin_trainer", "spec.packages": "packages",
    "spec.gpu.perWorker": "gpu_per_worker", "spec.gpu.backend": "gpu_backend"}
LIST_FIELDS = ["spec.command", "spec.packages"]


def _rule(cond: Column, severity: str, rule: str, field: str) -> Column:
    value = F.col(FIELD_COLUMNS[field])
    value = F.array_join(value, " ") if field in LIST_FIELDS else value.cast("string")
    return F.when(F.coalesce(cond, F.lit(False)),
                  F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(field).alias("field"), value.alias("value")))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _bad_scheme(c: str) -> Column:
    v = F.coalesce(F.col(c), F.lit(""))
    ok = F.lit(False)
    for s in S3_SCHEMES:
        ok = ok | v.startswith(s)
    return (v != "") & ~ok


def _bad_rate(c: str) -> Column:
    v = F.coalesce(F.col(c), F.lit(""))
    d = v.try_cast("double")
    return (v != "") & (d.isNull() | (d < 0))


def _report(df: DataFrame, rules: list[Column], extra: Column | None = None) -> DataFrame:
    arr = F.array_compact(F.array(*rules))  # native null removal, no lambda
    if extra is not None:
        arr = F.concat(arr, extra)
    return df.select(*RUN, F.explode(arr).alias("r")).select(*RUN, "r.severity", "r.rule", "r.field", "r.value")


def _checked(specs: DataFrame) -> DataFrame:
    """``specs`` with what is dear to find out: whether the schedule parses,
    the zone exists and the CPU request is not positive.  Each combination that
    specs share is judged once."""
    shared = {"_s": "schedule", "_z": "time_zone", "_c": "exec_cpu"}
    each = specs.select(*[F.col(c).alias(n) for n, c in shared.items()]).distinct()
    no_cpu = F.col("_c").isNotNull() & F.coalesce(millicores("_c") <= 0, F.lit(True))
    judged = with_parsed_cron(each, "_s", "_cron").select(
        *shared, F.col("_cron.valid").alias("_cron_ok"), valid_zone(F.col("_z")).alias("_zone_ok"), no_cpu.alias("_no_cpu"))
    same = F.lit(True)
    for n, c in shared.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return specs.join(judged, same).drop(*shared)


def spec_report(specs: DataFrame) -> DataFrame:
    """Job spec rules (errors block a spec, warnings do not)."""
    d = _checked(specs)
    # A schedule of blanks is a bad expression, not a missing one.
    has_sched = F.coalesce(F.col("schedule"), F.lit("")) != ""
    zone = F.coalesce(F.col("time_zone"), F.lit(""))
    ex, lo, hi = F.col("executors"), F.col("min_executors"), F.col("max_executors")
    rules = [
        _rule(_blank("main_file"), "error", "main_file_required", "spec.mainApplicationFile"),
        _rule((F.col("type") == "Scala") & _blank("main_class"), "warning", "scala_without_main_class", "spec.mainClass"),
        _rule((F.col("type") == "Python") & ~_blank("main_class"), "warning", "python_with_main_class", "spec.mainClass"),
        _rule(ex < 0, "error", "negative", "spec.executors"),
        _rule(lo < 0, "error", "negative", "spec.minExecutors"),
        _rule(hi < 0, "error", "negative", "spec.maxExecutors"),
        _rule((lo > 0) & (hi > 0) & (lo > hi), "error", "min_above_max", "spec.minExecutors"),
        _rule((ex > 0) & ((lo > 0) | (hi > 0)), "warning", "executors_with_bounds", "spec.executors"),
        _rule(F.col("max_retries") < 0, "error", "negative", "spec.spot.maxRetries"),
        _rule(F.col("checkpoint_enabled") & _blank("checkpoint_uri"), "error", "required", "spec.checkpoint.s3URI"),
        _rule(_bad_scheme("checkpoint_uri"), "error", "bad_scheme", "spec.checkpoint.s3URI"),
        _rule(_bad_rate("cost_per_hour"), "error", "bad_rate", "spec.resourceHint.costPerHourUSD"),
        _rule(F.col("_no_cpu"), "error", "cpu_not_positive", "spec.executorResources.requests.cpu"),
        _rule(has_sched & ~F.coalesce(F.col("_cron_ok"), F.lit(False)), "error", "bad_cron", "spec.schedule"),
        _rule(has_sched & ~F.coalesce(F.col("concurrency_policy"), F.lit("")).isin(*POLICIES),
              "error", "bad_policy", "spec.concurrencyPolicy"),
        _rule(has_sched & (F.col("starting_deadline_s") < 0), "error", "negative", "spec.startingDeadlineSeconds"),
        _rule(has_sched & (F.col("keep_succeeded") < 0), "error", "negative", "spec.successfulJobsHistoryLimit"),
        _rule(has_sched & (F.col("keep_failed") < 0), "error", "negative", "spec.failedJobsHistoryLimit"),
        _rule(~has_sched & ((F.coalesce(F.col("concurrency_policy"), F.lit("")) != "") | F.col("suspend").isNotNull()
                            | F.col("time_zone").isNotNull() | F.col("starting_deadline_s").isNotNull()
                            | F.col("keep_succeeded").isNotNull() | F.col("keep_failed").isNotNull()),
              "warning", "schedule_fields_without_schedule", "spec.schedule"),
        _rule((zone != "") & ~F.coalesce(F.col("_zone_ok"), F.lit(False)),
              "error", "bad_zone", "spec.timeZone"),
    ]
    conf = F.transform(F.filter(F.map_entries(F.coalesce(F.col("spark_conf"), F.create_map().cast("map<string,string>"))),
                                lambda x: ~x["key"].startswith("spark.")),
                       lambda x: F.struct(F.lit("warning").alias("severity"), F.lit("conf_key_prefix").alias("rule"),
                                          F.concat(F.lit("spec.sparkConf["), x["key"], F.lit("]")).alias("field"), x["value"].alias("value")))
    return _report(d, rules, conf)


def training_spec_report(specs: DataFrame) -> DataFrame:
    """Training run spec rules."""
    gpu = F.coalesce(F.col("gpu_enabled"), F.lit(False))
    script = ~_blank("script")
    command = F.size(F.coalesce(F.col("command"), F.array())) > 0
    rules = [
        _rule(_blank("image"), "error", "required", "spec.image"),
        _rule(F.col("world_size") < 1, "error", "world_size_below_one", "spec.worldSize"),
        _rule((F.coalesce(F.col("dataset_pvc"), F.lit("")) != "") & (F.coalesce(F.col("dataset_s3_uri"), F.lit("")) != ""),
              "error", "two_dataset_sources", "spec.datasetS3URI"),
        _rule(_bad_scheme("dataset_s3_uri"), "error", "bad_scheme", "spec.datasetS3URI"),
        _rule(script & command, "warning", "script_with_command", "spec.command"),
        _rule(script & (F.coalesce(F.col("builtin_trainer"), F.lit("")) != ""), "warning", "script_with_builtin",
              "spec.builtinTrainer"),
        _rule((F.coalesce(F.col("builtin_trainer"), F.lit("")) != "")
              & ~F.col("builtin_trainer").isin(*BUILTIN_TRAINERS), "error", "unknown_builtin", "spec.builtinTrainer"),
        _rule((F.size(F.coalesce(F.col("packages"), F.array())) > 0) & command, "warning", "packages_with_command",
              "spec.packages"),
        _rule(gpu & (F.col("gpu_per_worker") < 1), "error", "gpu_per_worker_below_one", "spec.gpu.perWorker"),
        _rule(gpu & (F.col("gpu_backend") == "gloo"), "warning", "gpu_with_gloo", "spec.gpu.backend"),
        _rule(~gpu & (F.col("gpu_backend") == "nccl"), "warning", "nccl_without_gpu", "spec.gpu.backend"),
        _rule(~gpu & (F.col("gpu_per_worker") > 1), "warning", "per_worker_without_gpu", "spec.gpu.perWorker"),
        _rule(F.col("max_retries") < 0, "error", "negative", "spec.spot.maxRetries"),
        _rule(F.col("checkpoint_enabled") & _blank("checkpoint_uri"), "error", "required", "spec.checkpoint.s3URI"),
        _rule(_bad_scheme("checkpoint_uri"), "error", "bad_scheme", "spec.checkpoint.s3URI"),
        _rule(_bad_rate("cost_per_hour"), "error", "bad_rate", "spec.resourceHint.costPerHourUSD"),
    ]
    return _report(specs, rules)
