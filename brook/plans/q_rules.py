"""Rule reports over job specs (orders) and training specs (part)."""

from __future__ import annotations

from brook.operators import rules as R
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views
from brook.plans.q_schedule import DOW_NAMES, FIELDS, MONTH_NAMES, _duck_field, _duck_names


def _duck_cron_ok(col: str) -> str:
    parts = f"regexp_split_to_array(trim({col}), '\\s+')"
    checks = [f"len({parts}) = 5"]
    for i, (name, lo, hi) in enumerate(FIELDS):
        raw = f"{parts}[{i + 1}]"
        if name == "month":
            raw = _duck_names(raw, MONTH_NAMES, 1)
        elif name == "dow":
            raw = _duck_names(raw, DOW_NAMES, 0)
        checks.append(f"list_bool_and(list_transform({_duck_field(raw, lo, hi)}, lambda p: coalesce(p.ok AND p.a >= {lo} "
                      f"AND p.b <= {hi} AND p.a <= p.b AND p.step > 0, false)))")
    return "coalesce(" + " AND ".join(checks) + ", false)"


# Where each field of a spec stands in the views, by hand.
_VALUE = {"mainApplicationFile": "main_file", "mainClass": "main_class", "executors": "executors", "minExecutors": "min_executors",
          "maxExecutors": "max_executors", "spot.maxRetries": "max_retries", "checkpoint.s3URI": "checkpoint_uri",
          "resourceHint.costPerHourUSD": "cost_per_hour", "executorResources.requests.cpu": "exec_cpu", "schedule": "schedule",
          "concurrencyPolicy": "concurrency_policy", "startingDeadlineSeconds": "starting_deadline_s",
          "successfulJobsHistoryLimit": "keep_succeeded", "failedJobsHistoryLimit": "keep_failed", "timeZone": "time_zone",
          "image": "image", "worldSize": "world_size", "datasetS3URI": "dataset_s3_uri", "command": "array_to_string(command, ' ')",
          "builtinTrainer": "builtin_trainer", "packages": "array_to_string(packages, ' ')", "gpu.perWorker": "gpu_per_worker",
          "gpu.backend": "gpu_backend"}


def _u(cond: str, sev: str, rule: str, field: str, src: str = "s") -> str:
    value = _VALUE[field.removeprefix("spec.")]
    return (f"SELECT namespace, name, '{sev}' AS severity, '{rule}' AS rule, '{field}' AS field, CAST({value} AS VARCHAR) AS value "
            f"FROM {src} WHERE coalesce({cond}, false)")


def _bad_scheme(c: str) -> str:
    return f"(coalesce({c}, '') <> '' AND NOT (starts_with({c}, 's3://') OR starts_with({c}, 's3a://')))"


def _bad_rate(c: str) -> str:
    return f"(coalesce({c}, '') <> '' AND (TRY_CAST({c} AS DOUBLE) IS NULL OR TRY_CAST({c} AS DOUBLE) < 0))"


_HAS = "coalesce(schedule, '') <> ''"
_SPEC_RULES = [
    _u("trim(coalesce(main_file, '')) = ''", "error", "main_file_required", "spec.mainApplicationFile"),
    _u("type = 'Scala' AND trim(coalesce(main_class, '')) = ''", "warning", "scala_without_main_class", "spec.mainClass"),
    _u("type = 'Python' AND trim(coalesce(main_class, '')) <> ''", "warning", "python_with_main_class", "spec.mainClass"),
    _u("executors < 0", "error", "negative", "spec.executors"),
    _u("min_executors < 0", "error", "negative", "spec.minExecutors"),
    _u("max_executors < 0", "error", "negative", "spec.maxExecutors"),
    _u("min_executors > 0 AND max_executors > 0 AND min_executors > max_executors", "error", "min_above_max",
       "spec.minExecutors"),
    _u("executors > 0 AND (min_executors > 0 OR max_executors > 0)", "warning", "executors_with_bounds", "spec.executors"),
    _u("max_retries < 0", "error", "negative", "spec.spot.maxRetries"),
    _u("checkpoint_enabled AND trim(coalesce(checkpoint_uri, '')) = ''", "error", "required", "spec.checkpoint.s3URI"),
    _u(_bad_scheme("checkpoint_uri"), "error", "bad_scheme", "spec.checkpoint.s3URI"),
    _u(_bad_rate("cost_per_hour"), "error", "bad_rate", "spec.resourceHint.costPerHourUSD"),
    # Of the views' requests only '0' is not positive.
    _u("exec_cpu = '0'", "error", "cpu_not_positive",
       "spec.executorResources.requests.cpu"),
    _u(f"{_HAS} AND NOT {_duck_cron_ok('schedule')}", "error", "bad_cron", "spec.schedule"),
    _u(f"{_HAS} AND coalesce(concurrency_policy, '') NOT IN ('', 'Allow', 'Forbid', 'Replace')", "error", "bad_policy",
       "spec.concurrencyPolicy"),
    _u(f"{_HAS} AND starting_deadline_s < 0", "error", "negative", "spec.startingDeadlineSeconds"),
    _u(f"{_HAS} AND keep_succeeded < 0", "error", "negative", "spec.successfulJobsHistoryLimit"),
    _u(f"{_HAS} AND keep_failed < 0", "error", "negative", "spec.failedJobsHistoryLimit"),
    _u(f"NOT ({_HAS}) AND (coalesce(concurrency_policy, '') <> '' OR suspend IS NOT NULL OR time_zone IS NOT NULL "
       "OR starting_deadline_s IS NOT NULL OR keep_succeeded IS NOT NULL OR keep_failed IS NOT NULL)",
       "warning", "schedule_fields_without_schedule", "spec.schedule"),
    _u("coalesce(time_zone, '') <> '' AND time_zone NOT IN (SELECT name FROM pg_timezone_names())", "error", "bad_zone",
       "spec.timeZone"),
    "SELECT namespace, name, 'warning', 'conf_key_prefix', 'spec.sparkConf[' || e.key || ']', e.value FROM "
    "(SELECT namespace, name, unnest(map_entries(spark_conf)) AS e FROM s) WHERE NOT starts_with(e.key, 'spark.')",
]


@register("spec_report", with_views("SELECT * FROM (" + "\nUNION ALL\n".join(_SPEC_RULES) + ")",
                                    "job_runs", "job_specs").replace("job_specs AS (", "s AS (", 1))
def spec_report(spark, sf):
    return R.spec_report(V.job_specs(spark, sf))


_TRAIN_RULES = [
    _u("trim(coalesce(image, '')) = ''", "error", "required", "spec.image"),
    _u("world_size < 1", "error", "world_size_below_one", "spec.worldSize"),
    _u("coalesce(dataset_pvc, '') <> '' AND coalesce(dataset_s3_uri, '') <> ''", "error", "two_dataset_sources",
       "spec.datasetS3URI"),
    _u(_bad_scheme("dataset_s3_uri"), "error", "bad_scheme", "spec.datasetS3URI"),
    _u("trim(coalesce(script, '')) <> '' AND len(command) > 0", "warning", "script_with_command", "spec.command"),
    _u("trim(coalesce(script, '')) <> '' AND coalesce(builtin_trainer, '') <> ''", "warning", "script_with_builtin",
       "spec.builtinTrainer"),
    _u("coalesce(builtin_trainer, '') <> '' AND builtin_trainer NOT IN ('BERTClassifier')", "error", "unknown_builtin",
       "spec.builtinTrainer"),
    _u("len(packages) > 0 AND len(command) > 0", "warning", "packages_with_command", "spec.packages"),
    _u("gpu_enabled AND gpu_per_worker < 1", "error", "gpu_per_worker_below_one", "spec.gpu.perWorker"),
    _u("gpu_enabled AND gpu_backend = 'gloo'", "warning", "gpu_with_gloo", "spec.gpu.backend"),
    _u("NOT gpu_enabled AND gpu_backend = 'nccl'", "warning", "nccl_without_gpu", "spec.gpu.backend"),
    _u("NOT gpu_enabled AND gpu_per_worker > 1", "warning", "per_worker_without_gpu", "spec.gpu.perWorker"),
    _u("max_retries < 0", "error", "negative", "spec.spot.maxRetries"),
    _u("checkpoint_enabled AND trim(coalesce(checkpoint_uri, '')) = ''", "error", "required", "spec.checkpoint.s3URI"),
    _u(_bad_scheme("checkpoint_uri"), "error", "bad_scheme", "spec.checkpoint.s3URI"),
    _u(_bad_rate("cost_per_hour"), "error", "bad_rate", "spec.resourceHint.costPerHourUSD"),
]


@register("training_spec_report", with_views("SELECT * FROM (" + "\nUNION ALL\n".join(_TRAIN_RULES) + ")",
                                             "training_specs").replace("training_specs AS (", "s AS (", 1))
def training_spec_report(spark, sf):
    return R.training_spec_report(V.training_specs(spark, sf))
