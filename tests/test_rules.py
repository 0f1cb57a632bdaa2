import pytest

from brook.operators import rules as R

JOB = dict(namespace="ns", name="j", main_file="local:///app.py", type="Python", main_class="", executors=0, min_executors=1,
           max_executors=4, max_retries=1, checkpoint_enabled=False, checkpoint_uri="", cost_per_hour="0.08",
           exec_cpu="500m", spark_conf={"spark.a": "1"}, schedule=None, concurrency_policy=None,
           starting_deadline_s=None, keep_succeeded=None, keep_failed=None, suspend=None, time_zone=None)
JOB_SCHEMA = ("namespace string, name string, main_file string, type string, main_class string, executors int, min_executors int, "
              "max_executors int, max_retries int, checkpoint_enabled boolean, checkpoint_uri string, "
              "cost_per_hour string, exec_cpu string, spark_conf map<string,string>, schedule string, "
              "concurrency_policy string, starting_deadline_s long, keep_succeeded int, keep_failed int, "
              "suspend boolean, time_zone string")

JOB_CASES = [
    ({}, set()),
    ({"main_file": "  "}, {("error", "main_file_required")}),
    ({"type": "Scala"}, {("warning", "scala_without_main_class")}),
    ({"main_class": "x.Main"}, {("warning", "python_with_main_class")}),
    ({"executors": -1}, {("error", "negative")}),
    ({"min_executors": 5}, {("error", "min_above_max")}),
    ({"executors": 3}, {("warning", "executors_with_bounds")}),
    ({"max_retries": -1}, {("error", "negative")}),
    ({"checkpoint_enabled": True}, {("error", "required")}),
    ({"checkpoint_uri": "gs://x"}, {("error", "bad_scheme")}),
    ({"checkpoint_enabled": True, "checkpoint_uri": "s3a://x"}, set()),
    ({"cost_per_hour": "-1"}, {("error", "bad_rate")}),
    ({"cost_per_hour": "abc"}, {("error", "bad_rate")}),
    ({"cost_per_hour": "0"}, set()),
    ({"exec_cpu": "0"}, {("error", "cpu_not_positive")}),
    ({"spark_conf": {"foo": "1"}}, {("warning", "conf_key_prefix")}),
    ({"schedule": "*/5 * * * *"}, set()),
    ({"schedule": "not a cron"}, {("error", "bad_cron")}),
    ({"schedule": "* * * * *", "concurrency_policy": "Sometimes"}, {("error", "bad_policy")}),
    ({"schedule": "* * * * *", "starting_deadline_s": -1}, {("error", "negative")}),
    ({"schedule": "* * * * *", "keep_failed": -1}, {("error", "negative")}),
    ({"suspend": True}, {("warning", "schedule_fields_without_schedule")}),
    ({"schedule": "* * * * *", "time_zone": "Nowhere/City"}, {("error", "bad_zone")}),
]


def reported(spark, base, schema, cases, report):
    """What the report says of each case, all of them in one table."""
    rows = [{**base, **change, "name": str(i)} for i, (change, _) in enumerate(cases)]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    found = {str(i): set() for i in range(len(cases))}
    for r in report(df).collect():
        found[r.name].add((r.severity, r.rule))
    return found


@pytest.fixture(scope="module")
def job_reports(spark):
    return reported(spark, JOB, JOB_SCHEMA, JOB_CASES, R.spec_report)


@pytest.mark.parametrize("case", range(len(JOB_CASES)))
def test_job_rules(job_reports, case):
    assert job_reports[str(case)] == JOB_CASES[case][1]


TRAIN = dict(namespace="ns", name="t", image="img", world_size=2, dataset_pvc="", dataset_s3_uri="", script="train.py", command=[],
             packages=[], builtin_trainer="", gpu_enabled=False, gpu_per_worker=0, gpu_backend="gloo", max_retries=1,
             checkpoint_enabled=False, checkpoint_uri="", cost_per_hour="")
TRAIN_SCHEMA = ("namespace string, name string, image string, world_size int, dataset_pvc string, dataset_s3_uri string, script string, "
                "command array<string>, packages array<string>, builtin_trainer string, gpu_enabled boolean, "
                "gpu_per_worker int, gpu_backend string, max_retries int, checkpoint_enabled boolean, "
                "checkpoint_uri string, cost_per_hour string")
TRAIN_CASES = [
    ({}, set()),
    ({"image": " "}, {("error", "required")}),
    ({"world_size": 0}, {("error", "world_size_below_one")}),
    ({"dataset_pvc": "p", "dataset_s3_uri": "s3://d"}, {("error", "two_dataset_sources")}),
    ({"dataset_s3_uri": "gs://d"}, {("error", "bad_scheme")}),
    ({"command": ["python"]}, {("warning", "script_with_command")}),
    ({"builtin_trainer": "BERTClassifier"}, {("warning", "script_with_builtin")}),
    ({"script": "", "builtin_trainer": "GPT"}, {("error", "unknown_builtin")}),
    ({"script": "", "packages": ["x"], "command": ["sh"]}, {("warning", "packages_with_command")}),
    ({"gpu_enabled": True, "gpu_backend": "nccl"}, {("error", "gpu_per_worker_below_one")}),
    ({"gpu_enabled": True, "gpu_per_worker": 1}, {("warning", "gpu_with_gloo")}),
    ({"gpu_backend": "nccl"}, {("warning", "nccl_without_gpu")}),
    ({"gpu_per_worker": 2}, {("warning", "per_worker_without_gpu")}),
    ({"max_retries": -1}, {("error", "negative")}),
    ({"checkpoint_enabled": True}, {("error", "required")}),
    ({"cost_per_hour": "x"}, {("error", "bad_rate")}),
]


@pytest.fixture(scope="module")
def training_reports(spark):
    return reported(spark, TRAIN, TRAIN_SCHEMA, TRAIN_CASES, R.training_spec_report)


@pytest.mark.parametrize("case", range(len(TRAIN_CASES)))
def test_training_rules(training_reports, case):
    assert training_reports[str(case)] == TRAIN_CASES[case][1]


def test_reports_name_the_value(spark):
    rows = [{**JOB, "name": "a", "executors": -2}, {**JOB, "name": "b", "schedule": "* * *"}, {**JOB, "name": "c", "spark_conf": {"x": "7"}},
            {**JOB, "name": "d", "main_file": None}, {**JOB, "namespace": "other", "name": "a"}]
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in JOB_SCHEMA.split(", ")) for r in rows], JOB_SCHEMA)
    assert {(r.namespace, r.name, r.field, r.value) for r in R.spec_report(df).collect() if r.rule != "executors_with_bounds"} == {
        ("ns", "a", "spec.executors", "-2"), ("ns", "b", "spec.schedule", "* * *"), ("ns", "c", "spec.sparkConf[x]", "7"),
        ("ns", "d", "spec.mainApplicationFile", None)}
    t = {**TRAIN, "command": ["python", "x.py"]}
    df = spark.createDataFrame([tuple(t[c.split()[0]] for c in TRAIN_SCHEMA.split(", "))], TRAIN_SCHEMA)
    assert [(r.field, r.value) for r in R.training_spec_report(df).collect()] == [("spec.command", "python x.py")]
