"""The views of ``views.py`` written as DuckDB SQL (used only by the oracle).

Each entry is the body of a CTE over the driver's pre-registered tables.
"""

from __future__ import annotations

from brook.plans.views import CRON_SAMPLES, ZONE_SAMPLES


def _day(key: str) -> str:
    return f"(DATE '2024-01-01' + CAST({key} % 400 AS INTEGER))"


def _forms(day: str, key: str, junk: str) -> str:
    hh = f"lpad(CAST({key} % 24 AS VARCHAR), 2, '0')"
    return f"""CASE {key} % 6
      WHEN 0 THEN strftime({day}, '%Y-%m-%d')
      WHEN 1 THEN strftime({day}, '%Y-%m-%d') || 'T' || {hh} || ':15:00Z'
      WHEN 2 THEN strftime({day}, '%Y-%m-%d') || 'T' || {hh} || ':30:00+02:00'
      WHEN 3 THEN strftime({day}, '%a, %d %b %Y') || ' ' || {hh} || ':45:00' ||
        CASE {key} % 36 WHEN 9 THEN ' EST' WHEN 15 THEN ' PDT' ELSE ' +0000' END
      WHEN 4 THEN strftime({day}, '%Y')
      ELSE {junk} END"""


def _true_date(day: str, key: str) -> str:
    return f"""CASE WHEN {key} % 6 = 5 THEN NULL
      WHEN {key} % 6 = 4 THEN CAST(date_trunc('year', {day}) AS DATE)
      WHEN {key} % 36 = 9 AND {key} % 24 >= 19 OR {key} % 36 = 15 AND {key} % 24 >= 17 THEN CAST({day} + INTERVAL 1 DAY AS DATE)
      ELSE CAST({day} AS DATE) END"""


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {}

VIEWS["articles"] = f"""
  SELECT CAST(doc_id AS VARCHAR) AS id,
    '  ' || upper(source) AS source,
    CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS title,
    ' https://news.example.com/' || lang || '/' || CAST(doc_id AS VARCHAR) || ' ' AS link,
    {_forms(_day('doc_id'), 'doc_id', "'n/a ' || CAST(doc_id AS VARCHAR)")} AS published_at,
    '<p>' || text || '</p>' AS summary,
    ' ' || upper(lang) AS category,
    doc_id,
    {_true_date(_day('doc_id'), 'doc_id')} AS true_date
  FROM documents"""

VIEWS["dated_strings"] = f"""
  SELECT o_orderkey AS key,
    {_forms('CAST(o_orderdate AS DATE)', 'o_orderkey',
            "CASE WHEN o_orderkey % 12 = 5 THEN 'junk ' || CAST(o_orderkey AS VARCHAR) "
            "ELSE strftime(CAST(o_orderdate AS DATE), '%Y%m%d') END")} AS value,
    {_true_date('CAST(o_orderdate AS DATE)', 'o_orderkey')} AS true_date
  FROM orders"""

VIEWS["job_runs"] = """
  SELECT 'team-' || CAST(o_orderkey % 3 AS VARCHAR) AS namespace,
    'job-' || CAST(o_orderkey // 3 AS VARCHAR) AS name,
    'tmpl-' || CAST(o_custkey // 3 AS VARCHAR) AS template,
    CAST(o_orderdate AS TIMESTAMP) AS created,
    CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Running' WHEN 'P' THEN 'Succeeded' END AS phase,
    CASE WHEN o_orderkey % 2 = 0 THEN 'Python' ELSE 'Scala' END AS type,
    CASE WHEN o_orderkey % 53 = 0 THEN '  ' ELSE 'local:///opt/app/job-' || CAST(o_custkey AS VARCHAR) || '.py' END AS main_file,
    CASE WHEN o_orderkey % 7 = 0 THEN 'org.example.Main' ELSE '' END AS main_class,
    CAST(CASE WHEN o_orderkey % 97 = 0 THEN -1 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END AS INTEGER) AS executors,
    CAST(CASE WHEN o_orderkey % 89 = 0 THEN 9 ELSE o_custkey % 3 END AS INTEGER) AS min_executors,
    CAST((o_custkey % 4) * 4 AS INTEGER) AS max_executors,
    CAST(trunc(o_totalprice / 50) AS BIGINT) AS input_size_mb,
    CASE o_orderpriority WHEN '1-URGENT' THEN '0.50' WHEN '2-HIGH' THEN '0.25' WHEN '3-MEDIUM' THEN '0'
      WHEN '4-NOT SPECIFIED' THEN '' ELSE 'n/a' END AS cost_per_hour,
    CAST(CASE WHEN o_orderkey % 101 = 0 THEN -1 ELSE o_orderkey % 3 END AS INTEGER) AS max_retries,
    CAST(o_orderkey % 4 AS INTEGER) AS retries,
    (['500m', '2', '1500m', '0'])[CAST(o_orderkey % 4 + 1 AS INTEGER)] AS exec_cpu,
    (['512Mi', '2Gi', '1536Mi', '1G'])[CAST(o_custkey % 4 + 1 AS INTEGER)] AS exec_memory,
    CASE WHEN o_orderkey % 11 <> 0 THEN (['250m', '1e0', '2500m', '1.5', '25e-1'])[CAST(o_orderkey % 5 + 1 AS INTEGER)] END AS driver_cpu,
    (['1Gi', '1.5Gi', '2e9', '1Ei', '4096Mi', '3E9', '1048576Ki'])[CAST(o_orderkey % 7 + 1 AS INTEGER)] AS driver_memory,
    (o_orderkey % 13 = 0) AS checkpoint_enabled,
    CASE WHEN o_orderkey % 26 = 0 THEN 's3a://ckpt/job-' || CAST(o_orderkey AS VARCHAR)
      WHEN o_orderkey % 39 = 0 THEN 'gs://ckpt/job-' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS checkpoint_uri,
    CASE WHEN o_orderkey % 3 = 0 THEN MAP {'spark.sql.shuffle.partitions': '64'}
      WHEN o_orderkey % 3 = 1 THEN MAP {'spark.executor.memoryOverhead': '1g', 'executor.cores': '2'}
      ELSE MAP {} END AS spark_conf,
    CASE WHEN o_orderkey % 17 = 0 THEN 'Forbid' END AS concurrency_policy,
    CASE WHEN o_orderkey % 8 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 120 AS BIGINT)) END AS start_time,
    CASE WHEN o_orderstatus IN ('F', 'P') THEN CAST(o_orderdate AS TIMESTAMP)
      + to_minutes(CAST(o_orderkey % 120 AS BIGINT))
      + to_minutes(CAST(CAST(trunc(o_totalprice) AS BIGINT) % 600 AS BIGINT)) END AS completion_time
  FROM orders"""

VIEWS["pods"] = """
  SELECT 'team-' || CAST(l_orderkey % 3 AS VARCHAR) AS namespace,
    'pod-' || CAST(l_orderkey // 3 AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name,
    'uid-pod-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS uid,
    'job-' || CAST(l_orderkey // 3 AS VARCHAR) AS run,
    CAST(l_linenumber - 1 AS INTEGER) AS rank,
    CASE WHEN l_linenumber = 1 THEN 'driver' ELSE 'executor' END AS role,
    CASE WHEN l_linenumber = 1 THEN []
      WHEN l_suppkey % 7 = 0 THEN ['uid-pod-' || CAST(l_orderkey AS VARCHAR) || '-1', 'uid-pod-' || CAST(l_orderkey AS VARCHAR) || '-1']
      ELSE ['uid-pod-' || CAST(l_orderkey AS VARCHAR) || '-1'] END AS owner_uids,
    CASE WHEN l_linestatus = 'O' AND l_quantity < 10 THEN 'Pending'
      WHEN l_linestatus = 'O' THEN 'Running'
      WHEN l_returnflag = 'R' THEN 'Failed' ELSE 'Succeeded' END AS phase,
    (l_discount >= 0.03) AS ready,
    CAST(l_shipdate AS TIMESTAMP) AS ts
  FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC,
               l_quantity DESC, l_discount DESC, l_returnflag DESC, l_linestatus DESC) AS rn_
    FROM lineitem) WHERE rn_ = 1"""

VIEWS["training_runs"] = """
  SELECT 'team-' || CAST(o_orderkey % 3 AS VARCHAR) AS namespace,
    'job-' || CAST(o_orderkey // 3 AS VARCHAR) AS name,
    CAST(o_orderkey % 4 + 1 AS INTEGER) AS world_size,
    CAST(o_orderkey % 3 AS INTEGER) AS max_retries,
    CAST(o_orderkey % 2 AS INTEGER) AS resumes,
    CASE WHEN o_orderkey % 5 = 0 THEN '1.25' WHEN o_orderkey % 5 = 1 THEN '' ELSE '0.40' END AS cost_per_hour,
    CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 90 AS BIGINT)) END
      AS start_time,
    CASE WHEN o_orderkey % 6 <> 0 AND o_orderstatus IN ('F', 'P') THEN CAST(o_orderdate AS TIMESTAMP)
      + to_minutes(CAST(o_orderkey % 90 AS BIGINT)) + to_minutes(CAST(trunc(o_totalprice) AS BIGINT) % 300) END
      AS completion_time,
    CASE WHEN o_orderkey % 9 = 0 THEN 's3a://ck/' || CAST(o_orderkey AS VARCHAR) || '/step-' || CAST(o_orderkey % 5 AS VARCHAR) END
      AS last_checkpoint
  FROM orders WHERE o_orderkey % 7 <> 5"""

VIEWS["status_history"] = """
  SELECT event_id, user_id, 'team-' || CAST(user_id % 3 AS VARCHAR) AS namespace, 'run-' || CAST(user_id // 3 AS VARCHAR) AS run, CAST(ts AS TIMESTAMP) AS ts,
    CASE event_type WHEN 'view' THEN 'Pending' WHEN 'click' THEN 'Running' WHEN 'signup' THEN 'Resuming'
      WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' END AS phase,
    CAST(trunc(value / 10) AS INTEGER) AS running,
    4 AS desired,
    'drv-' || CAST(user_id AS VARCHAR) AS driver_pod,
    CAST(event_id % 3 AS INTEGER) AS retries,
    printf('%.2f', value) AS cost,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS result,
    value
  FROM events"""

VIEWS["dependency_refs"] = """
  SELECT 'team-' || CAST(o_orderkey % 3 AS VARCHAR) AS namespace, 'job-' || CAST(o_orderkey // 3 AS VARCHAR) AS run,
    0 AS pos, 'Secret' AS kind, 'cred-' || CAST(o_custkey AS VARCHAR) AS ref_name, (o_orderkey % 4 = 0) AS optional
  FROM orders
  UNION ALL
  SELECT 'team-' || CAST(o_orderkey % 3 AS VARCHAR), 'job-' || CAST(o_orderkey // 3 AS VARCHAR),
    1, 'ConfigMap', 'conf-' || CAST(o_custkey + 7 AS VARCHAR), false
  FROM orders"""

VIEWS["live_objects"] = """
  SELECT 'team-' || CAST(c_custkey % 3 AS VARCHAR) AS namespace, 'Secret' AS kind,
    'cred-' || CAST(c_custkey AS VARCHAR) AS obj_name
  FROM customer WHERE c_acctbal > 0
  UNION ALL
  SELECT 'team-' || CAST((c_custkey - 7) % 3 AS VARCHAR), 'ConfigMap', 'conf-' || CAST(c_custkey AS VARCHAR)
  FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 0"""

VIEWS["config_layers"] = """
  SELECT 'team-' || CAST(l_orderkey % 3 AS VARCHAR) AS namespace, 'job-' || CAST(l_orderkey // 3 AS VARCHAR) AS run,
    CAST(l_linenumber % 3 AS INTEGER) AS layer,
    (['spark.executor.cores', 'spark.executor.memory', 'spark.sql.shuffle.partitions',
      'spark.dynamicAllocation.enabled'])[CAST(p_size % 4 + 1 AS INTEGER)] AS key,
    CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) || '-' || p_brand AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["cron_templates"] = f"""
  SELECT 'team-' || CAST(c_custkey % 3 AS VARCHAR) AS namespace,
    'tmpl-' || CAST(c_custkey // 3 AS VARCHAR) AS template,
    ({_list(CRON_SAMPLES)})[CAST(c_custkey % {len(CRON_SAMPLES)} + 1 AS INTEGER)] AS schedule,
    nullif(({_list(ZONE_SAMPLES)})[CAST(c_custkey % {len(ZONE_SAMPLES)} + 1 AS INTEGER)], '') AS time_zone,
    (c_custkey % 11 = 0) AS suspend,
    (['Allow', '', 'Replace', 'Forbid'])[CAST(c_custkey % 4 + 1 AS INTEGER)] AS concurrency_policy,
    CASE WHEN c_custkey % 4 = 0 THEN CAST(3600 AS BIGINT) END AS starting_deadline_s,
    CASE WHEN c_custkey % 6 = 0 THEN 1 END AS keep_succeeded,
    CASE WHEN c_custkey % 10 = 0 THEN 0 END AS keep_failed,
    TIMESTAMP '2024-03-01 00:00:00' - to_hours(CAST(CASE WHEN c_custkey % 7 = 0 THEN 19200 ELSE 0 END + c_custkey % 48 AS BIGINT))
      AS created,
    CASE WHEN c_custkey % 13 = 0 THEN TIMESTAMP '2024-03-07 06:00:00' END AS last_schedule_time
  FROM customer"""


VIEWS["job_specs"] = f"""
  SELECT * REPLACE (CASE WHEN CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 170 = 10 THEN 'Sometimes'
                         ELSE concurrency_policy END AS concurrency_policy),
    CASE WHEN k % 10 = 0 THEN ({_list(CRON_SAMPLES)})[CAST((k // 10) % {len(CRON_SAMPLES)} + 1 AS INTEGER)]
         WHEN k % 43 = 2 THEN '  ' END AS schedule,
    CASE WHEN k % 10 = 0 THEN nullif(({_list(ZONE_SAMPLES)})[CAST((k // 10) % {len(ZONE_SAMPLES)} + 1 AS INTEGER)], '')
         WHEN k % 41 = 1 THEN 'UTC' END AS time_zone,
    CAST(CASE WHEN k % 19 = 0 THEN -5 WHEN k % 19 = 1 THEN 60 END AS BIGINT) AS starting_deadline_s,
    CASE WHEN k % 23 = 0 THEN -1 END AS keep_succeeded,
    CASE WHEN k % 29 = 0 THEN 2 END AS keep_failed,
    CASE WHEN k % 31 = 0 THEN true END AS suspend
  FROM (SELECT *, CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) AS k FROM job_runs)"""

VIEWS["training_specs"] = """
  SELECT 'team-' || CAST(p_partkey % 3 AS VARCHAR) AS namespace, 'train-' || CAST(p_partkey // 3 AS VARCHAR) AS name,
    CASE WHEN p_partkey % 41 = 0 THEN ' ' ELSE 'registry.example/trainer:' || p_brand END AS image,
    CAST(CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE p_size % 4 + 1 END AS INTEGER) AS world_size,
    CASE WHEN p_partkey % 3 = 0 THEN 'pvc-' || CAST(p_partkey AS VARCHAR) ELSE '' END AS dataset_pvc,
    CASE WHEN p_partkey % 5 = 0 THEN 's3a://data/' || CAST(p_partkey AS VARCHAR)
         WHEN p_partkey % 7 = 0 THEN 'gs://data/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS dataset_s3_uri,
    CASE WHEN p_partkey % 2 = 0 THEN 'train.py' ELSE '' END AS script,
    CASE WHEN p_partkey % 11 = 0 THEN ['python', 'x.py'] ELSE [] END AS command,
    CASE WHEN p_partkey % 13 = 0 THEN ['numpy'] ELSE [] END AS packages,
    CASE WHEN p_partkey % 17 = 0 THEN 'BERTClassifier' WHEN p_partkey % 19 = 0 THEN 'GPT' ELSE '' END AS builtin_trainer,
    (p_partkey % 4 = 0) AS gpu_enabled,
    CAST(p_size % 3 AS INTEGER) AS gpu_per_worker,
    (['nccl', 'gloo', ''])[CAST(p_partkey % 3 + 1 AS INTEGER)] AS gpu_backend,
    CAST(CASE WHEN p_partkey % 43 = 0 THEN -1 ELSE 2 END AS INTEGER) AS max_retries,
    (p_partkey % 47 = 0) AS checkpoint_enabled,
    CASE WHEN p_partkey % 94 = 0 THEN 's3://ck/' WHEN p_partkey % 47 = 0 THEN '' WHEN p_partkey % 61 = 0 THEN 'hdfs://ck/'
         ELSE '' END AS checkpoint_uri,
    CASE WHEN p_partkey % 53 = 0 THEN '-1' WHEN p_partkey % 59 = 0 THEN 'abc' ELSE '0.40' END AS cost_per_hour
  FROM part"""


def with_views(sql: str, *names: str) -> str:
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{sql}"
