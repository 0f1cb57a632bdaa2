"""Session construction and the few session facts the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every brook job expects.  UTC matters for correctness: dates are
# derived from instants (RFC-822 offsets, cost hours), so the session zone is
# part of the semantics, not a preference.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Payload bodies vary from bytes to tens of MB: bound each Arrow batch
    # handed to the Python helpers by bytes, not only by record count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # AQE coalesces shuffle output towards this size and splits partitions
    # above skewedPartitionThresholdInBytes; 256 MB keeps tasks spill-light.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.ui.enabled": "false",
}

# Fixed value: target bytes of shuffle input per task at scale.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def scale_conf(input_bytes: int, min_partitions: int = 200) -> dict:
    """Settings for a run over ``input_bytes`` of input: an initial shuffle
    partition count of about one per 256 MB (AQE coalesces the small ones),
    so a 100 TB input starts with ~400k partitions instead of 200."""
    n = max(min_partitions, -(-int(input_bytes) // TARGET_PARTITION_BYTES))
    return {"spark.sql.shuffle.partitions": str(n),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n)}


def build_session(master: str | None = None, app: str = "brook",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with brook's base settings.

    On a cluster ``master`` stays None so spark-submit decides; tests pass
    ``local[N]``.  ``shuffle_partitions`` should follow the data size: about
    one partition per 128-256 MB of shuffle input at the target scale.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``brook`` importable on the executors (the Python helpers run
    there): zip the package once per application and add it with
    ``addPyFile``, as ``--py-files`` would."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if "brook" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(sc.applicationId)  # already shipped by spark-submit --py-files
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="brook-pkg-"), "brook.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def ensure_utc(spark: SparkSession) -> None:
    """brook's date semantics are defined in UTC; pin the session zone."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and scratch tables.

    A cluster names it in ``spark.checkpoint.dir`` (a shared file system or
    object store); we only read it.  Unset, it is an error on a cluster; in
    local mode, as in tests, a fresh local folder is registered.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="brook-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint dir for a written scratch table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/brook-scratch/{name}-{uuid.uuid4().hex[:12]}"


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.sparkContext.defaultParallelism or os.cpu_count() or 8)
