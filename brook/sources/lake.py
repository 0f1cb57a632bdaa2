"""Raw landing zone (CSV) and curated store (Parquet) readers and writers."""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brook.schemas import raw_read_schema


def dated_path(base: str | None, date: str | None = None, override: str | None = None) -> str:
    """``base/YYYY/MM/DD/`` for a logical date; an explicit path wins."""
    if override:
        return override
    if not base:
        raise ValueError("one of an explicit path or a base path is required")
    d = _dt.date.fromisoformat(date) if date else _dt.datetime.now(_dt.timezone.utc).date()
    return f"{base.rstrip('/')}/{d.year:04d}/{d.month:02d}/{d.day:02d}/"


# CSV options used on both sides of the landing zone so that summaries with
# newlines and quotes survive the round trip.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _clustered(df: DataFrame, *cols: str) -> DataFrame:
    """Cluster rows by the output partition columns so each directory gets
    few files, but let AQE split a hot value over several tasks (rebalance)
    instead of sending one whole partition value to one task."""
    return df.hint("rebalance", *cols) if cols else df


# Fixed value: rows of one landing file.  A CSV file whose values hold line ends
# is read by one task, so its size is bounded where it is written.
RAW_ROWS_PER_FILE = 250_000


def write_raw(df: DataFrame, path: str, scrape_date: str, mode: str = "overwrite", rows_per_file: int = RAW_ROWS_PER_FILE) -> None:
    """Landing CSV partitioned by ``scrape_date`` and ``_source``."""
    out = df.withColumn("scrape_date", F.lit(scrape_date))
    (_clustered(out, "scrape_date", "_source").write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file).partitionBy("scrape_date", "_source").options(**CSV_OPTIONS).csv(path))


def raw_scan(spark: SparkSession, path: str) -> DataFrame:
    """Permissive CSV read with corrupt-record capture; partition columns come
    back by discovery; ``_source_path`` is the file each row came from."""
    return (spark.read.schema(raw_read_schema()).options(**CSV_OPTIONS)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .csv(path)
            .withColumn("_source_path", F.col("_metadata.file_path")))


def run_folder(path: str, run: str) -> str:
    """The folder of one run below a store; ``run_date`` is read back as a
    partition column."""
    return f"{path.rstrip('/')}/run_date={run}"


def write_curated(df: DataFrame, path: str, partition_col: str | None = "published_date", *, run: str,
                  fmt: str = "parquet") -> int:
    """Write partitioned Parquet below the folder of ``run`` and return the rows
    written, counted by an Observation on the write itself (no second job).

    A daily feed carries articles of earlier days, so a run owns no date.  It
    owns its own folder: a repeated run replaces what it wrote before, whatever
    the session's overwrite mode, and touches no other run's rows."""
    obs = Observation("rows_written")
    observed = df.observe(obs, F.count(F.lit(1)).alias("n"))
    w = _clustered(observed, partition_col) if partition_col else observed
    writer = w.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_col:
        writer = writer.partitionBy(partition_col)
    writer.format(fmt).save(run_folder(path, run))
    return int(obs.get.get("n", 0))


def quarantine_path(dest: str) -> str:
    return dest.rstrip("/") + "_quarantine/"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_quarantine(bad: DataFrame, dest: str, *, run: str, some: bool | None = None) -> int:
    """Bad rows go to ``<dest>_quarantine/`` below the folder of ``run``,
    partitioned by reject reason.  The folder is only created when there are
    bad rows; a repeated run replaces its own rejects, also by none.  ``some``:
    whether there are any, if the caller has counted them."""
    path = run_folder(quarantine_path(dest), run)
    if bad.isEmpty() if some is None else not some:
        if _exists(bad.sparkSession, path):
            # Nothing is written, the old rows go.
            (bad.write.mode("overwrite").option("partitionOverwriteMode", "static")
                .partitionBy("_reject_reason").parquet(path))
        return 0
    obs = Observation("rows_quarantined")
    observed = bad.observe(obs, F.count(F.lit(1)).alias("n"))
    (_clustered(observed, "_reject_reason").write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy("_reject_reason").parquet(path))
    return int(obs.get.get("n", 0))


# ------------------------------------------------------------- compaction
# Where a curated store keeps its compacted versions and the
# pointers to them.  Spark's readers skip names with an underscore.
COMPACTED = "_compacted"
POINTERS = "_current"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _run_stamps(spark: SparkSession, path: str) -> dict[str, int]:
    """The run folders of a store and when each was last written.  A repeated
    run replaces its folder, and with it the mark of its write."""
    fs, p = _files(spark, path)
    out = {}
    for x in fs.listStatus(p) if fs.exists(p) else []:
        name = x.getPath().getName()
        if x.isDirectory() and name.startswith("run_date="):
            mark = spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")
            out[name.split("=", 1)[1]] = (fs.getFileStatus(mark) if fs.exists(mark) else x).getModificationTime()
    return out


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """The newest pointer: the version that it names, and the runs in it."""
    names = [x for x in _children(spark, f"{path.rstrip('/')}/{POINTERS}") if x.isdigit()]
    if not names:
        return None
    text = spark.read.text(f"{path.rstrip('/')}/{POINTERS}/{names[-1]}").first()[0]
    return {"number": int(names[-1]), **json.loads(text)}


def compact_curated(spark: SparkSession, path: str, partition_col: str = "published_date") -> dict:
    """Rewrite all runs of a curated store into one version with few files a
    date, so that files do not grow with runs x dates.

    The version is written next to the runs, then a pointer with a number of
    its own is created: readers see the old version or the new one, never
    half of one, and a failed compaction leaves nothing that is read.  The run
    of each row stays a column, so a run that is repeated later, or is new, is
    read from its own folder instead.  Run folders are left where they are;
    ``covered`` in the pointer names those that are no longer read."""
    path = path.rstrip("/")
    before = _pointer(spark, path)
    number = before["number"] + 1 if before else 1
    stamps = _run_stamps(spark, path)
    version = f"{path}/{COMPACTED}/{number:09d}"
    rows = curated_scan(spark, path)
    (_clustered(rows, partition_col).write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(partition_col).parquet(version))
    fs, p = _files(spark, f"{path}/{POINTERS}/{number:09d}")
    text = json.dumps({"version": f"{number:09d}", "covered": stamps})
    out = fs.create(p, False)  # fails if another compaction has taken the number
    out.write(bytearray(text.encode()))
    out.close()
    return _pointer(spark, path)


def _read(reader, *paths: str) -> DataFrame:
    try:
        return reader.parquet(*paths)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"no Parquet files under {', '.join(paths)}") from exc


def curated_scan(spark: SparkSession, path: str, required=(), base_path: str | None = None) -> DataFrame:
    """Read every Parquet file under a path or glob; fail when nothing matches
    or a required column is missing.  Of a compacted store: the compacted rows
    of the runs that have not been written again since, and the other runs."""
    reader = spark.read.option("basePath", base_path) if base_path else spark.read
    current = None if base_path or any(c in path for c in "*?[{") else _pointer(spark, path)
    if current is None:
        df = _read(reader, path)
    else:
        root = path.rstrip("/")
        stamps = _run_stamps(spark, root)
        fresh = sorted(r for r, t in stamps.items() if current["covered"].get(r) != t)
        again = [r for r in fresh if r in current["covered"]]
        df = _read(spark.read, f"{root}/{COMPACTED}/{current['version']}")
        if again:
            df = df.filter(~F.coalesce(F.col("run_date").cast("string").isin(again), F.lit(False)))
        if fresh:
            runs = _read(spark.read.option("basePath", root), *[f"{root}/run_date={r}" for r in fresh])
            df = df.unionByName(runs.withColumn("run_date", F.col("run_date").cast(df.schema["run_date"].dataType)), allowMissingColumns=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} missing; found {df.columns}")
    return df


def manifest_scan(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The feed manifest: a JSON array of {url, format, source} per file."""
    from brook.schemas import MANIFEST

    df = spark.read.schema(MANIFEST).option("multiLine", str(multi_line).lower()).json(path)
    if df.isEmpty():
        raise ValueError(f"empty manifest: {path}")
    return df


def _json_array_lines(batches):
    """The lines of one JSON array: an element a line, so no array is ever
    held as a whole."""
    import pandas as pd

    mark = "["
    for pdf in batches:
        if len(pdf):
            lines = "," + pdf["j"]
            lines.iloc[0] = mark + pdf["j"].iloc[0]
            yield pd.DataFrame({"value": lines})
            mark = ","
    if mark == ",":
        yield pd.DataFrame({"value": ["]"]})


def write_manifest(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write {url, format, source} rows as JSON-array files (the manifest
    format), one array per file, one element a line; ``files`` bounds the file
    count."""
    rows = df.select(F.to_json(F.struct("url", "format", "source")).alias("j"))
    if files:
        rows = rows.repartition(files)
    rows.mapInPandas(_json_array_lines, "value string").write.mode("overwrite").text(path)


# ------------------------------------------------------------ payload files
# Fixed value: payload files of one folder.  Spark lists many folders side by
# side, but the files of one folder one after another.
FILES_PER_FOLDER = 1_000


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a qualified path and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def write_payload_files(payloads: DataFrame, path: str, files_per_folder: int = FILES_PER_FOLDER) -> DataFrame:
    """One file per row of ``payloads`` (``format``, ``body``; a line end
    follows the body, none is an empty line) below ``path``; returns the rows
    ``url, format`` of the files, paths as Spark lists them.

    Tasks write their files themselves: a file costs no commit and no rename,
    which the driver would make one after another, and no change of its mode,
    for which local stores start a process.  A task attempt owns its folders,
    and only files of attempts that ended well are returned.  Stores that
    Arrow does not know are written by Spark."""
    spark = payloads.sparkSession
    fs, p = _files(spark, path)
    root = fs.makeQualified(p).toString()
    try:
        _opened(root)
    except (pa.ArrowException, OSError):
        rows = payloads.select("format", "body").write.option("maxRecordsPerFile", 1)
        rows.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("format").text(root)
        return spark.read.format("binaryFile").load(root).select(F.col("path").alias("url"), F.col("format").cast("string").alias("format"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(root)
        context, n = TaskContext.get(), 0
        for b in batches:
            urls = []
            for body in b.column("body"):
                folder = f"part=p{context.partitionId()}_{context.taskAttemptId()}_{n // files_per_folder}"
                if n % files_per_folder == 0:
                    store.create_dir(f"{top}/{folder}")
                with store.open_output_stream(f"{top}/{folder}/{n:09d}.txt") as out:
                    if body.is_valid:
                        out.write(body.as_buffer())
                    out.write(b"\n")
                urls.append(f"{root}/{folder}/{n:09d}.txt")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), b.column("format")], ["url", "format"])

    listed = f"{path.rstrip('/')}-listed"
    payloads.select("format", "body").mapInArrow(run, "url string, format string").write.parquet(listed)
    return spark.read.schema("url string, format string").parquet(listed)
