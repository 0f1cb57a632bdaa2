"""Streaming operators.  Each takes or returns streaming DataFrames; the
``run_*`` helpers start a query with ``trigger(availableNow=True)``, wait for
it, and leave the result in a Parquet folder (never a driver-side sink)."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from brook.operators import clean as C
from brook.operators.fleet import RUN_OF
from brook.schemas import raw_read_schema
from brook.sources import lake as L

# Fixed value: default watermark delay for late rows.
DEFAULT_DELAY = "10 minutes"


def _available_now(writer, checkpoint: str):
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def await_all(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


# ------------------------------------------------------------ ELT stream
def read_raw_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(raw_read_schema()).options(**L.CSV_OPTIONS)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record"))
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.csv(path).withColumn("_source_path", F.col("_metadata.file_path"))


def stream_elt(spark: SparkSession, raw_path: str, dest: str, checkpoint: str,
               partition_col: str = "published_date", max_files: int | None = None):
    """Clean each micro-batch of newly landed raw files: good rows to
    ``dest``, rejects to ``<dest>_quarantine``.  One micro-batch is cleaned
    once (persisted) for both outputs.

    ``foreachBatch`` runs a batch again after a failure, so each epoch
    overwrites only its own folder ``<dest>/_query=<id>/_batch=<epoch>/``
    (partitioned by ``partition_col`` inside): a replay replaces what the epoch
    wrote before instead of appending twice, with no partition renames.  The id
    is the one that the query keeps in its checkpoint, so epochs of another
    checkpoint, which count from 0 again, never replace earlier ones.  Readers
    of ``dest`` see ``_query`` and ``_batch`` as two more partition columns."""
    def write(frame: DataFrame, path: str, part: str, epoch: int) -> None:
        (frame.hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "static")
              .partitionBy(part).parquet(f"{path.rstrip('/')}/_query={query_id()}/_batch={epoch}"))

    def query_id() -> str:
        # Written by Spark before the first batch: one line of JSON.
        return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]

    def batch(df: DataFrame, epoch: int) -> None:
        cleaned = C.clean(df).persist()
        try:
            good, bad = C.split(cleaned)
            write(good, dest, partition_col, epoch)
            write(bad, L.quarantine_path(dest), "_reject_reason", epoch)
        finally:
            cleaned.unpersist()

    q = _available_now(read_raw_stream(spark, raw_path, max_files).writeStream.foreachBatch(batch), checkpoint)
    return q.start()


# ------------------------------------------------------------ dedup
def stream_dedup(df: DataFrame, keys, ts_col: str, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Drop articles repeated across runs: a key seen again within the
    watermark delay is dropped; state for a key expires with the watermark."""
    return df.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(list(keys))


# ------------------------------------------------------------ error rate
def error_rate(events: DataFrame, window: str = "5 minutes", slide: str | None = None,
               ts_col: str = "ts", result_col: str = "result", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Errors per second per event-time window (tumbling, or sliding with
    ``slide``).  Works on a stream (watermarked) and on a static frame."""
    w = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    src = events.withWatermark(ts_col, delay) if events.isStreaming else events
    g = src.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"),
                                      F.count_if(F.col(result_col) == "error").alias("n_errors"))
    span = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n_events", "n_errors", F.round(F.col("n_errors") / span, 6).alias("errors_per_sec"))


# ------------------------------------------------------- counter rate
# Fixed value: a gap to the window's edge counts as usual up to so many
# average gaps between samples.
USUAL_GAP = 1.1


def counter_rate(samples: DataFrame, window: str = "5 minutes", slide: str = "1 minute", series=RUN_OF, ts_col: str = "ts",
                 value_col: str = "value", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Per-second rate of a monotone counter in sliding windows: per series and
    window ``n_samples``, ``increase`` and ``rate``; one sample gives none.

    The increase sums the differences of consecutive samples; a sample below
    the one before it is a restart from zero and adds its own value.  It is
    then carried on to the window's edges: by the gap to the edge if that is a
    usual one (1.1 average gaps), else by half an average gap, and never back
    beyond where the counter would have been zero.

    Works on a stream (watermarked; windows are updated as samples arrive) and
    on a static frame.  A window's samples of one series are gathered, as many
    as it was scraped times within the window; repeated samples of one instant
    count once (the highest)."""
    src = samples.withWatermark(ts_col, delay) if samples.isStreaming else samples
    sample = F.struct(F.unix_micros(ts_col).alias("t"), F.col(value_col).cast("double").alias("v"))
    g = src.filter(F.col(value_col).isNotNull()).groupBy(*series, F.window(ts_col, window, slide).alias("w")).agg(F.array_sort(F.collect_set(sample)).alias("s"))
    s = F.col("s")
    last_of = F.filter(s, lambda x, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["t"] != x["t"]))
    g = g.withColumn("s", last_of).filter(F.size("s") > 1)
    n = F.size("s")
    pairs = F.sequence(F.lit(1), n - 1)
    step = lambda i: F.when(F.get(s, i)["v"] >= F.get(s, i - 1)["v"], F.get(s, i)["v"] - F.get(s, i - 1)["v"]).otherwise(F.get(s, i)["v"])
    increase = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + step(i))
    g = g.select(*series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), n.cast("long").alias("n_samples"),
                 increase.alias("increase"), F.get(s, 0)["t"].alias("_t0"), F.get(s, n - 1)["t"].alias("_t1"), F.get(s, 0)["v"].alias("_v0"))
    span = (F.col("_t1") - F.col("_t0")) / 1e6
    gap = span / (F.col("n_samples") - 1)
    near = lambda x: F.when(x < gap * USUAL_GAP, x).otherwise(gap / 2)
    ahead = near((F.col("_t0") - F.unix_micros("window_start")) / 1e6)
    zero = F.when((F.col("increase") > 0) & (F.col("_v0") >= 0), span * (F.col("_v0") / F.col("increase")))
    ahead = F.when(zero < ahead, zero).otherwise(ahead)
    behind = near((F.unix_micros("window_end") - F.col("_t1")) / 1e6)
    width = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1e6
    rate = F.col("increase") * ((span + ahead + behind) / span) / width
    return g.select(*series, "window_start", "window_end", "n_samples", "increase", F.round(rate, 9).alias("rate"))


# ------------------------------------------------------- latest status
STATUS_COLS = ["phase", "running", "desired", "driver_pod", "retries", "cost"]

# How long a run without news keeps its state (event time), the
# rows of a block that a hot run is sorted in, and the state store that holds
# the processor's states.
STATUS_KEEP = "30 days"
BLOCK_ROWS = 2_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


class ChangeOnly(StatefulProcessor):
    """Emits a run's status only where it differs from the one before.

    State of a run: its last status with (ts, event_id), and, while a
    micro-batch is read, the sorted blocks of a run that comes in more than one
    frame.  Such a run is sorted by merging its blocks, a few rows of each at a
    time, so no frame ever holds the whole run.  A timer at the last status
    plus ``keep`` (event time) drops the state of a run that has gone quiet."""

    def __init__(self, keys: list[str], cols: list[str], last: StructType, keep_ms: int):
        self.keys, self.cols, self.kind, self.keep = keys, cols, last, keep_ms
        self.order = ["ts", "event_id"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.kind)
        self.blocks = handle.getMapState("blocks", StructType([StructField("frame", IntegerType()), StructField("block", IntegerType())]),
                                         StructType([StructField("rows", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        now = before
        for frame in self._sorted(rows):
            now, news = self._news(frame, now)
            if len(news):
                yield news
        if now != before:
            self.last.update(now)
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.handle.registerTimer(self._expiry(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _expiry(self, last: tuple) -> int:
        return last[0] // 1000 + self.keep

    def _sorted(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The run's rows by (ts, event_id), in frames."""
        names = [*self.keys, *self.order, *self.cols]
        first = next(rows)[names].sort_values(self.order, kind="stable")
        other = next(rows, None)
        if other is None:
            yield first
            return
        n = 0
        while first is not None:
            for k in range(0, len(first), BLOCK_ROWS):
                b = pa.RecordBatch.from_pandas(first.iloc[k:k + BLOCK_ROWS], preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b)
                self.blocks.updateValue((n, k // BLOCK_ROWS), (sink.getvalue().to_pybytes(),))
            n += 1
            first = None if other is None else other[names].sort_values(self.order, kind="stable")
            other = next(rows, None)

        def block(frame: int, k: int) -> pd.DataFrame | None:
            if not self.blocks.containsKey((frame, k)):
                return None
            return pa.ipc.open_stream(self.blocks.getValue((frame, k))[0]).read_all().to_pandas()

        def stream(frame: int) -> Iterator[tuple]:
            k = 0
            while (b := block(frame, k)) is not None:
                yield from b.itertuples(index=False, name=None)
                k += 1

        at, ident = names.index("ts"), names.index("event_id")
        sample, held = block(0, 0).iloc[:0], []
        for row in heapq.merge(*(stream(i) for i in range(n)), key=lambda r: (r[at], r[ident])):
            held.append(row)
            if len(held) >= BLOCK_ROWS:
                yield pd.DataFrame(held, columns=names).astype(sample.dtypes.to_dict())
                held = []
        if held:
            yield pd.DataFrame(held, columns=names).astype(sample.dtypes.to_dict())
        self.blocks.clear()

    def _news(self, rows: pd.DataFrame, last: tuple | None) -> tuple[tuple | None, pd.DataFrame]:
        """The last status after ``rows`` (sorted), and the rows that are news."""
        ts = _micros(rows["ts"])
        if last is not None:
            # Rows that a later one has overtaken are no news.
            rows = rows[(ts > last[0]) | ((ts == last[0]) & (rows["event_id"] > last[1]))]
            if not len(rows):
                return last, rows
        now = rows[self.cols].astype(object).reset_index(drop=True)
        now = now.where(now.notna(), None)
        seen = pd.DataFrame([[None] * len(self.cols) if last is None else list(last[2:])], columns=self.cols, dtype=object)
        past = pd.concat([seen, now.iloc[:-1]], ignore_index=True)
        changed = ~((now == past) | (now.isna() & past.isna())).all(axis=1)
        changed.iloc[0] |= last is None
        end = rows.iloc[-1]
        plain = [None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in end[self.cols]]
        return (int(_micros(rows["ts"].iloc[-1:]).iloc[0]), int(end["event_id"]), *plain), rows[changed.to_numpy(bool)]


def latest_status(history: DataFrame, cols=STATUS_COLS, keys=RUN_OF, delay: str = DEFAULT_DELAY, keep: str = STATUS_KEEP) -> DataFrame:
    """Per run, emit a status only when one of ``cols`` differs from the run's
    previous status.  Rows of a run inside one micro-batch are taken in
    (ts, event_id) order, also when there are too many for one frame.  The
    state is the last status with its (ts, event_id): a row of a later batch
    that is not after it is late, changes nothing and is not emitted; neither
    is a row behind the watermark (``delay``).  A run without news for ``keep``
    of event time is forgotten: its next status is a first one.

    A ``transformWithState`` operator (RocksDB state, which the session is set
    to use); the stateful exchange is by run, so one task reads one run of a
    micro-batch, in bounded memory."""
    spark = history.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keys, cols = list(keys), list(cols)
    fields = {f.name: f for f in history.schema.fields}
    last = StructType([StructField("ts", LongType()), StructField("event_id", LongType()), *[StructField(c, fields[c].dataType) for c in cols]])
    out = StructType([StructField(c, fields[c].dataType) for c in [*keys, "ts", "event_id", *cols]])
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = history.select(*keys, "ts", "event_id", *cols).withWatermark("ts", delay)
    return rows.groupBy(*keys).transformWithStateInPandas(ChangeOnly(keys, cols, last, keep_ms), out, "append", "eventTime")


def run_to_parquet(df: DataFrame, dest: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming frame to completion (availableNow) into Parquet.

    ``update``: each trigger writes only the rows that it changed, to its own
    folder ``_batch=<epoch>`` (a replay replaces it); ``latest_rows`` reads the
    last version of each."""
    if mode == "update":
        def batch(b: DataFrame, epoch: int) -> None:
            (b.write.mode("overwrite").option("partitionOverwriteMode", "static")
              .parquet(f"{dest.rstrip('/')}/_batch={epoch}"))
        q = _available_now(df.writeStream.outputMode("update").foreachBatch(batch), checkpoint).start()
    else:
        q = _available_now(df.writeStream.outputMode(mode).format("parquet").option("path", dest), checkpoint).start()
    await_all(q)


def latest_rows(spark: SparkSession, dest: str, keys) -> DataFrame:
    """The last version of each row that ``run_to_parquet`` wrote in update mode."""
    rows = spark.read.parquet(dest)
    cols = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_last"))
    return last.select(*keys, "_last.*")
