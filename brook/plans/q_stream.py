"""Streaming queries run with availableNow on files landed from the driver
tables; each returns the sink read back, compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views
from brook.session import scratch_path
from brook.sources import lake as L
from brook.streaming import jobs as SJ


def _land(df, spark, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path


@register("stream_elt", with_views("""
  SELECT lower(trim(source)) AS source, CAST(true_date AS VARCHAR) AS published_date, count(*) AS n_articles
  FROM articles WHERE title IS NOT NULL AND true_date IS NOT NULL GROUP BY 1, 2""", "articles"))
def stream_elt(spark, sf):
    """Raw landing files -> streaming clean -> curated store, read back."""
    a = V.articles(spark, sf).withColumn("_source", F.lower(F.trim("category")))
    raw = scratch_path(spark, "stream-raw")
    L.write_raw(a, raw, "2024-06-01")
    dest = scratch_path(spark, "stream-curated")
    SJ.await_all(SJ.stream_elt(spark, raw, dest, scratch_path(spark, "stream-elt-ckpt")))
    back = spark.read.parquet(dest)
    return back.groupBy("source", F.col("published_date").cast("string").alias("published_date")) \
               .agg(F.count(F.lit(1)).alias("n_articles"))


@register("stream_dedup", with_views("""
  SELECT id, lower(trim(source)) AS source, published_at FROM articles""", "articles"))
def stream_dedup(spark, sf):
    """Two scrape runs streamed; each article key comes out once."""
    a = V.articles(spark, sf)
    rerun = a.filter(F.col("id").cast("bigint") % 3 == 0).withColumn("_scraped_at", F.lit("2024-06-01T00:05:00+00:00"))
    both = a.unionByName(rerun).withColumn("source", F.lower(F.trim("source"))) \
            .withColumn("scraped_ts", F.to_timestamp("_scraped_at"))
    src = _land(both, spark, "dedup-src")
    s = spark.readStream.schema(both.schema).parquet(src)
    out = SJ.stream_dedup(s, ["source", "id", "published_at"], "scraped_ts", "1 hour") \
            .select("id", "source", "published_at")
    dest = scratch_path(spark, "dedup-out")
    SJ.run_to_parquet(out, dest, scratch_path(spark, "dedup-ckpt"))
    return spark.read.parquet(dest)


@register("stream_error_rate", with_views("""
  SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS n_events, count(*) FILTER (WHERE result = 'error') AS n_errors,
    round(count(*) FILTER (WHERE result = 'error') / 300.0, 6) AS errors_per_sec
  FROM status_history GROUP BY 1""", "status_history"))
def stream_error_rate(spark, sf):
    """Error events per second over 5-minute windows, streamed: each trigger
    writes the windows that it changed, and a window's state goes with the
    watermark."""
    h = V.status_history(spark, sf).select("event_id", "ts", "result")
    src = _land(h, spark, "events-src")
    s = spark.readStream.schema(h.schema).parquet(src)
    dest = scratch_path(spark, "error-rate-out")
    SJ.run_to_parquet(SJ.error_rate(s), dest, scratch_path(spark, "error-rate-ckpt"), mode="update")
    r = SJ.latest_rows(spark, dest, ["window_start", "window_end"])
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n_events", "n_errors", "errors_per_sec")


@register("error_rate_batch", with_views("""
  SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
    count(*) AS n_events, count(*) FILTER (WHERE result = 'error') AS n_errors,
    round(count(*) FILTER (WHERE result = 'error') / 300.0, 6) AS errors_per_sec
  FROM status_history GROUP BY 1""", "status_history"))
def error_rate_batch(spark, sf):
    """The same windowed rate on the static table."""
    r = SJ.error_rate(V.status_history(spark, sf))
    return r.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n_events", "n_errors", "errors_per_sec")


# Scrapes of one counter per namespace: it counts up with the event id and restarts at every 61st.
_COUNTER_SQL = """,
  scrapes AS (SELECT namespace, ts, CAST(event_id % 61 AS DOUBLE) AS v FROM status_history),
  one AS (SELECT namespace, ts, max(v) AS v FROM scrapes GROUP BY ALL),
  placed AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w FROM one, (SELECT unnest(range(0, 4)) AS k)),
  steps AS (SELECT *, lag(v) OVER x AS p, first_value(v) OVER x AS v0 FROM placed WINDOW x AS (PARTITION BY namespace, w ORDER BY ts)),
  sums AS (SELECT namespace, w, count(*) AS n, sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END) AS inc, any_value(v0) AS v0,
             epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1 FROM steps GROUP BY ALL HAVING count(*) > 1),
  gaps AS (SELECT *, (t1 - t0) / 1e6 AS span, (t1 - t0) / 1e6 / (n - 1) AS gap, (t0 - epoch_us(w)) / 1e6 AS a,
             (epoch_us(w) + 3600000000 - t1) / 1e6 AS b FROM sums),
  near AS (SELECT *, CASE WHEN a < gap * 1.1::DOUBLE THEN a ELSE gap / 2 END AS a1, CASE WHEN b < gap * 1.1::DOUBLE THEN b ELSE gap / 2 END AS b1,
             CASE WHEN inc > 0 THEN span * (v0 / inc) END AS zero FROM gaps)
  SELECT namespace, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n AS n_samples, CAST(inc AS DOUBLE) AS increase,
    round(inc * ((span + CASE WHEN zero < a1 THEN zero ELSE a1 END + b1) / span) / 3600, 9) AS rate FROM near"""


def _scrapes(spark, sf):
    h = V.status_history(spark, sf)
    return h.select("namespace", "ts", (F.col("event_id") % 61).cast("double").alias("value"))


def _rates(df):
    return df.select("namespace", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_samples", "increase", "rate")


@register("counter_rate", with_views("", "status_history").rstrip() + _COUNTER_SQL)
def counter_rate(spark, sf):
    """Rate of a counter that restarts, over an hour every quarter of an hour."""
    return _rates(SJ.counter_rate(_scrapes(spark, sf), "1 hour", "15 minutes", ["namespace"]))


@register("stream_counter_rate", with_views("", "status_history").rstrip() + _COUNTER_SQL)
def stream_counter_rate(spark, sf):
    """The same rate, streamed: each trigger writes the windows that it changed."""
    h = _scrapes(spark, sf)
    src = _land(h, spark, "scrapes-src")
    s = spark.readStream.schema(h.schema).parquet(src)
    dest = scratch_path(spark, "rate-out")
    SJ.run_to_parquet(SJ.counter_rate(s, "1 hour", "15 minutes", ["namespace"]), dest, scratch_path(spark, "rate-ckpt"), mode="update")
    return _rates(SJ.latest_rows(spark, dest, ["namespace", "window_start", "window_end"]))


@register("stream_latest_status", with_views("""
  SELECT event_id, namespace, run, phase, running, desired, driver_pod, retries, cost FROM (
    SELECT *, row_number() OVER w AS rn, lag(phase) OVER w AS p1, lag(running) OVER w AS p2,
      lag(desired) OVER w AS p3, lag(driver_pod) OVER w AS p4, lag(retries) OVER w AS p5, lag(cost) OVER w AS p6
    FROM status_history WINDOW w AS (PARTITION BY namespace, run ORDER BY ts, event_id))
  WHERE rn = 1 OR p1 IS DISTINCT FROM phase OR p2 IS DISTINCT FROM running OR p3 IS DISTINCT FROM desired
    OR p4 IS DISTINCT FROM driver_pod OR p5 IS DISTINCT FROM retries OR p6 IS DISTINCT FROM cost""",
  "status_history"))
def stream_latest_status(spark, sf):
    """Change-only status stream (state per run) read back from its sink."""
    h = V.status_history(spark, sf).select("event_id", "namespace", "run", "ts", *SJ.STATUS_COLS)
    src = _land(h, spark, "status-src")
    s = spark.readStream.schema(h.schema).parquet(src)
    dest = scratch_path(spark, "status-out")
    SJ.run_to_parquet(SJ.latest_status(s), dest, scratch_path(spark, "status-ckpt"))
    return spark.read.parquet(dest).select("event_id", "namespace", "run", *SJ.STATUS_COLS)


@register("stream_phase_changes", with_views("""
  SELECT event_id, namespace, run, phase FROM (
    SELECT *, lag(phase) OVER (PARTITION BY namespace, run ORDER BY ts, event_id) AS p1 FROM status_history)
  WHERE p1 IS DISTINCT FROM phase""", "status_history"))
def stream_phase_changes(spark, sf):
    """Change-only stream on the phase alone (a selective change filter)."""
    h = V.status_history(spark, sf).select("event_id", "namespace", "run", "ts", "phase")
    src = _land(h, spark, "phase-src")
    s = spark.readStream.schema(h.schema).parquet(src)
    dest = scratch_path(spark, "phase-out")
    SJ.run_to_parquet(SJ.latest_status(s, ["phase"]), dest, scratch_path(spark, "phase-ckpt"))
    return spark.read.parquet(dest).select("event_id", "namespace", "run", "phase")
