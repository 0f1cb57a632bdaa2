"""The two batch jobs end to end (spark-submit entry points).

    python -m brook.plans.jobs elt --source-base s3a://b/raw/articles/ --dest-path s3a://b/curated/articles/ [--date D]
    python -m brook.plans.jobs scrape --url-manifest s3a://b/config/feeds.json --dest-base s3a://b/raw/articles/ [--date D]
"""

from __future__ import annotations

import argparse
import hashlib
import sys
from datetime import datetime, timezone

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from brook.operators import clean as C
from brook.operators import quality as Q
from brook.session import build_session, scratch_path
from brook.sources import feeds as FD
from brook.sources import lake as L


def run_elt(spark: SparkSession, dest_path: str, source_path: str | None = None, source_base: str | None = None,
            date: str | None = None, partition_by: str = "published_date", run: str | None = None,
            max_reject_pct: float = Q.MAX_REJECT_PCT, gate: bool = True) -> dict:
    """Raw landing CSV -> curated Parquet + quarantine, audit and gate.

    Nothing is persisted: the input is read once for the curated write, which
    also counts all rows and the good ones (an observation below the filter),
    and a second time only if there are rejects to write.  ``run`` names the run's folder in the
    stores; by default the logical date, or a hash of an explicit source path.
    """
    path = L.dated_path(source_base, date, source_path)
    if run is None:
        today = datetime.now(timezone.utc).strftime("%Y-%m-%d")
        run = date or ("path-" + hashlib.sha1(path.encode()).hexdigest()[:12] if source_path else today)
    seen = Observation("rows_read")
    cleaned = C.clean(L.raw_scan(spark, path))
    counted = cleaned.observe(seen, F.count(F.lit(1)).alias("raw"), F.count_if(F.col(C.REASON_COL).isNull()).alias("good"))
    L.write_curated(C.split(counted)[0], dest_path, partition_by, run=run)
    n_raw, n_good = int(seen.get["raw"]), int(seen.get["good"])
    n_bad = L.write_quarantine(C.split(cleaned)[1], dest_path, run=run, some=n_raw > n_good)
    result = {"raw_rows": n_raw, "good_rows": n_good, "quarantined_rows": n_bad,
              "reject_pct": round((n_raw - n_good) / max(n_raw, 1) * 100.0, 2)}
    if gate:
        Q.reject_gate(n_raw, n_good, max_reject_pct)
    return result


def run_scrape(spark: SparkSession, manifest_path: str, dest_path: str | None = None, dest_base: str | None = None,
               date: str | None = None, fetcher=FD.http_fetch, parallelism: int | None = None,
               payload_path: str | None = None, store: str | None = None) -> str:
    """Manifest -> fetch on executors -> payloads landed once (Parquet) ->
    feed rows -> landing CSV partitioned by scrape date and source.  With
    ``store`` the manifest names files below that folder, which Spark reads."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%d")
    dest = L.dated_path(dest_base, date, dest_path)
    manifest = L.manifest_scan(spark, manifest_path)
    if store:
        payloads = FD.read_payload_files(manifest, store)
    else:
        payloads = FD.acquire_payloads(manifest, fetcher, parallelism)
    payload_path = payload_path or scratch_path(spark, "payloads")
    payloads.write.mode("overwrite").parquet(payload_path)
    articles = FD.feed_union(spark.read.parquet(payload_path))
    Q.require_rows(0 if articles.isEmpty() else 1, "feed items in any payload")
    L.write_raw(articles, dest, date)
    return dest


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="brook.plans.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    e = sub.add_parser("elt")
    e.add_argument("--source-path")
    e.add_argument("--source-base")
    e.add_argument("--date")
    e.add_argument("--dest-path", required=True)
    e.add_argument("--partition-by", default="published_date")
    s = sub.add_parser("scrape")
    s.add_argument("--url-manifest", required=True)
    s.add_argument("--dest-path")
    s.add_argument("--dest-base")
    s.add_argument("--date")
    ap.add_argument("--input-bytes", type=int, default=None,
                    help="expected input size; sizes the shuffle partitions (about one per 256 MB)")
    a = ap.parse_args(argv)
    from brook.session import scale_conf

    spark = build_session(app=f"brook-{a.job}", extra=scale_conf(a.input_bytes) if a.input_bytes else None)
    try:
        if a.job == "elt":
            if not a.source_path and not a.source_base:
                ap.error("one of --source-path or --source-base is required")
            print(run_elt(spark, a.dest_path, a.source_path, a.source_base, a.date, a.partition_by))
        else:
            if not a.dest_path and not a.dest_base:
                ap.error("one of --dest-path or --dest-base is required")
            print(run_scrape(spark, a.url_manifest, a.dest_path, a.dest_base, a.date))
    except Q.GateError as exc:
        print(f"[ERROR] {exc}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
