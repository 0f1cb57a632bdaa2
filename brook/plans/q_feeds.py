"""Feed, landing-zone and curated-store queries (payloads built from pages,
articles from documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.operators import clean as C
from brook.operators.dedup import dedup_latest, only_new
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views
from brook.session import scratch_path
from brook.sources import feeds as FD
from brook.sources import lake as L

_PG = f"""pg AS (
  SELECT page_id AS p, url, page_id % 6 AS kind, CAST(page_id AS VARCHAR) AS sp,
    (DATE '2024-01-01' + CAST(page_id % 400 AS INTEGER)) AS day,
    CASE WHEN page_id % 10 = 7 THEN url ELSE 'feed' || CAST(page_id % 5 AS VARCHAR) END AS src,
    (page_id % 11 = 0 AND page_id % 6 NOT IN (2, 5)) AS broken
  FROM pages)"""

_SID = "substr(sha1({link} || chr(31) || {title}), 1, 16)"

_XML_ROWS = f"""
  SELECT 'guid-' || sp AS id, src AS source, 'Item ' || sp || ' a' AS title, url AS link,
    strftime(day, '%a, %d %b %Y') || ' 08:00:00 +0000' AS published_at,
    CASE WHEN p % 4 = 0 THEN 'Early ' || sp ELSE '<b>Story ' || sp || '</b> text' END AS summary, 'cat' || CAST(p % 7 AS VARCHAR) AS category, src AS _source
  FROM pg WHERE kind IN (0, 3) AND NOT broken
  UNION ALL
  SELECT {_SID.format(link="url || '#b'", title="'Item ' || sp || ' b'")}, src, 'Item ' || sp || ' b', url || '#b',
    strftime(day, '%a, %d %b %Y') || ' 08:00:00 +0000', NULL, NULL, src
  FROM pg WHERE kind IN (0, 3) AND NOT broken
  UNION ALL
  SELECT 'urn:entry:' || sp, src, 'Entry ' || sp || ' a', url, strftime(day, '%Y-%m-%d') || 'T08:00:00Z',
    CASE WHEN p % 4 = 3 THEN 'Full ' || sp ELSE 'Summary ' || sp END, 'topic' || CAST(p % 5 AS VARCHAR), src
  FROM pg WHERE kind = 1 AND NOT broken
  UNION ALL
  SELECT {_SID.format(link="url || '?b=1'", title="'Entry ' || sp || ' b'")}, src, 'Entry ' || sp || ' b', url || '?b=1',
    strftime(day, '%Y-%m-%d') || 'T22:00:00-03:00', '<p>Body ' || sp || '</p>', NULL, src
  FROM pg WHERE kind = 1 AND NOT broken
  UNION ALL
  SELECT {_SID.format(link="url", title="'Rdf ' || sp")}, src, 'Rdf ' || sp, url, NULL, 'Desc ' || sp, NULL, src
  FROM pg WHERE kind = 4 AND NOT broken
  UNION ALL
  SELECT {_SID.format(link="''", title="'Inner ' || sp")}, src, 'Inner ' || sp, NULL, NULL, NULL, NULL, src
  FROM pg WHERE kind = 4 AND NOT broken AND p % 8 = 4"""

_CSV_ROWS = f"""
  SELECT {_SID.format(link="''", title="'Land ' || sp")} AS id, src AS source, 'Land ' || sp AS title,
    NULL AS link, CAST(1990 + p % 30 AS VARCHAR) AS published_at, NULL AS summary, NULL AS category, src AS _source
  FROM pg WHERE kind IN (2, 5) AND p % 4 = 2
  UNION ALL
  SELECT {_SID.format(link="''", title="'Land ' || sp || ', North'")}, src, 'Land ' || sp || ', North', NULL,
    CAST(2000 + p % 20 AS VARCHAR), NULL, NULL, src
  FROM pg WHERE kind IN (2, 5) AND p % 4 = 2
  UNION ALL
  SELECT {_SID.format(link="url", title="'Title ' || sp")}, src, 'Title ' || sp, url, strftime(day, '%Y-%m-%d'),
    'Line one' || chr(10) || 'line two of ' || sp, 'news', src
  FROM pg WHERE kind IN (2, 5) AND p % 4 <> 2
  UNION ALL
  SELECT {_SID.format(link="url || '/2'", title="''")}, src, NULL, url || '/2', NULL, NULL, NULL, src
  FROM pg WHERE kind IN (2, 5) AND p % 4 <> 2"""

_RAW_COLS = "id, source, title, link, published_at, summary, category, _source, '" + V.SCRAPED_AT + "' AS _scraped_at"


@register("feed_xml_items", f"WITH {_PG} SELECT {_RAW_COLS} FROM ({_XML_ROWS})")
def feed_xml_items(spark, sf):
    p = V.payloads(spark, sf)
    return FD.feed_xml_explode(p.filter(F.lower("format") == "xml"))


@register("feed_csv_items", f"WITH {_PG} SELECT {_RAW_COLS} FROM ({_CSV_ROWS})")
def feed_csv_items(spark, sf):
    p = V.payloads(spark, sf)
    return FD.open_csv_normalise(p.filter(F.lower("format") != "xml"))


@register("feed_union", f"""WITH {_PG}
  SELECT _source, count(*) AS n_items, count(title) AS n_titled, count(DISTINCT id) AS n_ids
  FROM ({_XML_ROWS} UNION ALL {_CSV_ROWS}) GROUP BY 1""")
def feed_union(spark, sf):
    u = FD.feed_union(V.payloads(spark, sf))
    return u.groupBy("_source").agg(F.count(F.lit(1)).alias("n_items"), F.count("title").alias("n_titled"),
                                    F.countDistinct("id").alias("n_ids"))


@register("manifest_scan", """
  SELECT url, CASE WHEN page_id % 6 IN (0, 1, 3) THEN 'xml' WHEN page_id % 6 = 4 THEN 'XML' ELSE 'csv' END AS format,
    CASE WHEN page_id % 10 = 7 THEN NULL ELSE 'feed' || CAST(page_id % 5 AS VARCHAR) END AS source
  FROM pages""")
def manifest_scan(spark, sf):
    """Manifest files written from the pages' feed list, read back."""
    p = V.payloads(spark, sf).select("url", "format", "source")
    path = scratch_path(spark, "manifest")
    L.write_manifest(p, path)
    return L.manifest_scan(spark, path)


def _landed(spark, sf):
    a = V.articles(spark, sf).withColumn("_source", F.lower(F.trim("category")))
    path = scratch_path(spark, "landing")
    L.write_raw(a, path, "2024-06-01")
    return L.raw_scan(spark, path)


@register("raw_roundtrip", with_views("""
  SELECT id, source, md5(title) AS title_md5, link, published_at, md5(summary) AS summary_md5, category,
    lower(trim(category)) AS _source, '2024-06-01' AS scrape_date, false AS is_corrupt
  FROM articles""", "articles"))
def raw_roundtrip(spark, sf):
    """Landing CSV write + permissive read back: values, NULLs, newlines and
    quotes survive; no row is corrupt."""
    r = _landed(spark, sf)
    return r.select("id", "source", F.md5("title").alias("title_md5"), "link", "published_at",
                    F.md5("summary").alias("summary_md5"), "category", "_source",
                    F.col("scrape_date").cast("string").alias("scrape_date"),
                    F.col("_corrupt_record").isNotNull().alias("is_corrupt"))


@register("curated_roundtrip", with_views("""
  SELECT CAST(true_date AS VARCHAR) AS published_date, count(*) AS n_rows,
    count(DISTINCT lower(trim(source))) AS n_sources
  FROM articles WHERE title IS NOT NULL AND true_date IS NOT NULL GROUP BY 1""", "articles"))
def curated_roundtrip(spark, sf):
    """Full ELT: landing -> scan -> clean -> curated Parquet -> curated scan."""
    good, _ = C.split(C.clean(_landed(spark, sf)))
    path = scratch_path(spark, "curated")
    L.write_curated(good, path, "published_date", run="2024-06-01")
    back = L.curated_scan(spark, path, required=["title", "source", "published_date"])
    return (back.groupBy(F.col("published_date").cast("string").alias("published_date"))
                .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources")))


def _two_runs(spark, sf):
    a = V.articles(spark, sf)
    rerun = a.filter(F.col("id").cast("bigint") % 3 == 0).withColumn("_scraped_at", F.lit("2024-06-02T00:00:00+00:00"))
    return a.unionByName(rerun)


@register("dedup_articles", with_views(f"""
  SELECT id, lower(trim(source)) AS source, published_at,
    CASE WHEN doc_id % 3 = 0 THEN '2024-06-02T00:00:00+00:00' ELSE '{V.SCRAPED_AT}' END AS _scraped_at,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_copies
  FROM articles""", "articles"))
def dedup_articles(spark, sf):
    """Two scrape runs; articles seen twice are kept once (the latest copy)."""
    # Only what is returned is read and aggregated; texts stay out of the shuffle.
    r = _two_runs(spark, sf).select("id", F.lower(F.trim("source")).alias("source"), "published_at", "_scraped_at")
    return (dedup_latest(r, ["source", "id", "published_at"], "_scraped_at", count_col="n_copies")
            .select("id", "source", "published_at", "_scraped_at", "n_copies"))


@register("only_new_articles", with_views("""
  SELECT id, lower(trim(source)) AS source FROM articles
  WHERE doc_id % 2 = 1 AND title IS NOT NULL""", "articles"))
def only_new_articles(spark, sf):
    """Yesterday's store holds the even ids; today's batch keeps only new ones."""
    good, _ = C.split(C.clean(V.articles(spark, sf), lineage=False))
    store = good.filter(F.col("id").cast("bigint") % 2 == 0).select("id")
    batch = C.clean(V.articles(spark, sf), lineage=False).filter(F.col("title").isNotNull())
    return only_new(batch, store, ["id"]).select("id", "source")


@register("elt_job_quarantine", with_views("""
  SELECT reason AS _reject_reason, count(*) AS n_rows, count(DISTINCT lower(trim(source))) AS n_sources FROM (
    SELECT source, CASE WHEN title IS NULL THEN 'missing_title' WHEN true_date IS NULL THEN 'bad_date' END AS reason
    FROM articles) WHERE reason IS NOT NULL GROUP BY 1""", "articles"))
def elt_job_quarantine(spark, sf):
    """The batch ELT job on a landing folder; the quarantine read back."""
    from brook.plans.jobs import run_elt

    a = V.articles(spark, sf).withColumn("_source", F.lower(F.trim("category")))
    raw = scratch_path(spark, "job-raw")
    L.write_raw(a, raw, "2024-06-01")
    dest = scratch_path(spark, "job-curated")
    run_elt(spark, dest, source_path=raw, gate=False)
    q = spark.read.parquet(L.quarantine_path(dest))
    return q.groupBy("_reject_reason").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source").alias("n_sources"))


@register("curated_two_runs", with_views("""
  SELECT 'good' AS kind, CAST(true_date AS VARCHAR) AS published_date, count(*) AS n_rows FROM articles
  WHERE title IS NOT NULL AND true_date IS NOT NULL GROUP BY 2
  UNION ALL SELECT CASE WHEN title IS NULL THEN 'missing_title' ELSE 'bad_date' END, NULL, count(*) FROM articles
  WHERE title IS NULL OR true_date IS NULL GROUP BY 1""", "articles"))
def curated_two_runs(spark, sf):
    """Two daily runs whose articles share dates and reject reasons, the first
    one repeated: the stores hold every row once."""
    from brook.plans.jobs import run_elt

    a = V.articles(spark, sf).withColumn("_source", F.lower(F.trim("category")))
    base, dest = scratch_path(spark, "runs-raw"), scratch_path(spark, "runs-curated")
    days = {"2024-06-01": 0, "2024-06-02": 1}
    for day, part in days.items():
        # Halves by pairs of ids, so both days hold every date and reason.
        L.write_raw(a.filter(F.floor(F.col("id").cast("bigint") / 2) % 2 == part), L.dated_path(base, day), day)
    for day in [*days, "2024-06-01"]:
        run_elt(spark, dest, source_base=base, date=day, gate=False)
    good = L.curated_scan(spark, dest).select(F.lit("good").alias("kind"), F.col("published_date").cast("string").alias("published_date"))
    bad = spark.read.parquet(L.quarantine_path(dest)).select(F.col("_reject_reason").alias("kind"), F.lit(None).cast("string").alias("published_date"))
    return good.union(bad).groupBy("kind", "published_date").agg(F.count(F.lit(1)).alias("n_rows"))


# Fixed value: entries of one manifest file.
MANIFEST_ROWS = 10_000


def _payload_files(spark, sf):
    """One payload file per page, and the manifest of those files, with paths
    as Spark lists them; the feed is named after the format."""
    files = scratch_path(spark, "payload-files")
    listed = L.write_payload_files(V.payloads(spark, sf), files)
    return files, listed.select("url", "format", F.concat(F.lit("store-"), F.lower("format")).alias("source"))


@register("acquire_payloads", """
  SELECT CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'htm' END AS format, md5(html || chr(10)) AS body_md5, false AS failed FROM pages
  UNION ALL SELECT 'html', NULL, true""")
def acquire_payloads(spark, sf):
    """Page files in a store that Spark reads, acquired by their manifest, which also names a file that is not there."""
    files = scratch_path(spark, "page-files")
    p = V.table(spark, sf, "pages").select(F.col("html").alias("body"), F.when(F.col("page_id") % 2 == 0, "html").otherwise("htm").alias("format"))
    listed = L.write_payload_files(p, files).select("url", "format", F.lit("store").alias("source"))
    lost = listed.limit(1).select(F.concat("url", F.lit(".gone")).alias("url"), F.lit("html").alias("format"), "source")
    got = FD.read_payload_files(listed.unionByName(lost), files)
    return got.select("format", F.md5("body").alias("body_md5"), F.col("error").isNotNull().alias("failed"))


@register("scrape_job", f"""WITH {_PG}
  SELECT 'store-xml' AS _source, '/2024/06/01/' AS day_path, '2024-06-01' AS scrape_date, count(*) AS n_items,
    count(title) AS n_titled, count(DISTINCT id) AS n_ids FROM ({_XML_ROWS})
  UNION ALL
  SELECT 'store-csv', '/2024/06/01/', '2024-06-01', count(*), count(title), count(DISTINCT id) FROM ({_CSV_ROWS})""")
def scrape_job(spark, sf):
    """The scrape job from manifest files to the dated landing folder, behind
    its non-empty gate, read back."""
    from brook.plans.jobs import run_scrape

    files, manifest = _payload_files(spark, sf)
    listed = scratch_path(spark, "scrape-manifest")
    # A manifest file is one array, which one task reads.
    L.write_manifest(manifest, listed, files=-(-manifest.count() // MANIFEST_ROWS))
    dest = run_scrape(spark, listed, dest_base=scratch_path(spark, "scraped"), date="2024-06-01", store=files)
    return (L.raw_scan(spark, dest).groupBy("_source", F.col("scrape_date").cast("string").alias("scrape_date"))
            .agg(F.count(F.lit(1)).alias("n_items"), F.count("title").alias("n_titled"), F.countDistinct("id").alias("n_ids"))
            .withColumn("day_path", F.lit(dest[-12:])))


@register("curated_compacted", with_views("""
  SELECT CAST(true_date AS VARCHAR) AS published_date, count(*) AS n_rows, count(DISTINCT id) AS n_ids, true AS fewer_files FROM articles
  WHERE title IS NOT NULL AND true_date IS NOT NULL GROUP BY 1""", "articles"))
def curated_compacted(spark, sf):
    """Three runs, compaction, one of them repeated and a fourth added after it: every row once, in fewer files."""
    good, _ = C.split(C.clean(V.articles(spark, sf), lineage=False))
    part = lambda k: good.filter(F.col("id").cast("bigint") % 4 == k)
    path = scratch_path(spark, "compacted")
    for k in range(3):
        L.write_curated(part(k), path, run=f"2024-06-0{k + 1}")
    loose = len(L.curated_scan(spark, path).inputFiles())
    L.compact_curated(spark, path)
    fewer = len(L.curated_scan(spark, path).inputFiles()) < loose
    L.write_curated(part(1), path, run="2024-06-02")
    L.write_curated(part(3), path, run="2024-06-04")
    back = L.curated_scan(spark, path)
    return (back.groupBy(F.col("published_date").cast("string").alias("published_date"))
                .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids")).withColumn("fewer_files", F.lit(fewer)))


@register("required_articles", with_views("""
  SELECT id, lower(trim(source)) AS source, md5(title) AS title_md5 FROM articles WHERE title IS NOT NULL""", "articles"))
def required_articles(spark, sf):
    """Landed rows that hold the required columns and parsed cleanly."""
    r = C.required_filter(_landed(spark, sf))
    return r.select("id", F.lower(F.trim("source")).alias("source"), F.md5("title").alias("title_md5"))


@register("lineage_rows", with_views("""
  SELECT id, '2024-06-01' AS path_day, lower(trim(category)) AS path_source, true AS is_csv, true AS has_ts FROM articles""",
  "articles"))
def lineage_rows(spark, sf):
    """Lineage of landed rows: the file that each came from, and when it was cleaned."""
    c = C.clean(_landed(spark, sf))
    part = lambda name: F.regexp_extract("_source_path", f"/{name}=([^/]+)/", 1)
    return c.select("id", part("scrape_date").alias("path_day"), part("_source").alias("path_source"),
                    F.col("_source_path").endswith(".csv").alias("is_csv"), F.col("_pipeline_ts").isNotNull().alias("has_ts"))


@register("label_map_json", with_views("""
  SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS id
  FROM (SELECT DISTINCT lower(trim(source)) AS label FROM articles WHERE title IS NOT NULL AND true_date IS NOT NULL)""",
  "articles"))
def label_map_json(spark, sf):
    """The label map persisted as JSON and read back."""
    from brook.operators import trainprep as T

    good, _ = C.split(C.clean(V.articles(spark, sf), lineage=False))
    path = scratch_path(spark, "label-map")
    T.write_label_map(T.label_map(T.train_frame(good)), path)
    return spark.read.schema("label string, id long").json(path)
