"""ELT queries over the articles view (documents) and the date / HTML / id
functions over orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.functions import parse_date, stable_id, strip_html
from brook.operators import clean as C
from brook.operators import quality as Q
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views

# The oracle's version of the clean step: true date known, reason by order.
_CLEAN_SQL = """
  SELECT id, lower(trim(source)) AS source, trim(title) AS title, trim(link) AS link,
    published_at, regexp_replace(summary, '<[^>]+>', ' ', 'g') AS summary,
    lower(trim(category)) AS category, true_date AS published_date,
    CASE WHEN title IS NULL THEN 'missing_title' WHEN source IS NULL THEN 'missing_source'
      WHEN true_date IS NULL THEN 'bad_date' END AS reason
  FROM articles"""


def _cleaned(spark, sf):
    return C.clean(V.articles(spark, sf), lineage=False)


@register("elt_clean_daily", with_views(f"""
  SELECT source, CAST(published_date AS VARCHAR) AS published_date,
    count(*) AS n_articles, CAST(sum(length(title)) AS BIGINT) AS title_chars,
    count(DISTINCT category) AS n_categories
  FROM ({_CLEAN_SQL}) WHERE reason IS NULL GROUP BY 1, 2""", "articles"))
def elt_clean_daily(spark, sf):
    """Good rows per source and day: the minimum slice end to end."""
    good, _ = C.split(_cleaned(spark, sf))
    return (good.groupBy("source", F.col("published_date").cast("string").alias("published_date"))
                .agg(F.count(F.lit(1)).alias("n_articles"),
                     F.sum(F.length("title")).cast("bigint").alias("title_chars"),
                     F.countDistinct("category").alias("n_categories")))


@register("elt_clean_rows", with_views(f"""
  SELECT id, source, md5(title) AS title_md5, link, CAST(published_date AS VARCHAR) AS published_date,
    md5(summary) AS summary_md5, category, reason
  FROM ({_CLEAN_SQL})""", "articles"))
def elt_clean_rows(spark, sf):
    c = _cleaned(spark, sf)
    return c.select("id", "source", F.md5("title").alias("title_md5"), "link",
                    F.col("published_date").cast("string").alias("published_date"),
                    F.md5("summary").alias("summary_md5"), "category",
                    F.col(C.REASON_COL).alias("reason"))


@register("elt_reject_reasons", with_views(f"""
  SELECT reason, count(*) AS n_rows FROM ({_CLEAN_SQL}) WHERE reason IS NOT NULL GROUP BY 1""",
  "articles"))
def elt_reject_reasons(spark, sf):
    return Q.reject_reasons(_cleaned(spark, sf))


@register("elt_audit", with_views(f"""
  SELECT raw_rows, good_rows, quarantined_rows, raw_rows - good_rows AS rejected_rows,
    round((raw_rows - good_rows) / greatest(raw_rows, 1) * 100.0, 2) AS reject_pct,
    (raw_rows - good_rows) * 100.0 / greatest(raw_rows, 1) <= 20.0 AS gate_passed
  FROM (SELECT count(*) AS raw_rows, count(*) FILTER (WHERE reason IS NULL) AS good_rows,
          count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined_rows FROM ({_CLEAN_SQL}))""",
  "articles"))
def elt_audit(spark, sf):
    return Q.audit(_cleaned(spark, sf))


@register("multi_format_date", with_views("""
  SELECT key, value, CAST(true_date AS VARCHAR) AS parsed_date FROM dated_strings""", "dated_strings"))
def multi_format_date(spark, sf):
    d = V.dated_strings(spark, sf)
    return d.select("key", "value", parse_date("value").cast("string").alias("parsed_date"))


@register("strip_html_pages", """
  SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS text_md5,
    CAST(length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS BIGINT) AS n_chars
  FROM pages""")
def strip_html_pages(spark, sf):
    p = V.table(spark, sf, "pages")
    t = strip_html("html")
    return p.select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))


@register("stable_id_pages", """
  SELECT page_id, substr(sha1(concat_ws(chr(31), coalesce(url, ''), CAST(page_id AS VARCHAR))), 1, 16) AS id
  FROM pages""")
def stable_id_pages(spark, sf):
    p = V.table(spark, sf, "pages")
    return p.select("page_id", stable_id("url", "page_id").alias("id"))
