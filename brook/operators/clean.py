"""The clean step of the ELT job: required fields, typed date, normalised
strings, HTML stripped, lineage columns, and a reject reason per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.functions import parse_date, strip_html

CORRUPT_COL = "_corrupt_record"
REASON_COL = "_reject_reason"
# Reject reasons, in the order they are decided.
REJECT_REASONS = ["corrupt", "missing_title", "missing_source", "bad_date"]


def reject_reason(df: DataFrame, date_col: str = "published_date") -> Column:
    corrupt = F.col(CORRUPT_COL).isNotNull() if CORRUPT_COL in df.columns else F.lit(False)
    return (F.when(corrupt, "corrupt")
            .when(F.col("title").isNull(), "missing_title")
            .when(F.col("source").isNull(), "missing_source")
            .when(F.col(date_col).isNull(), "bad_date"))


def required_filter(df: DataFrame, cols=("title", "source")) -> DataFrame:
    """Keep rows whose required columns are present and which parsed cleanly."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    if CORRUPT_COL in df.columns:
        cond = cond & F.col(CORRUPT_COL).isNull()
        return df.filter(cond).drop(CORRUPT_COL)
    return df.filter(cond)


def normalise_strings(df: DataFrame) -> DataFrame:
    """lower(trim) for source and category, trim for title and link."""
    return df.withColumns({
        "source": F.lower(F.trim("source")),
        "category": F.lower(F.trim("category")),
        "title": F.trim("title"),
        "link": F.trim("link"),
    })


def with_lineage(df: DataFrame, scrape_date: str | None = None) -> DataFrame:
    cols = {"_pipeline_ts": F.current_timestamp()}
    if "_source_path" not in df.columns:
        cols["_source_path"] = F.input_file_name()
    if scrape_date is not None:
        cols["scrape_date"] = F.lit(scrape_date)
    return df.withColumns(cols)


def clean(df: DataFrame, lineage: bool = True) -> DataFrame:
    """All rows of a raw-article frame, typed and normalised, each with its
    ``_reject_reason`` (NULL for good rows).  One narrow pass: no shuffle."""
    out = df.withColumn("published_date", parse_date("published_at"))
    out = out.withColumn(REASON_COL, reject_reason(out))
    out = normalise_strings(out).withColumn("summary", strip_html("summary"))
    if CORRUPT_COL in out.columns:
        out = out.drop(CORRUPT_COL)
    return with_lineage(out) if lineage else out


def split(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """good ∪ bad = cleaned and good ∩ bad = ∅ (one reason column decides)."""
    good = cleaned.filter(F.col(REASON_COL).isNull()).drop(REASON_COL)
    bad = cleaned.filter(F.col(REASON_COL).isNotNull())
    return good, bad
