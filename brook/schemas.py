"""Schemas shared by sources, sinks and operators."""

from pyspark.sql.types import StringType, StructField, StructType

ARTICLE_FIELDS = ["id", "source", "title", "link", "published_at", "summary", "category"]

# Landing (raw zone) rows: every value a string, typing happens in the ELT.
RAW_ARTICLE = StructType([StructField(c, StringType(), True)
                          for c in ARTICLE_FIELDS + ["_source", "_scraped_at"]])

# What a landing folder holds once ``_source`` has become a directory: the
# ELT reads exactly this, plus the corrupt-record column.  Building it fresh
# (never mutating a module constant) keeps repeated reads stable.
def raw_read_schema() -> StructType:
    return StructType([StructField(c, StringType(), True)
                       for c in ARTICLE_FIELDS + ["_scraped_at", "_corrupt_record"]])


MANIFEST = StructType([StructField("url", StringType(), True),
                       StructField("format", StringType(), True),
                       StructField("source", StringType(), True)])

PAYLOAD = StructType([StructField("url", StringType(), True),
                      StructField("format", StringType(), True),
                      StructField("source", StringType(), True),
                      StructField("body", StringType(), True),
                      StructField("scraped_at", StringType(), True),
                      StructField("error", StringType(), True)])
