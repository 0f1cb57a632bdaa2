import hashlib

import pytest
from pyspark.sql import functions as F

from brook.functions import parse_date, stable_id, strip_html
from brook.functions.quantity import millicores, spark_memory, whole_cores

# (value, expected ISO date or None), session zone UTC
DATES = [
    ("2026-06-05", "2026-06-05"), ("2026-06-05T21:00:00Z", "2026-06-05"),
    ("2026-06-05T23:30:00-05:00", "2026-06-05"), ("Fri, 05 Jun 2026 21:00:00 +0000", "2026-06-05"),
    ("Thu, 05 Jun 2026 21:00:00 +0000", "2026-06-05"), ("Fri, 05 Jun 2026 23:30:00 -0500", "2026-06-06"),
    ("Fri, 05 Jun 2026 21:00:00 GMT", "2026-06-05"), ("Fri, 05 Jun 2026 23:30:00 EST", "2026-06-06"),
    ("Fri, 05 Jun 2026 16:30:00 PDT", "2026-06-05"), ("Fri, 05 Jun 2026 17:30:00 PDT", "2026-06-06"), ("Fri, 05 Jun 2026 21:00:00 XYZ", None), ("2026", "2026-01-01"), ("2026-6-5", "2026-06-05"),
    (" 2026-06-05", "2026-06-05"), ("20260605", None), ("2026-13-45", None), ("junk", None), ("", None), (None, None),
]


def test_parse_date_forms(spark):
    df = spark.createDataFrame(DATES, "v string, want string")
    got = df.select("want", parse_date("v").cast("string").alias("got")).collect()
    assert [(r.want, r.got) for r in got] == [(w, w) for _, w in DATES]


def test_stable_id_matches_hashlib(spark):
    rows = [("https://a/b", "Title"), (None, "t"), ("l", None), (None, None)]
    df = spark.createDataFrame(rows, "link string, title string")
    got = [r.id for r in df.select(stable_id("link", "title").alias("id")).collect()]
    want = [hashlib.sha1("\x1f".join(p or "" for p in r).encode()).hexdigest()[:16] for r in rows]
    assert got == want


def test_strip_html_null_safe(spark):
    df = spark.createDataFrame([("<p>a<b>b</b></p>",), (None,)], "s string")
    assert [r.t for r in df.select(strip_html("s").alias("t")).collect()] == [" a b  ", None]


@pytest.mark.parametrize("cpu,milli,cores", [("500m", 500, 1), ("2", 2000, 2), ("1500m", 1500, 2), ("0.25", 250, 1),
                                             ("0", 0, 1), ("1e3", 1000000, 1000), ("5E-1", 500, 1), ("1x", None, 1)])
def test_cpu_quantities(spark, cpu, milli, cores):
    r = spark.createDataFrame([(cpu,)], "q string").select(millicores("q").alias("m"), whole_cores("q").alias("c")).first()
    assert (r.m, r.c) == (milli, cores)


@pytest.mark.parametrize("mem,want", [("512Mi", "512m"), ("2Gi", "2g"), ("1536Mi", "1536m"), ("1G", "953m"),
                                      ("1073741824", "1g"), ("1Ei", "1073741824g"), ("2e9", "1907m")])
def test_memory_quantities(spark, mem, want):
    assert spark.createDataFrame([(mem,)], "q string").select(spark_memory("q").alias("m")).first().m == want
