"""A representative set of registered queries against their DuckDB oracle
on the smallest driver tables (the full set runs in scripts/check_oracle.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KEYS = ["elt_clean_daily", "elt_audit", "multi_format_date", "feed_xml_items", "feed_csv_items", "label_encode",
        "shard_assign", "running_executors", "job_status", "history_retention", "status_changes", "attempts",
        "missing_deps", "config_overlay", "fire_calendar", "next_fire", "spec_report", "error_rate_batch",
        "training_status", "training_changes", "fire_history", "counter_rate", "capacity_plan"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_duckdb(spark, duck, key):
    df = E.queries()[key](spark, SF001)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want
