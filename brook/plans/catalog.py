"""Registered queries: key -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables through the
views, and returns a DataFrame whose column names equal the oracle's.  Oracle
hygiene: counts as bigint, doubles rounded, long text compared by md5, clock
and path columns left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _import_all() -> None:
    # Each module registers its queries on import.
    from brook.plans import q_elt, q_feeds, q_fleet, q_rules, q_schedule, q_stream, q_train  # noqa: F401


def queries() -> dict[str, Builder]:
    _import_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _import_all()
    return dict(ORACLE)
