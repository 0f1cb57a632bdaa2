"""Article de-duplication across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys, order_col: str, count_col: str | None = None) -> DataFrame:
    """Keep one row per key: the one with the greatest ``order_col``.

    ``max(struct(order, row))`` is an ordinary aggregate, so Spark combines it
    map-side before the shuffle: a hot key that holds a third of the rows
    still sends one partial row per map task, never the whole group.
    """
    others = [c for c in df.columns if c not in keys and c != order_col]
    aggs = [F.max(F.struct(F.col(order_col), *[F.col(c) for c in others])).alias("_best")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    g = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(k) for k in keys] + [F.col("_best")[c].alias(c) for c in [order_col] + others]
    if count_col:
        cols.append(F.col(count_col))
    return g.select(*cols)


# Fixed value: distinct keys of a batch that are broadcast at most (64-bit hashes: 32 MB).
BROADCAST_KEYS = 1 << 22


def only_new(batch: DataFrame, store: DataFrame, keys, most: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``store``; a null key is never there.

    A batch is small next to the store, so the store is not moved to it: the
    hashes of the batch's distinct keys, counted first and broadcast up to
    ``most`` of them, cut the store down in its scan to the few rows that can
    match, and only those meet the batch, by the keys themselves.  A larger
    batch is joined with the whole store."""
    keys = list(keys)
    known = store.select(*keys)
    hashed = F.xxhash64(*keys)
    asked = batch.select(hashed.alias("_key")).distinct()
    if asked.count() <= most:
        known = known.withColumn("_key", hashed).join(F.broadcast(asked), "_key", "left_semi").drop("_key")
    return batch.join(known, on=keys, how="left_anti")
