"""Global positions without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead: range-partition by the order key, number rows inside each partition,
and add the row count of all earlier partitions.  The only global step works
on one row per partition, a size bounded by the partition count, so that
table (and only it) is broadcast.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def materialise(df: DataFrame, how: str = "persist") -> DataFrame:
    """Fix a frame whose rows carry partition-dependent values (partition id,
    monotonic ids) so that every later branch sees the same values.

    ``persist``: memory and disk on the executors; a lost block is rebuilt
    from the same shuffle output, so values do not change.  ``checkpoint``:
    written to the shared ``spark.checkpoint.dir`` (survives executor loss
    and cuts the lineage).  Never a local checkpoint."""
    if how == "checkpoint":
        from brook.session import checkpoint_dir

        checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def global_index(df: DataFrame, order_cols, pos_col: str = "_pos", total_col: str | None = None,
                 num_partitions: int | None = None, how: str = "persist") -> DataFrame:
    """Add a dense 0-based position following ``order_cols`` (which must
    make the order total, e.g. end with a unique id).  With ``total_col``
    every row also carries the row count."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = materialise(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                           .withColumn("_pid", F.spark_partition_id())
                           .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))),
                         how)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy(F.lit(0))).alias("_total"))
    out = ranged.join(F.broadcast(offsets), "_pid").withColumn(pos_col, F.col("_off") + F.col("_local"))
    drop = ["_pid", "_local", "_off", "_cnt"] + ([] if total_col else ["_total"])
    if total_col:
        out = out.withColumnRenamed("_total", total_col)
    return out.drop(*[c for c in drop if c in out.columns])
