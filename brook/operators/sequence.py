"""Per-key sequence operators (row number, previous row) that stay balanced
when one key holds a large share of the rows: a distributed prefix scan.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends a whole key to one
task.  Here rows are range-partitioned and sorted on (key, order) once, so a
hot key runs over several partitions.  Each partition is read front to back
(``mapInArrow``): a row gets its number and its predecessor within the
partition, and the partition's last row is marked.  Those last rows, one per
partition, say what each partition starts from; a broadcast join of that
table (its size is bounded by the partition count) mends the rows of the first
key of each partition.  No other shuffle takes place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from brook.operators.ordering import materialise as fixed

# Columns of the scan.
PID, NUMBER, EDGE, TAIL, BEFORE = "_pid", "_number", "_edge", "_tail", "_before"


def _list(x: str | list | tuple) -> list:
    return [x] if isinstance(x, str) else list(x)


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Null-safe equality."""
    same = pc.or_kleene(pc.equal(a, b), pc.and_(a.is_null(), b.is_null()))
    return same.fill_null(False).to_numpy(zero_copy_only=False)


def _scan(df: DataFrame, keys: list[str], order: list[str], lagged: list[str], num_partitions: int | None,
          how: str) -> DataFrame:
    """``df`` with, for every row, its partition, its number among the rows of
    its key there, the values ``lagged`` of the row before it (null for the
    first of a key), whether its key is the one that the partition starts with,
    and whether it is the partition's last row.  Fixed before use, because all
    that follows must see the same partitions."""
    cols = [*keys, *order]
    # Without a number given, AQE may join neighbouring small partitions.
    ranged = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    names = df.columns
    kind = StructType([*df.schema.fields, *[StructField(f"{BEFORE}_{i}", df.schema[c].dataType) for i, c in enumerate(lagged)],
                       StructField(NUMBER, LongType()), StructField(EDGE, BooleanType()), StructField(TAIL, BooleanType()),
                       StructField(PID, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        last: dict[str, pa.Array] | None = None  # the row before the batch
        number, edge = 0, True
        held: pa.RecordBatch | None = None

        def out(b: pa.RecordBatch, ends: bool) -> pa.RecordBatch:
            tail = np.zeros(b.num_rows, bool)
            tail[-1] = ends
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(tail), pa.array(np.full(b.num_rows, pid, np.int32))],
                                              [*b.schema.names, TAIL, PID])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if held is not None:
                yield out(held, False)
            of = {c: b.column(names.index(c)) for c in dict.fromkeys([*keys, *lagged])}
            whole = of if last is None else {c: pa.concat_arrays([last[c], x]) for c, x in of.items()}
            # same[i]: row i goes on with the key of the row before it.
            same = np.ones(n - (last is None), bool)
            for c in keys:
                same &= _equal(whole[c][1:], whole[c][:-1])
            if last is None:
                same = np.concatenate(([False], same))
            starts = np.flatnonzero(~same)
            first = np.zeros(n, np.int64)
            first[starts] = starts
            numbers = np.arange(n) - np.maximum.accumulate(first) + 1
            until = int(starts[0]) if len(starts) else n
            numbers[:until] += number
            # The first key lasts until the first change after the first row of all.
            changes = starts[1:] if last is None else starts
            stays = int(changes[0]) if len(changes) else n
            edges = edge & (np.arange(n) < stays)
            at = pa.array(np.arange(n) - (last is None), mask=~same)
            before = [whole[c].take(at) for c in lagged]
            held = pa.RecordBatch.from_arrays([*b.columns, *before, pa.array(numbers), pa.array(edges)],
                                              [*names, *[f"{BEFORE}_{i}" for i in range(len(lagged))], NUMBER, EDGE])
            number, edge = int(numbers[-1]), bool(edges[-1])
            last = {c: x[n - 1:] for c, x in of.items()}
        if held is not None:
            yield out(held, True)

    return fixed(ranged.sortWithinPartitions(*cols).mapInArrow(run, kind), how)


def _starts(scan: DataFrame, keys: list[str], lagged: list[str]) -> DataFrame:
    """For each partition the last row before it: its key, its number over all
    partitions, and its values.  A tail whose key fills its partition goes on
    counting where the tail before it stopped, so the numbers of one key's
    tails are running sums."""
    tails = scan.filter(TAIL).select(PID, *keys, NUMBER, *lagged)
    total = F.sum(NUMBER).over(Window.partitionBy(*keys).orderBy(PID))
    # One row per partition: bounded by the partition count.
    ahead = Window.orderBy(PID)
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("_total").alias("n"),
                   *[F.col(c).alias(f"v{i}") for i, c in enumerate(lagged)])
    return tails.withColumn("_total", total).select(F.col(PID).alias("_of"), F.lag(row).over(ahead).alias("_ahead"))


def _mended(scan: DataFrame, keys: list[str], lagged: list[str]) -> tuple[DataFrame, Column]:
    """The scan next to ``_ahead``, and whether a row's key began there."""
    both = scan.join(F.broadcast(_starts(scan, keys, lagged)), F.col(PID) == F.col("_of"), "left")
    goes_on = F.col(EDGE) & F.col("_ahead").isNotNull()
    for i, k in enumerate(keys):
        goes_on = goes_on & F.col(k).eqNullSafe(F.col(f"_ahead.k{i}"))
    return both, goes_on


def row_number_within(df: DataFrame, key, order, out_col: str = "rn", num_partitions: int | None = None,
                      materialise: str = "persist") -> DataFrame:
    """1-based row number per ``key`` (a column or several) following ``order``
    (which must be total within a key)."""
    keys, order = _list(key), _list(order)
    both, goes_on = _mended(_scan(df, keys, order, [], num_partitions, materialise), keys, [])
    number = F.col(NUMBER) + F.when(goes_on, F.col("_ahead.n")).otherwise(F.lit(0))
    return both.select(*[c for c in df.columns if c != out_col], number.alias(out_col))


def previous_values(df: DataFrame, key, order, cols, prefix: str = "prev_", num_partitions: int | None = None,
                    materialise: str = "persist") -> DataFrame:
    """Add ``prev_<c>`` (the value of the previous row of the same key) for
    each of ``cols`` and ``has_prev``."""
    keys, order, cols = _list(key), _list(order), _list(cols)
    both, goes_on = _mended(_scan(df, keys, order, cols, num_partitions, materialise), keys, cols)
    first = F.col(NUMBER) == 1
    before = [F.when(first, F.when(goes_on, F.col(f"_ahead.v{i}"))).otherwise(F.col(f"{BEFORE}_{i}")).alias(f"{prefix}{c}")
              for i, c in enumerate(cols)]
    return both.select(*df.columns, *before, (~first | goes_on).alias("has_prev"))
