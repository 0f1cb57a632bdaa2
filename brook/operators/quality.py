"""Run audit, reject gate and the non-empty gate.

The audit is a single aggregation pass (``count_if`` per outcome) instead of
one count job per output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brook.operators.clean import REASON_COL

# Fixed value: the reject gate of the article ELT, in percent.
MAX_REJECT_PCT = 20.0


class GateError(RuntimeError):
    pass


def reject_pct_col(raw, good):
    return F.round((raw - good) / F.greatest(raw, F.lit(1)) * 100.0, 2)


def audit(cleaned: DataFrame, max_pct: float = MAX_REJECT_PCT) -> DataFrame:
    """One row: rows read, good, quarantined, rejected, reject rate, gate."""
    reason = F.col(REASON_COL)
    a = cleaned.agg(F.count(F.lit(1)).alias("raw_rows"),
                    F.count_if(reason.isNull()).alias("good_rows"),
                    F.count_if(reason.isNotNull()).alias("quarantined_rows"))
    return (a.withColumn("rejected_rows", F.col("raw_rows") - F.col("good_rows"))
             .withColumn("reject_pct", reject_pct_col(F.col("raw_rows"), F.col("good_rows")))
             # The raw rate decides, as in reject_gate; the rounded one is for reading.
             .withColumn("gate_passed", (F.col("raw_rows") - F.col("good_rows")) * 100.0
                         / F.greatest("raw_rows", F.lit(1)) <= F.lit(max_pct)))


def reject_reasons(cleaned: DataFrame) -> DataFrame:
    """Count per reject reason (good rows excluded)."""
    return (cleaned.filter(F.col(REASON_COL).isNotNull())
                   .groupBy(F.col(REASON_COL).alias("reason"))
                   .agg(F.count(F.lit(1)).alias("n_rows")))


def reject_gate(raw_rows: int, good_rows: int, max_pct: float = MAX_REJECT_PCT) -> float:
    """Raise when the reject rate is above ``max_pct``; return the rate."""
    pct = (raw_rows - good_rows) / max(raw_rows, 1) * 100.0
    if pct > max_pct:
        raise GateError(f"{raw_rows - good_rows} of {raw_rows} rows rejected ({pct:.4f} percent; at most {max_pct:g} allowed)")
    return pct


def require_rows(n: int, what: str = "rows") -> int:
    if n == 0:
        raise GateError(f"no {what}")
    return n
