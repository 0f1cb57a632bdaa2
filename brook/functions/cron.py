"""Five-field cron expressions ("min hour dom mon dow") as Spark expressions.

Grammar (common crontab rules): ``*`` or ``?`` (day fields), numbers, ranges
``a-b``, steps ``/n`` (``a/n`` runs to the field maximum), comma lists, month
and weekday names; weekday 0 = Sunday.  When day-of-month and day-of-week are
both restricted a day matches if either does, otherwise both must match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Field bounds, and the month / weekday names.
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 6)]
MONTH_NAMES = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DOW_NAMES = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
ITEM = r"^(\*|\?|[0-9]+(-[0-9]+)?)(/[0-9]+)?$"


def _names_to_numbers(f: Column, names, first: int) -> Column:
    out = F.upper(f)
    for i, n in enumerate(names):
        out = F.regexp_replace(out, rf"\b{n}\b", str(first + i))
    return out


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _parse_item(it: Column, lo: int, hi: int) -> Column:
    base = F.regexp_extract(it, r"^([^/]*)", 1)
    step_s = F.regexp_extract(it, r"/([0-9]+)$", 1)
    step = F.when(step_s == "", F.lit(1)).otherwise(_int(step_s))
    star = base.isin("*", "?")
    a = F.when(star, F.lit(lo)).otherwise(_int(F.regexp_extract(base, r"^([0-9]+)", 1)))
    b = (F.when(star, F.lit(hi))
         .when(base.contains("-"), _int(F.regexp_extract(base, r"-([0-9]+)$", 1)))
         .when(step_s != "", F.lit(hi))
         .otherwise(a))
    return F.struct(it.rlike(ITEM).alias("ok"), a.alias("a"), b.alias("b"), step.alias("step"),
                    (star & (step == 1)).alias("star"))


def _item_parser(lo: int, hi: int):
    return lambda it: _parse_item(it, lo, hi)


def _item_check(lo: int, hi: int):
    return lambda p: p["ok"] & (p["a"] >= lo) & (p["b"] <= hi) & (p["a"] <= p["b"]) & (p["step"] > 0)


def with_parsed_cron(df: DataFrame, expr_col: str = "schedule", out: str = "cron") -> DataFrame:
    """Add ``out``: struct of minute / hour / dom / month / dow arrays (NULL
    when invalid), dom_star, dow_star and valid.

    Written as a chain of projections, each step naming its result, so the
    plan holds every sub-expression once (a single nested expression would
    repeat each field's parse in every place it is used)."""
    e = F.trim(F.col(expr_col))
    d = df.withColumn("_cp", F.split(e, r"\s+"))
    raws = {}
    for i, (name, lo, hi) in enumerate(FIELDS):
        raw = F.when(F.size("_cp") == 5, F.try_element_at(F.col("_cp"), F.lit(i + 1)))
        if name == "month":
            raw = _names_to_numbers(raw, MONTH_NAMES, 1)
        elif name == "dow":
            raw = _names_to_numbers(raw, DOW_NAMES, 0)
        raws[f"_cf_{name}"] = raw
    d = d.withColumns(raws)
    d = d.withColumns({f"_ci_{n}": F.transform(F.split(F.col(f"_cf_{n}"), ","), _item_parser(lo, hi))
                       for n, lo, hi in FIELDS})
    oks = [F.coalesce(F.forall(f"_ci_{n}", _item_check(lo, hi)), F.lit(False)) for n, lo, hi in FIELDS]
    valid = F.size("_cp") == 5
    for ok in oks:
        valid = valid & ok
    d = d.withColumn("_cv", valid)
    vals = {n: F.when(F.col("_cv"), F.array_sort(F.array_distinct(F.flatten(F.transform(
        f"_ci_{n}", lambda p: F.sequence(p["a"], p["b"], p["step"])))))) for n, _, _ in FIELDS}
    d = d.withColumns({f"_cv_{n}": v for n, v in vals.items()})
    # minute-of-day offsets of every fire in a matching day (hours x minutes)
    day_minutes = F.flatten(F.transform("_cv_hour", lambda h: F.transform("_cv_minute", lambda m: h * 60 + m)))
    cron = F.struct(*[F.col(f"_cv_{n}").alias(n) for n in vals],
                    day_minutes.alias("day_minutes"),
                    F.exists("_ci_dom", lambda p: p["star"]).alias("dom_star"),
                    F.exists("_ci_dow", lambda p: p["star"]).alias("dow_star"),
                    F.col("_cv").alias("valid"))
    drop = (["_cp", "_cv"] + [f"_cf_{n}" for n, _, _ in FIELDS] + [f"_ci_{n}" for n, _, _ in FIELDS]
            + [f"_cv_{n}" for n, _, _ in FIELDS])
    return d.withColumn(out, cron).drop(*drop)


def day_matches(cron: Column, day: Column) -> Column:
    """Whether a local calendar day can fire."""
    dom_ok = F.array_contains(cron["dom"], F.dayofmonth(day))
    dow_ok = F.array_contains(cron["dow"], F.dayofweek(day) - 1)
    month_ok = F.array_contains(cron["month"], F.month(day))
    either_star = cron["dom_star"] | cron["dow_star"]
    return month_ok & F.when(either_star, dom_ok & dow_ok).otherwise(dom_ok | dow_ok)
