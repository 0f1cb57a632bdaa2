"""Wall clocks as Spark expressions: which instants a local day's minutes are.

A local minute is one instant on an ordinary day, none where the clock skips
it, and two where the clock repeats it.  ``zone_parts`` finds the offsets that
hold around a day, and from when to when; ``day_instants`` lays minutes of the
day over them.  Both are row-local: no zone table is shipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a day, how far local time can be from UTC (with a
# change of the clock on top), and bounds beyond every instant.
DAY = 86_400
MARGIN = 16 * 3600
EVER = 1 << 60


def _offset(seconds: Column, zone: Column) -> Column:
    """Seconds that the zone is ahead of UTC at an instant."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)) - seconds


def _let(value: Column, of) -> Column:
    """``of(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), of), 0)


def midnight(day: Column) -> Column:
    return F.unix_date(day).cast("long") * DAY


def zone_parts(zone: Column, day: Column) -> Column:
    """``array<struct<offset, since, until>>`` (seconds) around a local day:
    one entry, or two where the clock changes then.  The minute of the change
    is searched only on such days.  Zones do not change twice in three days."""
    def part(offset, since, until):
        return F.struct(offset.cast("long").alias("offset"), since.cast("long").alias("since"), until.cast("long").alias("until"))

    def around(x):
        a = x["a"]
        change = F.array_min(F.filter(F.sequence(F.lit(1), F.lit((DAY + 2 * MARGIN) // 60)),
                                      lambda m: _offset(a + m * 60, zone) != x["first"]))
        return F.when(x["first"] == x["last"], F.array(part(x["first"], F.lit(-EVER), F.lit(EVER)))).otherwise(
            _let(a + change * 60, lambda t: F.array(part(x["first"], F.lit(-EVER), t), part(x["last"], t, F.lit(EVER)))))

    start = midnight(day) - MARGIN
    return _let(F.struct(start.alias("a"), _offset(start, zone).alias("first"), _offset(start + DAY + 2 * MARGIN, zone).alias("last")), around)


def day_instants(minutes: Column, day: Column, parts: Column) -> Column:
    """The instants (seconds, rising) whose local time is one of ``minutes``
    (of the day, rising) on ``day``."""
    return F.flatten(F.transform(parts, lambda p: F.filter(
        F.transform(minutes, lambda m: midnight(day) + m.cast("long") * 60 - p["offset"]),
        lambda t: (t >= p["since"]) & (t < p["until"]))))
