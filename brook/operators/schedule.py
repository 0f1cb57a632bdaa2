"""Schedule analytics over a table of cron templates and their child runs:
fire calendar, due fire, next fire, concurrency decisions, child runs and
template status.  Fire times are computed in each template's zone (default
UTC) and returned as UTC instants.

A template fires at every instant whose local time matches its expression: a
wall-clock time that a clock change skips does not fire that day, one that it
repeats fires twice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brook.functions.cron import day_matches, with_parsed_cron
from brook.functions.zones import day_instants, zone_parts

TERMINAL = ["Succeeded", "Failed"]
# A template is named within its namespace; so are its child runs.
KEY = ["namespace", "template"]


def valid_zones() -> list[str]:
    """Zone names that the session's own conversions know: the JVM's list."""
    spark = SparkSession.active()
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def valid_zone(zone: Column) -> Column:
    """Membership in the zone list; one constant-folded literal array."""
    return F.array_contains(F.split(F.lit(",".join(valid_zones())), ","), zone)


# Fixed value: how far ahead the next fire is searched.  The longest gap that
# five fields can make is eight years (29 February across 2100), so nine years
# find every fire there is.
NEXT_FIRE_LOOKAHEAD_DAYS = 9 * 366
NEAR_DAYS = 62
# Fixed value: matching days looked at beyond the first, in case a clock change
# skips all fires of one.
MORE_DAYS = 2


def _zone(col="time_zone") -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("UTC"))


def clocks(templates: DataFrame) -> DataFrame:
    """The distinct (schedule, zone name) pairs of the templates, with ``cron``
    (parsed fields), ``zone`` and ``reject_reason``: what a template fires
    depends on its pair alone, and templates share a handful of them."""
    pairs = templates.select("schedule", _zone().alias("zone_name")).distinct()
    # A one-row explode: a filter on what is parsed would else be pushed below
    # the distinct, and every template be parsed.
    pairs = pairs.select(F.explode(F.array(F.struct("schedule", "zone_name"))).alias("_pair")).select("_pair.*")
    pairs = with_parsed_cron(pairs, "schedule", "cron")
    pairs = pairs.withColumn("_zone_ok", valid_zone(F.col("zone_name")))
    reason = F.when(~F.coalesce(F.col("cron.valid"), F.lit(False)), "bad_cron").when(~F.col("_zone_ok"), "bad_zone")
    # An invalid zone must never reach a conversion, even when Catalyst
    # evaluates the conversion above the filter that drops the row.
    return pairs.select("schedule", "zone_name", "cron", F.when(F.col("_zone_ok"), F.col("zone_name")).otherwise(F.lit("UTC")).alias("zone"),
                        reason.alias("reject_reason"))


def _with_clock(templates: DataFrame, found: DataFrame) -> DataFrame:
    """``templates`` next to the row of ``found`` for their schedule and zone
    name; those without one are left out."""
    f = found.withColumnsRenamed({"schedule": "_schedule", "zone_name": "_zone_name"})
    same = F.col("schedule").eqNullSafe(F.col("_schedule")) & (_zone() == F.col("_zone_name"))
    return templates.join(f, same).drop("_schedule", "_zone_name")


def parse_templates(templates: DataFrame) -> DataFrame:
    """Adds ``cron`` (parsed fields), ``zone`` and ``reject_reason``."""
    return _with_clock(templates, clocks(templates))


def schedule_rejects(templates: DataFrame) -> DataFrame:
    p = parse_templates(templates)
    return p.filter(F.col("reject_reason").isNotNull()).select(*KEY, "schedule", "time_zone", "reject_reason")


def _fires_of(day: Column) -> Column:
    """Instants (seconds) at which a row's expression fires on a local day."""
    return day_instants(F.col("cron.day_minutes"), day, zone_parts(F.col("zone"), day))


# Fixed value: templates of one task of the calendar.  A template fires up to
# 1,440 times a day, so tasks are bounded by templates, not by their bytes.
TEMPLATES_PER_TASK = 5_000


# Fixed value: days of all clocks of a calendar that every task is sent as a whole.
SENT_DAYS = 10_000


def fire_calendar(templates: DataFrame, start: str, end: str, include_suspended: bool = False, shown=None) -> DataFrame:
    """Every fire time in [start, end) of each valid template (suspended
    templates give none).  The calendar is made once for each distinct
    (schedule, zone): days are exploded and filtered, then their fires; the
    templates are joined to it last, to all fires of a day at once.  ``shown``
    makes something else of a fire time (its text, say), once for each of the
    calendar."""
    t = templates if include_suspended else templates.filter(~F.coalesce(F.col("suspend"), F.lit(False)))
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    days = clocks(t).filter(F.col("reject_reason").isNull()).withColumn(
        "day", F.explode(F.sequence(F.date_sub(F.to_date(s), 1), F.date_add(F.to_date(e), 1))))
    at = F.timestamp_seconds("t")
    fires = (days.filter(day_matches(F.col("cron"), F.col("day")))
                 .select("schedule", "zone_name", "day", F.explode(_fires_of(F.col("day"))).alias("t"))
                 .filter((at >= s) & (at < e))
                 .groupBy("schedule", "zone_name", "day").agg(F.collect_list(shown(at) if shown else at).alias("fires")))
    # Templates are dealt evenly over tasks: most fires may be those of one
    # schedule, and a small table may come from one file.
    seen = t.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("schedule", _zone()))).first()
    tasks = t.sparkSession.sparkContext.defaultParallelism + -(-seen[0] // TEMPLATES_PER_TASK)
    if seen[1] * ((date.fromisoformat(end[:10]) - date.fromisoformat(start[:10])).days + 3) <= SENT_DAYS:
        fires = F.broadcast(fires)
    return _with_clock(t.select(*KEY, "schedule", "time_zone").repartition(tasks), fires).select(*KEY, F.explode("fires").alias("fire_ts"))


def _stored_last(templates: DataFrame) -> Column:
    """The last schedule time on record; NULL where the column is absent."""
    if "last_schedule_time" in templates.columns:
        return F.col("last_schedule_time")
    return F.lit(None).cast("timestamp")


def due_fire(templates: DataFrame, now: str) -> DataFrame:
    """Latest fire with last < fire <= now (last = last schedule time, else
    creation); none when it is older than the starting deadline.  Suspended
    and invalid templates have none.

    Each template is searched backwards from ``now`` to its own last fire, in
    its own row: the last matching days up to tomorrow (which only counts where
    a clock change ends a day early).  The search has no window, and nothing is
    expanded or shuffled."""
    n = F.lit(now).cast("timestamp")
    p = parse_templates(templates).filter(F.col("reject_reason").isNull() & ~F.coalesce(F.col("suspend"), F.lit(False)))
    p = p.withColumn("_last", F.coalesce(_stored_last(p), F.col("created"))).filter(F.col("_last") < n)
    # One-row explodes: filters above would else be pushed under these columns,
    # and each pushed copy would search again.
    today = F.to_date(F.from_utc_timestamp(n, F.col("zone")))
    first = F.date_sub(F.to_date(F.from_utc_timestamp("_last", F.col("zone"))), 1)
    p = p.withColumn("_at", F.explode(F.array(F.struct(F.date_add(today, 1).alias("tomorrow"), F.greatest(first, F.date_sub(today, NEAR_DAYS)).alias("near"),
                                                       first.alias("first")))))

    def latest(a: Column, b: Column, days: int) -> Column:
        matching = F.filter(F.sequence(a, b), lambda d: day_matches(F.col("cron"), d))
        fires = F.transform(F.slice(F.reverse(matching), 1, days), lambda d: F.array_max(F.filter(_fires_of(d), lambda t: t <= F.unix_seconds(n))))
        return F.when(a <= b, F.array_max(fires))

    # Most schedules match within two months: only the others look at all days.
    due = F.coalesce(latest(F.col("_at.near"), F.col("_at.tomorrow"), 3 + MORE_DAYS),
                     latest(F.col("_at.first"), F.date_sub("_at.near", 1), 1 + MORE_DAYS))
    d = p.select(*KEY, "_last", "starting_deadline_s", F.explode(F.array(F.timestamp_seconds(due))).alias("due_ts")).filter(
        F.col("due_ts") > F.col("_last"))
    late = (F.unix_seconds(n) - F.unix_seconds("due_ts")) > F.col("starting_deadline_s")
    return d.filter(~F.coalesce(late, F.lit(False))).select(*KEY, "due_ts")


def next_fire(templates: DataFrame, now: str, lookahead_days: int = NEXT_FIRE_LOOKAHEAD_DAYS) -> DataFrame:
    """Earliest fire strictly after ``now`` per valid template; NULL when the
    expression can never fire (e.g. 31 February).

    The search is made once for each distinct (schedule, zone), in its row, and
    the templates are joined to it."""
    n = F.lit(now).cast("timestamp")
    today = F.to_date(F.from_utc_timestamp(n, F.col("zone")))

    def earliest(a: int, b: int, days: int) -> Column:
        matching = F.filter(F.sequence(F.date_add(today, a), F.date_add(today, b)), lambda d: day_matches(F.col("cron"), d))
        return F.array_min(F.transform(F.slice(matching, 1, days), lambda d: F.array_min(F.filter(_fires_of(d), lambda t: t > F.unix_seconds(n)))))

    # Almost every schedule fires within two months, so only the rare yearly /
    # impossible ones pay for the long scan.
    found = F.coalesce(earliest(0, NEAR_DAYS, 2 + MORE_DAYS), earliest(NEAR_DAYS + 1, lookahead_days, 1 + MORE_DAYS))
    best = clocks(templates).filter(F.col("reject_reason").isNull()).select("schedule", "zone_name", F.timestamp_seconds(found).alias("next_ts"))
    return _with_clock(templates.select(*KEY, "schedule", "time_zone"), best).select(*KEY, "next_ts")


def active_runs(runs: DataFrame) -> DataFrame:
    """Unfinished child runs (namespace, template, name)."""
    return runs.filter(~F.col("phase").isin(*TERMINAL)).select(*KEY, "name")


def fire_concurrency(due: DataFrame, templates: DataFrame, runs: DataFrame) -> DataFrame:
    """Allow -> run; Forbid (default) -> skip while a child is unfinished;
    Replace -> run and replace the unfinished children (their count here,
    the runs themselves in ``replaced_runs``)."""
    n_active = active_runs(runs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_active"))
    pol = F.coalesce(F.nullif(F.col("concurrency_policy"), F.lit("")), F.lit("Forbid"))
    d = (due.join(templates.select(*KEY, pol.alias("policy")), KEY)
            .join(n_active, KEY, "left").fillna(0, ["n_active"]))
    action = F.when((F.col("n_active") == 0) | (F.col("policy") == "Allow"), "run") \
              .when(F.col("policy") == "Forbid", "skip").otherwise("run")
    replaced = F.when((F.col("policy") == "Replace") & (F.col("n_active") > 0), F.col("n_active")).otherwise(F.lit(0))
    return d.select(*KEY, "due_ts", "policy", "n_active", action.alias("action"),
                    replaced.cast("bigint").alias("n_replaced"))


# Fixed value: width of the time bins in which fires meet runs, in microseconds.
BIN = 86_400_000_000


def _decision(policy: Column, n_active: Column) -> tuple[Column, Column]:
    """What a policy makes of a fire, and how many runs the fire replaces."""
    action = F.when((n_active > 0) & (policy == "Forbid"), "skip").otherwise("run")
    return action, F.when(policy == "Replace", n_active).otherwise(F.lit(0)).cast("bigint")


def fire_history(fires: DataFrame, templates: DataFrame, runs: DataFrame) -> DataFrame:
    """Every fire (namespace, template, ``fire_ts``) with the runs of its
    template that were unfinished then (created by then, not yet completed; a
    finished run without a completion ended as it was created), and what the
    template's policy makes of it: Allow, Forbid (default) or Replace.

    An interval overlap without pairs of intervals: creations and completions
    become +1 and -1, summed by instant before any shuffle.  Per template and
    ``BIN`` of time they are summed again, and a running sum over the bins says
    how many runs were open as a bin began.  That sum, the instants of the bin
    and its fires then make one sequence, whose running sum is what each fire
    meets.  So a fire is shuffled once, with its bin, and a template with a
    third of all runs costs its instants, bin by bin, not its runs times its
    fires."""
    policy = F.coalesce(F.nullif(F.col("concurrency_policy"), F.lit("")), F.lit("Forbid"))
    done = F.col("phase").isin(*TERMINAL)
    ends = F.when(done, F.coalesce("completion_time", "created")).otherwise(F.col("completion_time"))
    ends = F.when(ends < F.col("created"), F.col("created")).otherwise(ends)
    at = lambda c: F.floor(F.unix_micros(c) / F.lit(BIN))
    changes = F.array(F.struct(F.col("created").alias("ts"), F.lit(1).alias("change")), F.struct(ends.alias("ts"), F.lit(-1).alias("change")))
    steps = (runs.filter("created IS NOT NULL").select(*KEY, F.explode(changes).alias("c")).filter("c.ts IS NOT NULL")
             .select(*KEY, at("c.ts").alias("bin"), F.col("c.ts").alias("ts"), F.col("c.change").cast("bigint").alias("change"), F.lit(0).alias("asked")))
    asked = fires.filter("fire_ts IS NOT NULL").select(
        *KEY, at("fire_ts").alias("bin"), F.col("fire_ts").alias("ts"), F.lit(0).cast("bigint").alias("change"), F.lit(1).alias("asked"))
    both = asked.unionByName(steps)
    bins = both.groupBy(*KEY, "bin").agg(F.sum("change").alias("change"), F.max("asked").alias("asked"))
    before = Window.partitionBy(*KEY).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    opened = bins.withColumn("open", F.coalesce(F.sum("change").over(before), F.lit(0))).filter("asked = 1")
    policies = templates.select(*KEY, policy.alias("policy")).groupBy(*KEY).agg(F.collect_list("policy").alias("policies"))
    # What a bin begins with is the first of its sequence, as NULL sorts; the
    # changes of an instant come before its fire, and that counts once.
    first = opened.join(policies, KEY).select(*KEY, "bin", F.lit(None).cast("timestamp").alias("ts"), F.col("open").alias("change"),
                                              F.lit(0).alias("asked"), "policies")
    line = Window.partitionBy(*KEY, "bin").orderBy("ts", "asked")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    line = (both.withColumn("policies", F.lit(None).cast("array<string>")).unionByName(first)
            .withColumns({"n_active": F.sum("change").over(upto), "policies": F.first("policies", True).over(upto),
                          "again": F.lag("asked", 1, 0).over(line) * (F.lag("ts").over(line) == F.col("ts")).cast("int")}))
    d = line.filter("asked = 1 AND coalesce(again, 0) = 0").select(*KEY, F.col("ts").alias("fire_ts"), F.explode("policies").alias("policy"), "n_active")
    action, replaced = _decision(F.col("policy"), F.col("n_active"))
    return d.select(*KEY, "fire_ts", "policy", "n_active", action.alias("action"), replaced.alias("n_replaced"))


def replaced_runs(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    r = decisions.filter(F.col("n_replaced") > 0).select(*KEY)
    return active_runs(runs).join(r, KEY, "left_semi")


def child_runs(decisions: DataFrame) -> DataFrame:
    """``<template>-<unix seconds>``; the same fire twice is one run."""
    ran = decisions.filter(F.col("action") == "run")
    child = F.concat(F.col("template"), F.lit("-"), F.unix_seconds("due_ts").cast("string"))
    return ran.select(*KEY, "due_ts", child.alias("child")).dropDuplicates([*KEY, "due_ts"])


def template_status(templates: DataFrame, decisions: DataFrame, runs: DataFrame, next_fires: DataFrame) -> DataFrame:
    """Running if a child is unfinished after this pass, else Pending; last
    schedule time (the stored one where this pass ran nothing); next fire.
    Suspended templates only refresh the next fire."""
    p = parse_templates(templates).filter(F.col("reject_reason").isNull())
    n_active = active_runs(runs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_active"))
    susp = F.coalesce(F.col("suspend"), F.lit(False))
    j = (p.select(*KEY, susp.alias("suspended"), _stored_last(p).alias("stored_ts"))
          .join(decisions.select(*KEY, "due_ts", "policy", "action"), KEY, "left")
          .join(n_active, KEY, "left").join(next_fires, KEY, "left")
          .fillna(0, ["n_active"]))
    ran = F.col("action") == "run"
    after = F.when(F.col("suspended"), F.lit(0)) \
             .when(ran, F.when(F.col("policy") == "Replace", F.lit(0)).otherwise(F.col("n_active")) + 1) \
             .otherwise(F.col("n_active"))
    return j.select(*KEY, F.when(after > 0, "Running").otherwise("Pending").alias("phase"),
                    after.cast("bigint").alias("n_active"),
                    F.when(ran, F.col("due_ts")).otherwise(F.col("stored_ts")).alias("last_schedule_ts"), "next_ts")
