"""Schedule queries: one cron template per customer, child runs = job runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.operators import schedule as S
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views

# Fixed values of the queries: the calendar window and the evaluation clock.
CAL_START = "2024-02-27 00:00:00"
CAL_END = "2024-03-08 00:00:00"
NOW = "2024-03-07 12:00:00"
# Windows in which clocks change: New York 10 March and Berlin 31 March 2024; Berlin 27 October and New York
# 3 November 2024; and, where the runs are, Berlin 26 March and New York 2 April 1995.
SPRING = ("2024-03-09 00:00:00", "2024-04-01 12:00:00")
AUTUMN = ("2024-10-26 00:00:00", "2024-11-04 12:00:00")
PAST = ("1995-03-25 00:00:00", "1995-04-03 00:00:00")
TS_FMT = "yyyy-MM-dd HH:mm:ss"
DUCK_TS = "%Y-%m-%d %H:%M:%S"


# ----------------------------------------------------- DuckDB cron parser
# The grammar once more, by hand: bounds of the five fields, an item, the names.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 6))
ITEM = "([*]|[?]|[0-9]+|[0-9]+-[0-9]+)(/[0-9]+)?"
MONTH_NAMES = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DOW_NAMES = "SUN MON TUE WED THU FRI SAT".split()


def _duck_field(f: str, lo: int, hi: int) -> str:
    item = (f"struct_pack(ok := regexp_full_match(it, '{ITEM}'), "
            f"a := CASE WHEN regexp_extract(it, '^([^/]*)', 1) IN ('*', '?') THEN {lo} "
            f"ELSE TRY_CAST(regexp_extract(regexp_extract(it, '^([^/]*)', 1), '^([0-9]+)', 1) AS INTEGER) END, "
            f"b := CASE WHEN regexp_extract(it, '^([^/]*)', 1) IN ('*', '?') THEN {hi} "
            f"WHEN contains(regexp_extract(it, '^([^/]*)', 1), '-') THEN "
            f"TRY_CAST(regexp_extract(regexp_extract(it, '^([^/]*)', 1), '-([0-9]+)$', 1) AS INTEGER) "
            f"WHEN regexp_extract(it, '/([0-9]+)$', 1) <> '' THEN {hi} "
            f"ELSE TRY_CAST(regexp_extract(regexp_extract(it, '^([^/]*)', 1), '^([0-9]+)', 1) AS INTEGER) END, "
            f"step := CASE WHEN regexp_extract(it, '/([0-9]+)$', 1) = '' THEN 1 "
            f"ELSE TRY_CAST(regexp_extract(it, '/([0-9]+)$', 1) AS INTEGER) END, "
            f"star := regexp_extract(it, '^([^/]*)', 1) IN ('*', '?') AND "
            f"(regexp_extract(it, '/([0-9]+)$', 1) = '' OR TRY_CAST(regexp_extract(it, '/([0-9]+)$', 1) AS INTEGER) = 1))")
    return f"list_transform(string_split({f}, ','), lambda it: {item})"


def _duck_names(f: str, names, first: int) -> str:
    out = f"upper({f})"
    for i, n in enumerate(names):
        out = f"regexp_replace({out}, '\\b{n}\\b', '{first + i}', 'g')"
    return out


def _duck_parsed_templates() -> str:
    parts = "regexp_split_to_array(trim(schedule), '\\s+')"
    fields = []
    for i, (name, lo, hi) in enumerate(FIELDS):
        raw = f"{parts}[{i + 1}]"
        if name == "month":
            raw = _duck_names(raw, MONTH_NAMES, 1)
        elif name == "dow":
            raw = _duck_names(raw, DOW_NAMES, 0)
        fields.append(f"{_duck_field(raw, lo, hi)} AS p_{name}")
    ok = " AND ".join(
        f"len(p_{n}) > 0 AND list_bool_and(list_transform(p_{n}, lambda p: coalesce(p.ok AND p.a >= {lo} "
        f"AND p.b <= {hi} AND p.a <= p.b AND p.step > 0, false)))" for n, lo, hi in FIELDS)
    vals = ", ".join(
        f"CASE WHEN valid THEN list_sort(list_distinct(flatten(list_transform(p_{n}, "
        f"lambda p: range(p.a, p.b + 1, p.step))))) END AS v_{n}" for n, _, _ in FIELDS)
    return f"""
  pt0 AS (SELECT *, coalesce(nullif(time_zone, ''), 'UTC') AS zone, len({parts}) = 5 AS n_ok,
            {', '.join(fields)} FROM cron_templates),
  pt1 AS (SELECT *, coalesce(n_ok AND {ok}, false) AS cron_ok,
            zone IN (SELECT name FROM pg_timezone_names()) AS zone_ok FROM pt0),
  pt AS (SELECT *, cron_ok AND zone_ok AS valid, list_bool_or(list_transform(p_dom, lambda p: p.star)) AS dom_star,
           list_bool_or(list_transform(p_dow, lambda p: p.star)) AS dow_star,
           CASE WHEN NOT cron_ok THEN 'bad_cron' WHEN NOT zone_ok THEN 'bad_zone' END AS reject_reason FROM pt1),
  ptv AS (SELECT namespace, template, zone, suspend, created, last_schedule_time, starting_deadline_s, concurrency_policy, {vals}, dom_star, dow_star
          FROM pt WHERE valid)"""


def _duck_day_ok(day: str) -> str:
    dom_ok = f"list_contains(v_dom, dayofmonth({day}))"
    dow_ok = f"list_contains(v_dow, dayofweek({day}))"
    return (f"list_contains(v_month, month({day})) AND CASE WHEN dom_star OR dow_star "
            f"THEN {dom_ok} AND {dow_ok} ELSE {dom_ok} OR {dow_ok} END")


def _duck_with(body: str, ctes: str = "") -> str:
    head = with_views("", "cron_templates", "job_runs").rstrip()
    return f"{head},{_duck_parsed_templates()}{ctes}\n{body}"


_CAL = f""",
  cd AS (SELECT namespace, template, zone, v_hour, v_minute, CAST(d AS DATE) AS day FROM ptv,
           unnest(generate_series(CAST(TIMESTAMP '{CAL_START}' AS DATE) - 1, CAST(TIMESTAMP '{CAL_END}' AS DATE) + 1,
           INTERVAL 1 DAY)) AS g(d) WHERE NOT coalesce(suspend, false)),
  cdf AS (SELECT cd.* FROM cd JOIN ptv USING (namespace, template) WHERE {_duck_day_ok('cd.day')}),
  ch AS (SELECT namespace, template, zone, day, unnest(v_hour) AS h, v_minute FROM cdf),
  cm AS (SELECT namespace, template, zone, day, h, unnest(v_minute) AS m FROM ch),
  cal AS (SELECT namespace, template, timezone('UTC', timezone(zone, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS BIGINT))
            + to_minutes(CAST(m AS BIGINT)))) AS fire_ts FROM cm),
  fires AS (SELECT * FROM cal WHERE fire_ts >= TIMESTAMP '{CAL_START}' AND fire_ts < TIMESTAMP '{CAL_END}')"""

# Every minute from each template's last fire on, expanded in full.
_DUE = f""",
  dd AS (SELECT namespace, template, CAST(d AS DATE) AS day FROM ptv,
           unnest(generate_series(CAST(coalesce(last_schedule_time, created) AS DATE) - 1,
           CAST(TIMESTAMP '{NOW}' AS DATE) + 1, INTERVAL 1 DAY)) AS g(d) WHERE NOT coalesce(suspend, false)),
  ddf AS (SELECT namespace, template, zone, day, v_hour, v_minute FROM dd JOIN ptv USING (namespace, template)
          WHERE {_duck_day_ok('dd.day')}),
  dh AS (SELECT namespace, template, zone, day, unnest(v_hour) AS h, v_minute FROM ddf),
  dm AS (SELECT namespace, template, zone, day, h, unnest(v_minute) AS m FROM dh),
  df AS (SELECT namespace, template, timezone('UTC', timezone(zone, CAST(day AS TIMESTAMP)
           + to_hours(CAST(h AS BIGINT)) + to_minutes(CAST(m AS BIGINT)))) AS fire_ts FROM dm),
  due AS (SELECT namespace, template, max(f.fire_ts) AS due_ts, any_value(t.starting_deadline_s) AS dl
          FROM df f JOIN ptv t USING (namespace, template)
          WHERE f.fire_ts > coalesce(t.last_schedule_time, t.created) AND f.fire_ts <= TIMESTAMP '{NOW}'
          GROUP BY namespace, template),
  due_ok AS (SELECT namespace, template, due_ts FROM due
             WHERE NOT coalesce(epoch(TIMESTAMP '{NOW}') - epoch(due_ts) > dl, false))"""

_DECIDE = """,
  act AS (SELECT namespace, template, count(*) AS n_active FROM job_runs WHERE phase NOT IN ('Succeeded', 'Failed') GROUP BY 1, 2),
  dec AS (SELECT d.namespace, d.template, d.due_ts, coalesce(nullif(t.concurrency_policy, ''), 'Forbid') AS policy,
            coalesce(a.n_active, 0) AS n_active FROM due_ok d JOIN cron_templates t USING (namespace, template)
            LEFT JOIN act a USING (namespace, template)),
  decision AS (SELECT *, CASE WHEN n_active = 0 OR policy = 'Allow' THEN 'run' WHEN policy = 'Forbid' THEN 'skip'
                 ELSE 'run' END AS action,
               CAST(CASE WHEN policy = 'Replace' AND n_active > 0 THEN n_active ELSE 0 END AS BIGINT) AS n_replaced
               FROM dec)"""

_NEXT = f""",
  nb AS (SELECT namespace, template, zone, v_hour, v_minute, timezone(zone, TIMESTAMPTZ '{NOW}+00') AS local_now FROM ptv),
  nd AS (SELECT nb.*, CAST(d AS DATE) AS day FROM nb,
           unnest(generate_series(CAST(local_now AS DATE), CAST(local_now AS DATE) + 3300,
           INTERVAL 1 DAY)) AS g(d)),
  ndf AS (SELECT nd.* FROM nd JOIN ptv USING (namespace, template) WHERE {_duck_day_ok('nd.day')}),
  later AS (SELECT namespace, template, any_value(zone) AS zone, min(day) AS day, any_value(v_hour) AS v_hour,
              any_value(v_minute) AS v_minute FROM ndf WHERE day > CAST(local_now AS DATE) GROUP BY namespace, template),
  cand AS (SELECT namespace, template, zone, CAST(day AS TIMESTAMP) + to_hours(CAST(list_min(v_hour) AS BIGINT))
             + to_minutes(CAST(list_min(v_minute) AS BIGINT)) AS lf FROM later
           UNION ALL
           SELECT namespace, template, zone, lf FROM (
             SELECT namespace, template, zone, local_now, CAST(day AS TIMESTAMP) + to_hours(CAST(h AS BIGINT))
               + to_minutes(CAST(m AS BIGINT)) AS lf
             FROM (SELECT namespace, template, zone, local_now, day, h, unnest(v_minute) AS m
                   FROM (SELECT namespace, template, zone, local_now, day, unnest(v_hour) AS h, v_minute FROM ndf
                         WHERE day = CAST(local_now AS DATE))))
           WHERE lf > local_now),
  nxt AS (SELECT p.namespace, p.template, min(timezone('UTC', timezone(c.zone, c.lf))) AS next_ts FROM ptv p
          LEFT JOIN cand c ON c.namespace = p.namespace AND c.template = p.template
           AND timezone('UTC', timezone(c.zone, c.lf)) > TIMESTAMP '{NOW}' GROUP BY p.namespace, p.template)"""


def _fmt(c):
    return F.date_format(c, TS_FMT)


def _templates(spark, sf):
    return V.cron_templates(spark, sf)


@register("schedule_rejects", _duck_with("""
  SELECT namespace, template, schedule, time_zone, reject_reason FROM pt WHERE reject_reason IS NOT NULL"""))
def schedule_rejects(spark, sf):
    return S.schedule_rejects(_templates(spark, sf))


@register("fire_calendar", _duck_with(f"""
  SELECT namespace, template, strftime(fire_ts, '{DUCK_TS}') AS fire_ts FROM fires""", _CAL))
def fire_calendar(spark, sf):
    return S.fire_calendar(_templates(spark, sf), CAL_START, CAL_END, shown=_fmt)


def _instants(start: str, end: str) -> str:
    """Fires by their definition: every minute's instant, read off each zone's clock, against every field.
    Distinct (schedule, zone) pairs first; the templates' own are joined to them."""
    return f""",
  clocks AS (SELECT v_month, v_dom, v_dow, v_hour, v_minute, dom_star, dow_star, zone, list(struct_pack(namespace, template)) AS of
             FROM ptv WHERE NOT coalesce(suspend, false) GROUP BY ALL),
  ticks AS (SELECT zone, t, timezone(zone, t) AS wall FROM (SELECT DISTINCT zone FROM clocks),
              (SELECT unnest(generate_series(TIMESTAMPTZ '{start}+00', TIMESTAMPTZ '{end}+00' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t)),
  hits AS (SELECT of, t FROM clocks JOIN ticks USING (zone)
           WHERE list_contains(v_minute, minute(wall)) AND list_contains(v_hour, hour(wall)) AND {_duck_day_ok('wall')}),
  fires AS (SELECT x.namespace, x.template, timezone('UTC', t) AS fire_ts FROM (SELECT unnest(of) AS x, t FROM hits))"""


_FIRES_SQL = f"SELECT namespace, template, strftime(fire_ts, '{DUCK_TS}') AS fire_ts FROM fires"


@register("fire_calendar_spring", _duck_with(_FIRES_SQL, _instants(*SPRING)))
def fire_calendar_spring(spark, sf):
    """Fires over the weeks in which clocks go forward: skipped minutes do not fire."""
    return S.fire_calendar(_templates(spark, sf), *SPRING, shown=_fmt)


@register("fire_calendar_autumn", _duck_with(_FIRES_SQL, _instants(*AUTUMN)))
def fire_calendar_autumn(spark, sf):
    """Fires over the weeks in which clocks go back: repeated minutes fire twice."""
    return S.fire_calendar(_templates(spark, sf), *AUTUMN, shown=_fmt)


@register("fire_history", _duck_with(f"""
  SELECT f.namespace, f.template, strftime(f.fire_ts, '{DUCK_TS}') AS fire_ts, policy, n_active,
    CASE WHEN n_active > 0 AND policy = 'Forbid' THEN 'skip' ELSE 'run' END AS action,
    CASE WHEN policy = 'Replace' THEN n_active ELSE 0 END AS n_replaced
  FROM (SELECT f.namespace, f.template, f.fire_ts, any_value(coalesce(nullif(t.concurrency_policy, ''), 'Forbid')) AS policy,
          count(j.name) AS n_active
        FROM fires f JOIN cron_templates t USING (namespace, template)
        LEFT JOIN job_runs j ON j.namespace = f.namespace AND j.template = f.template AND j.created <= f.fire_ts
          AND (j.phase NOT IN ('Succeeded', 'Failed') OR j.completion_time > f.fire_ts)
        GROUP BY ALL) f""", _instants(*PAST)))
def fire_history(spark, sf):
    """Every fire of ten days, with the template's runs that were open then, as its policy takes it."""
    fires = S.fire_calendar(_templates(spark, sf), *PAST)
    d = S.fire_history(fires, _templates(spark, sf), V.job_runs(spark, sf))
    return d.select(*S.KEY, _fmt("fire_ts").alias("fire_ts"), "policy", "n_active", "action", "n_replaced")


def _due(spark, sf):
    return S.due_fire(_templates(spark, sf), NOW)


@register("due_fire", _duck_with(f"""
  SELECT namespace, template, strftime(due_ts, '{DUCK_TS}') AS due_ts FROM due_ok""", _DUE))
def due_fire(spark, sf):
    return _due(spark, sf).select(*S.KEY, _fmt("due_ts").alias("due_ts"))


@register("next_fire", _duck_with(f"""
  SELECT namespace, template, strftime(next_ts, '{DUCK_TS}') AS next_ts FROM nxt""", _NEXT))
def next_fire(spark, sf):
    n = S.next_fire(_templates(spark, sf), NOW)
    return n.select(*S.KEY, _fmt("next_ts").alias("next_ts"))


def _decisions(spark, sf):
    return S.fire_concurrency(_due(spark, sf), _templates(spark, sf), V.job_runs(spark, sf))


@register("fire_concurrency", _duck_with(f"""
  SELECT namespace, template, strftime(due_ts, '{DUCK_TS}') AS due_ts, policy, n_active, action, n_replaced FROM decision""",
  _DUE + _DECIDE))
def fire_concurrency(spark, sf):
    d = _decisions(spark, sf)
    return d.select(*S.KEY, _fmt("due_ts").alias("due_ts"), "policy", "n_active", "action", "n_replaced")


@register("replaced_runs", _duck_with("""
  SELECT j.namespace, j.template, j.name FROM job_runs j
  WHERE j.phase NOT IN ('Succeeded', 'Failed') AND (j.namespace, j.template) IN (SELECT (namespace, template) FROM decision WHERE n_replaced > 0)""",
  _DUE + _DECIDE))
def replaced_runs(spark, sf):
    return S.replaced_runs(_decisions(spark, sf), V.job_runs(spark, sf))


@register("child_runs", _duck_with(f"""
  SELECT DISTINCT namespace, template, strftime(due_ts, '{DUCK_TS}') AS due_ts,
    template || '-' || CAST(CAST(epoch(due_ts) AS BIGINT) AS VARCHAR) AS child
  FROM decision WHERE action = 'run'""", _DUE + _DECIDE))
def child_runs(spark, sf):
    c = S.child_runs(_decisions(spark, sf))
    return c.select(*S.KEY, _fmt("due_ts").alias("due_ts"), "child")


@register("active_runs", with_views("""
  SELECT namespace, template, name FROM job_runs WHERE phase NOT IN ('Succeeded', 'Failed')""", "job_runs"))
def active_runs(spark, sf):
    return S.active_runs(V.job_runs(spark, sf))


@register("template_status", _duck_with(f"""
  SELECT p.namespace, p.template,
    CASE WHEN after > 0 THEN 'Running' ELSE 'Pending' END AS phase, CAST(after AS BIGINT) AS n_active,
    strftime(CASE WHEN action = 'run' THEN due_ts ELSE last_schedule_time END, '{DUCK_TS}') AS last_schedule_ts,
    strftime(next_ts, '{DUCK_TS}') AS next_ts
  FROM (SELECT p.namespace, p.template, p.last_schedule_time, d.action, d.due_ts, x.next_ts,
          CASE WHEN coalesce(p.suspend, false) THEN 0
            WHEN d.action = 'run' THEN CASE WHEN d.policy = 'Replace' THEN 0 ELSE coalesce(a.n_active, 0) END + 1
            ELSE coalesce(a.n_active, 0) END AS after
        FROM ptv p LEFT JOIN decision d USING (namespace, template) LEFT JOIN act a USING (namespace, template)
        LEFT JOIN nxt x USING (namespace, template)) p""", _DUE + _DECIDE + _NEXT))
def template_status(spark, sf):
    t = _templates(spark, sf)
    s = S.template_status(t, _decisions(spark, sf), V.job_runs(spark, sf), S.next_fire(t, NOW))
    return s.select(*S.KEY, "phase", "n_active", _fmt("last_schedule_ts").alias("last_schedule_ts"),
                    _fmt("next_ts").alias("next_ts"))
