"""Views that give the driver's tables the shapes the feed jobs and the run
records have (see FIXTURES.md section 4).

Every view is a pure projection / filter / group of a driver table, so its
size grows with the table and Catalyst prunes what a query does not use.  The
same views are written as DuckDB SQL in ``oracle_views.py``; any change here
must be mirrored there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brook.session import ensure_utc, ship_package

# Fixed values shared with oracle_views.py.
BASE_DAY = "2024-01-01"
DAY_SPAN = 400
SCRAPED_AT = "2024-06-01T00:00:00+00:00"
AS_OF = "1999-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return c.cast("string")


def render_date_forms(day: Column, key: Column, junk: Column) -> Column:
    """Render a date in the five feed forms (+ junk) chosen by ``key % 6``;
    RFC-822 forms name their zone now and then."""
    zone = F.when(key % 36 == 9, " EST").when(key % 36 == 15, " PDT").otherwise(" +0000")
    ds = F.date_format(day, "yyyy-MM-dd")
    hh = F.lpad(_s(key % 24), 2, "0")
    form = key % 6
    return (F.when(form == 0, ds)
            .when(form == 1, F.concat(ds, F.lit("T"), hh, F.lit(":15:00Z")))
            .when(form == 2, F.concat(ds, F.lit("T"), hh, F.lit(":30:00+02:00")))
            .when(form == 3, F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" "), hh,
                                      F.lit(":45:00"), zone))
            .when(form == 4, F.date_format(day, "yyyy"))
            .otherwise(junk))


def true_date_of_forms(day: Column, key: Column) -> Column:
    form = key % 6
    return (F.when(form == 5, F.lit(None).cast("date"))
            .when(form == 4, F.trunc(day, "year"))
            # Five or seven hours behind: an evening there is the next day here.
            .when((key % 36 == 9) & (key % 24 >= 19) | (key % 36 == 15) & (key % 24 >= 17), F.date_add(day, 1))
            .otherwise(day))


# ---------------------------------------------------------------- articles
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-article rows (landing schema, all strings) from ``documents``."""
    d = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    day = F.date_add(F.lit(BASE_DAY).cast("date"), (doc_id % DAY_SPAN).cast("int"))
    return d.select(
        _s(doc_id).alias("id"),
        F.concat(F.lit("  "), F.upper("source")).alias("source"),
        F.when(doc_id % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("title"),
        F.concat(F.lit(" https://news.example.com/"), F.col("lang"), F.lit("/"), _s(doc_id),
                 F.lit(" ")).alias("link"),
        render_date_forms(day, doc_id, F.concat(F.lit("n/a "), _s(doc_id))).alias("published_at"),
        F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")).alias("summary"),
        F.concat(F.lit(" "), F.upper("lang")).alias("category"),
        F.lit(SCRAPED_AT).alias("_scraped_at"),
    )


# ----------------------------------------------------------- dated strings
def dated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    junk = F.when(key % 12 == 5, F.concat(F.lit("junk "), _s(key))) \
            .otherwise(F.date_format(day, "yyyyMMdd"))
    return o.select(
        key.alias("key"),
        render_date_forms(day, key, junk).alias("value"),
        true_date_of_forms(day, key).alias("true_date"),
    )


# ---------------------------------------------------------------- payloads
RSS_HEAD = ('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
            'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed ')
ATOM_HEAD = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Feed '
RDF_HEAD = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
            'xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
            '<channel><title>Feed ')


def _x(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit("&amp;"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetched payload per page: RSS, Atom, RDF or CSV text built around
    url-derived fields (``page_id % 6``); every 11th XML payload is cut short.
    Some feeds nest their items deeper, put another summary tag first, write
    markup into a description, or hold an item within an item."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    pid = F.col("page_id")
    sp = _s(pid)
    kind = pid % 6
    day = F.date_add(F.lit(BASE_DAY).cast("date"), (pid % DAY_SPAN).cast("int"))
    rfc = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 08:00:00 +0000"))
    iso_z = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:00:00Z"))
    iso_off = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T22:00:00-03:00"))
    url = F.col("url")
    deep = lambda tags: F.when(kind == 3, F.lit(tags)).otherwise(F.lit(""))
    rss = F.concat(
        F.lit(RSS_HEAD), sp, F.lit("</title>"),
        deep("<section><list>"),
        F.lit("<item><title>Item "), sp, F.lit(" a</title><link>"), _x(url), F.lit("</link>"),
        F.when(pid % 4 == 0, F.concat(F.lit("<summary>Early "), sp, F.lit("</summary>"))).otherwise(F.lit("")),
        F.lit("<description>&lt;b&gt;Story "), sp, F.lit("&lt;/b&gt; text</description>"),
        F.lit("<pubDate>"), rfc, F.lit("</pubDate><category>cat"), _s(pid % 7),
        F.lit("</category><category>second</category><guid isPermaLink=\"false\">guid-"), sp,
        F.lit("</guid></item>"),
        F.lit("<item><title>Item "), sp, F.lit(" b</title><link>"), _x(url), F.lit("#b</link>"),
        F.lit("<pubDate>"), rfc, F.lit("</pubDate><dc:creator>someone</dc:creator></item>"),
        F.lit("<item><description>orphan "), sp, F.lit("</description></item>"),
        deep("</list></section>"), F.lit("</channel></rss>"))
    atom = F.concat(
        F.lit(ATOM_HEAD), sp, F.lit("</title>"),
        F.lit("<entry><title>Entry "), sp, F.lit(" a</title><link rel=\"self\" href=\"http://self/"),
        sp, F.lit("\"/><link rel=\"alternate\" href=\""), _x(url), F.lit("\"/><id>urn:entry:"), sp,
        F.lit("</id><updated>"), iso_z, F.lit("</updated>"),
        F.when(pid % 4 == 3, F.concat(F.lit("<content>Full "), sp, F.lit("</content>"))).otherwise(F.lit("")),
        F.lit("<summary>Summary "), sp,
        F.lit("</summary><category term=\"topic"), _s(pid % 5), F.lit("\"/></entry>"),
        F.lit("<entry><title>Entry "), sp, F.lit(" b</title><link href=\""), _x(url),
        F.lit("?b=1\"/><published>"), iso_off, F.lit("</published><content type=\"html\">&lt;p&gt;Body "),
        sp, F.lit("&lt;/p&gt;</content></entry></feed>"))
    # Every other Atom payload writes its tags with a prefix.
    atom = F.when(pid % 4 == 1, F.regexp_replace(atom, "<(/?)([a-z])", "<$1atom:$2")).otherwise(atom)
    rdf = F.concat(
        F.lit(RDF_HEAD), sp, F.lit("</title></channel>"),
        F.lit("<item><title>Rdf "), sp, F.lit("</title><link>"), _x(url),
        F.lit("</link><description>Desc "), sp,
        F.when(pid % 4 == 0, F.lit(" <b>bold</b> tail")).otherwise(F.lit("")),
        F.lit("</description><dc:date>"), iso_z, F.lit("</dc:date>"),
        F.when(pid % 8 == 4, F.concat(F.lit("<item><title>Inner "), sp, F.lit("</title></item>"))).otherwise(F.lit("")),
        F.lit("</item></rdf:RDF>"))
    csv_a = F.concat(
        F.lit("Country, Year ,Value\n"),
        F.lit("Land "), sp, F.lit(","), _s(1990 + pid % 30), F.lit(",12\n"),
        F.lit("\"Land "), sp, F.lit(", North\","), _s(2000 + pid % 20), F.lit(",\n"))
    csv_b = F.concat(
        F.lit("title,link,date,description,type\r\n"),
        F.lit("Title "), sp, F.lit(",\""), url, F.lit("\","), F.date_format(day, "yyyy-MM-dd"),
        F.lit(",\"Line one\nline two of "), sp, F.lit("\",news\r\n"),
        F.lit(",\""), url, F.lit("/2\",,  ,\r\n"))
    body = (F.when(kind.isin(0, 3), rss).when(kind == 1, atom).when(kind == 4, rdf)
            .when(pid % 4 == 2, csv_a).otherwise(csv_b))
    broken = (pid % 11 == 0) & ~kind.isin(2, 5)
    body = F.when(broken, F.substring(body, 1, 120)).otherwise(body)
    fmt = F.when(kind.isin(0, 1, 3), F.lit("xml")).when(kind == 4, F.lit("XML")).otherwise(F.lit("csv"))
    source = F.when(pid % 10 == 7, F.lit(None).cast("string")).otherwise(F.concat(F.lit("feed"), _s(pid % 5)))
    return p.select(pid.alias("page_id"), url.alias("url"), fmt.alias("format"),
                    source.alias("source"), body.alias("body"), F.lit(SCRAPED_AT).alias("scraped_at"))


# ------------------------------------------------------------------ job runs
def _team(key: Column) -> Column:
    """The namespace of a run: names are numbered within it, so each name is
    there in all three."""
    return F.concat(F.lit("team-"), _s(key % 3))


def _in_team(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), _s(F.floor(key / 3)))


def named_runs(df: DataFrame, key: Column) -> DataFrame:
    """The runs of the status history that the keys name."""
    return df.select(_team(key).alias("namespace"), _in_team("run-", key).alias("run"))


def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Spark job run per order (spec + observed times)."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    created = F.col("o_orderdate").cast("timestamp")
    phase = (F.when(F.col("o_orderstatus") == "F", "Failed")
             .when(F.col("o_orderstatus") == "O", "Running")
             .when(F.col("o_orderstatus") == "P", "Succeeded"))
    prio = F.col("o_orderpriority")
    rate = (F.when(prio == "1-URGENT", "0.50").when(prio == "2-HIGH", "0.25")
            .when(prio == "3-MEDIUM", "0").when(prio == "4-NOT SPECIFIED", "")
            .otherwise("n/a"))
    start = created + F.make_interval(mins=(k % 120).cast("int"))
    end = F.when(phase.isin("Failed", "Succeeded"),
                 start + F.make_interval(mins=(F.col("o_totalprice").cast("bigint") % 600).cast("int")))
    ckpt_on = (k % 13 == 0)
    ckpt_uri = (F.when(k % 26 == 0, F.concat(F.lit("s3a://ckpt/job-"), _s(k)))
                .when(k % 39 == 0, F.concat(F.lit("gs://ckpt/job-"), _s(k)))
                .otherwise(F.lit("")))
    return o.select(
        _team(k).alias("namespace"),
        _in_team("job-", k).alias("name"),
        F.concat(F.lit("tmpl-"), _s(F.floor(c / 3))).alias("template"),
        created.alias("created"),
        phase.alias("phase"),
        F.when(k % 2 == 0, "Python").otherwise("Scala").alias("type"),
        F.when(k % 53 == 0, F.lit("  ")).otherwise(
            F.concat(F.lit("local:///opt/app/job-"), _s(c), F.lit(".py"))).alias("main_file"),
        F.when(k % 7 == 0, F.lit("org.example.Main")).otherwise(F.lit("")).alias("main_class"),
        F.when(k % 97 == 0, -1).when(k % 5 == 0, 3).otherwise(0).cast("int").alias("executors"),
        F.when(k % 89 == 0, 9).otherwise(c % 3).cast("int").alias("min_executors"),
        ((c % 4) * 4).cast("int").alias("max_executors"),
        (F.col("o_totalprice") / 50).cast("bigint").alias("input_size_mb"),
        rate.alias("cost_per_hour"),
        F.when(k % 101 == 0, -1).otherwise(k % 3).cast("int").alias("max_retries"),
        (k % 4).cast("int").alias("retries"),
        F.element_at(F.array(F.lit("500m"), F.lit("2"), F.lit("1500m"), F.lit("0")),
                     (k % 4 + 1).cast("int")).alias("exec_cpu"),
        F.element_at(F.array(F.lit("512Mi"), F.lit("2Gi"), F.lit("1536Mi"), F.lit("1G")),
                     (c % 4 + 1).cast("int")).alias("exec_memory"),
        F.when(k % 11 != 0, F.element_at(F.array(*[F.lit(x) for x in DRIVER_CPU]), (k % len(DRIVER_CPU) + 1).cast("int"))).alias("driver_cpu"),
        F.element_at(F.array(*[F.lit(x) for x in DRIVER_MEMORY]), (k % len(DRIVER_MEMORY) + 1).cast("int")).alias("driver_memory"),
        ckpt_on.alias("checkpoint_enabled"),
        ckpt_uri.alias("checkpoint_uri"),
        F.when(k % 3 == 0, F.create_map(F.lit("spark.sql.shuffle.partitions"), F.lit("64")))
         .when(k % 3 == 1, F.create_map(F.lit("spark.executor.memoryOverhead"), F.lit("1g"),
                                        F.lit("executor.cores"), F.lit("2")))
         .otherwise(F.create_map().cast("map<string,string>")).alias("spark_conf"),
        F.when(k % 17 == 0, F.lit("Forbid")).alias("concurrency_policy"),
        F.when(k % 8 != 3, start).alias("start_time"),
        end.alias("completion_time"),
    )


# Driver requests in all quantity forms.
DRIVER_CPU = ["250m", "1e0", "2500m", "1.5", "25e-1"]
DRIVER_MEMORY = ["1Gi", "1.5Gi", "2e9", "1Ei", "4096Mi", "3E9", "1048576Ki"]


# ---------------------------------------------------------------------- pods
def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pod per distinct (order, line): line 1 is the driver, others are
    executors / training workers.  Duplicate (order, line) pairs keep the row
    with the greatest (shipdate, partkey, suppkey, extendedprice)."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
             "l_returnflag", "l_linestatus"]
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.col(c).desc() for c in order])
    # rn = 1 gets a partial WindowGroupLimit before the shuffle: each map task
    # forwards one row per pair, however many copies a pair has.
    best = li.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    name = F.concat(_in_team("pod-", k), F.lit("-"), _s(n))
    driver_uid = F.concat(F.lit("uid-pod-"), _s(k), F.lit("-1"))
    phase = (F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), "Pending")
             .when(F.col("l_linestatus") == "O", "Running")
             .when(F.col("l_returnflag") == "R", "Failed")
             .otherwise("Succeeded"))
    ready = F.when(F.col("l_discount") >= 0.03, "True").otherwise("False")
    return best.select(
        _team(k).alias("namespace"),
        name.alias("name"),
        F.concat(F.lit("uid-pod-"), _s(k), F.lit("-"), _s(n)).alias("uid"),
        _in_team("job-", k).alias("run"),
        (n - 1).cast("int").alias("rank"),
        F.when(n == 1, "driver").otherwise("executor").alias("role"),
        F.when(n == 1, F.array().cast("array<string>"))
         .when(F.col("l_suppkey") % 7 == 0, F.array(driver_uid, driver_uid))
         .otherwise(F.array(driver_uid)).alias("owner_uids"),
        phase.alias("phase"),
        F.array(F.struct(F.lit("Initialized").alias("type"), F.lit("True").alias("status")),
                F.struct(F.lit("Ready").alias("type"), ready.alias("status"))).alias("conditions"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


# ------------------------------------------------------------ training runs
def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training run per order, but for every seventh; own times and rate."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").filter(k % 7 != 5)
    start = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=(k % 90).cast("int"))
    end = F.when(F.col("o_orderstatus").isin("F", "P"),
                 start + F.make_interval(mins=(F.col("o_totalprice").cast("bigint") % 300).cast("int")))
    return o.select(
        _team(k).alias("namespace"),
        _in_team("job-", k).alias("name"),
        ((k % 4) + 1).cast("int").alias("world_size"),
        (k % 3).cast("int").alias("max_retries"),
        (k % 2).cast("int").alias("resumes"),
        F.when(k % 5 == 0, "1.25").when(k % 5 == 1, "").otherwise("0.40").alias("cost_per_hour"),
        F.when(k % 6 != 0, start).alias("start_time"),
        F.when(k % 6 != 0, end).alias("completion_time"),
        F.when(k % 9 == 0, F.concat(F.lit("s3a://ck/"), _s(k), F.lit("/step-"), _s(k % 5))).alias("last_checkpoint"),
    )


# ------------------------------------------------- status history / events
EVENT_PHASE = {"view": "Pending", "click": "Running", "signup": "Resuming",
               "purchase": "Succeeded", "error": "Failed"}


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed statuses: one row per event, run = user."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    phase = F.lit(None).cast("string")
    for k, v in reversed(list(EVENT_PHASE.items())):
        phase = F.when(et == k, v).otherwise(phase)
    u = F.col("user_id")
    return e.select(
        F.col("event_id"),
        u.alias("user_id"),
        _team(u).alias("namespace"),
        _in_team("run-", u).alias("run"),
        F.col("ts").cast("timestamp").alias("ts"),
        phase.alias("phase"),
        (F.col("value") / 10).cast("int").alias("running"),
        F.lit(4).alias("desired"),
        F.concat(F.lit("drv-"), _s(u)).alias("driver_pod"),
        (F.col("event_id") % 3).cast("int").alias("retries"),
        F.format_number(F.col("value"), 2).alias("cost"),
        F.when(et == "error", "error").otherwise("success").alias("result"),
        F.col("value"),
    )


# ---------------------------------------------------------- live objects
def dependency_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret / ConfigMap references declared by each run, in order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    refs = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("Secret").alias("kind"),
                 F.concat(F.lit("cred-"), _s(c)).alias("ref_name"), (k % 4 == 0).alias("optional")),
        F.struct(F.lit(1).alias("pos"), F.lit("ConfigMap").alias("kind"),
                 F.concat(F.lit("conf-"), _s(c + 7)).alias("ref_name"), F.lit(False).alias("optional")),
    )
    return o.select(_team(k).alias("namespace"), _in_team("job-", k).alias("run"), F.inline(refs))


def live_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing Secrets / ConfigMaps: customers with a positive balance."""
    cu = table(spark, sf_dir, "customer")
    c = F.col("c_custkey")
    base = cu.filter(F.col("c_acctbal") > 0)
    sec = base.select(F.concat(F.lit("team-"), _s(c % 3)).alias("namespace"), F.lit("Secret").alias("kind"),
                      F.concat(F.lit("cred-"), _s(c)).alias("obj_name"))
    cm = base.filter(c % 2 == 0).select(F.concat(F.lit("team-"), _s((c - 7) % 3)).alias("namespace"),
                                        F.lit("ConfigMap").alias("kind"),
                                        F.concat(F.lit("conf-"), _s(c)).alias("obj_name"))
    return sec.unionByName(cm)


# ------------------------------------------------------------ config layers
def config_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, layer, key, value): 0 defaults, 1 derived, 2 user conf."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    k = F.col("l_orderkey")
    keys = F.array(F.lit("spark.executor.cores"), F.lit("spark.executor.memory"),
                   F.lit("spark.sql.shuffle.partitions"), F.lit("spark.dynamicAllocation.enabled"))
    j = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        _team(k).alias("namespace"),
        _in_team("job-", k).alias("run"),
        (F.col("l_linenumber") % 3).cast("int").alias("layer"),
        F.element_at(keys, (F.col("p_size") % 4 + 1).cast("int")).alias("key"),
        F.concat(_s(F.col("l_quantity").cast("int")), F.lit("-"), F.col("p_brand")).alias("value"),
    )


# --------------------------------------------------------- cron templates
def cron_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheduled template per customer; names repeat across namespaces,
    some templates are years old, some have a last fire on record."""
    cu = table(spark, sf_dir, "customer").select("c_custkey")
    c = F.col("c_custkey")
    sched = F.element_at(F.array(*[F.lit(s) for s in CRON_SAMPLES]), (c % len(CRON_SAMPLES) + 1).cast("int"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONE_SAMPLES]), (c % len(ZONE_SAMPLES) + 1).cast("int"))
    return cu.select(
        F.concat(F.lit("team-"), _s(c % 3)).alias("namespace"),
        F.concat(F.lit("tmpl-"), _s(F.floor(c / 3))).alias("template"),
        sched.alias("schedule"),
        F.nullif(zone, F.lit("")).alias("time_zone"),
        (c % 11 == 0).alias("suspend"),
        F.element_at(F.array(F.lit("Allow"), F.lit(""), F.lit("Replace"), F.lit("Forbid")),
                     (c % 4 + 1).cast("int")).alias("concurrency_policy"),
        F.when(c % 4 == 0, F.lit(3600).cast("bigint")).alias("starting_deadline_s"),
        F.when(c % 6 == 0, F.lit(1)).alias("keep_succeeded"),
        F.when(c % 10 == 0, F.lit(0)).alias("keep_failed"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp")
         - F.make_interval(hours=(F.when(c % 7 == 0, 24 * 800).otherwise(0) + c % 48).cast("int"))).alias("created"),
        F.when(c % 13 == 0, F.lit("2024-03-07 06:00:00").cast("timestamp")).alias("last_schedule_time"),
    )


# Sample schedules and zones spread over the templates.
CRON_SAMPLES = ["*/15 * * * *", "0 * * * *", "30 6 * * 1-5", "0 0 1 * *", "0 0 31 2 *",
                "not a cron", "5,35 */6 * * *", "0 12 * * SUN", "0 9-17/4 * JAN-DEC MON,WED",
                "15 3 10-20 * 0", "0 0 1 1 *", "0 6 29 2 *"]
ZONE_SAMPLES = ["", "America/New_York", "Europe/Berlin", "", "Asia/Tokyo", "Mars/Olympus"]


# ------------------------------------------------------------- job specs
def job_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job run specs with scheduling fields planted on some of them."""
    j = job_runs(spark, sf_dir)
    k = F.regexp_extract(F.col("name"), r"(\d+)$", 1).cast("bigint")
    sched = F.element_at(F.array(*[F.lit(x) for x in CRON_SAMPLES]), ((k / 10).cast("bigint") % len(CRON_SAMPLES) + 1).cast("int"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONE_SAMPLES]), ((k / 10).cast("bigint") % len(ZONE_SAMPLES) + 1).cast("int"))
    return j.withColumns({
        "schedule": F.when(k % 10 == 0, sched).when(k % 43 == 2, F.lit("  ")),
        "time_zone": F.when(k % 10 == 0, F.nullif(zone, F.lit(""))).when(k % 41 == 1, F.lit("UTC")),
        "concurrency_policy": F.when(k % 170 == 10, F.lit("Sometimes")).otherwise(F.col("concurrency_policy")),
        "starting_deadline_s": F.when(k % 19 == 0, F.lit(-5)).when(k % 19 == 1, F.lit(60)).cast("bigint"),
        "keep_succeeded": F.when(k % 23 == 0, F.lit(-1)),
        "keep_failed": F.when(k % 29 == 0, F.lit(2)),
        "suspend": F.when(k % 31 == 0, F.lit(True)),
    })


def training_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training run specs, one per part, with planted faults."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        _team(k).alias("namespace"),
        _in_team("train-", k).alias("name"),
        F.when(k % 41 == 0, F.lit(" ")).otherwise(F.concat(F.lit("registry.example/trainer:"), F.col("p_brand"))).alias("image"),
        F.when(k % 37 == 0, F.lit(0)).otherwise(F.col("p_size") % 4 + 1).cast("int").alias("world_size"),
        F.when(k % 3 == 0, F.concat(F.lit("pvc-"), _s(k))).otherwise(F.lit("")).alias("dataset_pvc"),
        F.when(k % 5 == 0, F.concat(F.lit("s3a://data/"), _s(k)))
         .when(k % 7 == 0, F.concat(F.lit("gs://data/"), _s(k))).otherwise(F.lit("")).alias("dataset_s3_uri"),
        F.when(k % 2 == 0, F.lit("train.py")).otherwise(F.lit("")).alias("script"),
        F.when(k % 11 == 0, F.array(F.lit("python"), F.lit("x.py"))).otherwise(F.array().cast("array<string>")).alias("command"),
        F.when(k % 13 == 0, F.array(F.lit("numpy"))).otherwise(F.array().cast("array<string>")).alias("packages"),
        F.when(k % 17 == 0, F.lit("BERTClassifier")).when(k % 19 == 0, F.lit("GPT")).otherwise(F.lit("")).alias("builtin_trainer"),
        (k % 4 == 0).alias("gpu_enabled"),
        (F.col("p_size") % 3).cast("int").alias("gpu_per_worker"),
        F.element_at(F.array(F.lit("nccl"), F.lit("gloo"), F.lit("")), (k % 3 + 1).cast("int")).alias("gpu_backend"),
        F.when(k % 43 == 0, F.lit(-1)).otherwise(F.lit(2)).cast("int").alias("max_retries"),
        (k % 47 == 0).alias("checkpoint_enabled"),
        F.when(k % 94 == 0, F.lit("s3://ck/")).when(k % 47 == 0, F.lit("")).when(k % 61 == 0, F.lit("hdfs://ck/"))
         .otherwise(F.lit("")).alias("checkpoint_uri"),
        F.when(k % 53 == 0, F.lit("-1")).when(k % 59 == 0, F.lit("abc")).otherwise(F.lit("0.40")).alias("cost_per_hour"),
    )
