"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import datetime as D
from ..functions import encode as N
from ..functions import extract as X
from ..functions import maps as M
from ..functions import masks as MK
from ..functions import mathx as MX
from ..functions import strings as S
from ..operators import drain as DR
from ..operators import events as EV
from ..operators import metrics as ME
from ..operators import outputs as O
from ..operators import spans as SP
from ..sources import formats as P
from ..sources import lines as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT date_trunc('hour', ts) AS span_start, count(*) AS n, round(sum(value), 4) AS total,
  count(DISTINCT user_id) AS users FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def hourly_purchases(spark, sf_dir):
    """Filter, tumbling span of one hour, aggregate."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    spans = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), MX.round_(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))
    return spans.select(F.col("w.start").alias("span_start"), "n", "total", "users")


# sources and line preparation ------------------------------------------------------------------------------------------

def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def doc_lines(spark, sf_dir):
    """documents.text by lines, in one order: doc_id, then position."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.withColumn("seq", F.col("doc_id") * 100_000 + F.col("pos"))


_LINES = """lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
numbered AS (SELECT *, doc_id * 100000 + pos AS seq FROM lines)"""


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 500")
def head_lines(spark, sf_dir):
    return L.head(events(spark, sf_dir).select("event_id", "event_type"), "event_id", 500)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n > 300")
def skip_lines(spark, sf_dir):
    return L.skip_lines(events(spark, sf_dir).select("event_id"), "event_id", 300)


@query(f"WITH {_LINES} SELECT seq, length(line) AS n FROM numbered WHERE regexp_matches(line, '[Tt]he') AND NOT regexp_matches(line, '[0-9]') AND regexp_matches(line, '\\S')")
def keep_and_ignore_lines(spark, sf_dir):
    out = L.keep_ignore(doc_lines(spark, sf_dir), "line", keep="[Tt]he", ignore="[0-9]")
    return out.select("seq", F.length("line").cast("long").alias("n"))


@query("""WITH v AS (SELECT event_id, event_type || ' | ' || CAST(user_id AS VARCHAR) AS line FROM events)
SELECT event_id, trim(split_part(line, '|', 1)) AS kind, ltrim(substr(line, strpos(line, '|') + 1)) AS rest FROM v""")
def extract_prefix(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.concat_ws(" | ", "event_type", F.col("user_id").cast("string")).alias("rest"))
    return L.extract_prefix(e, "rest", "kind").select("event_id", "kind", "rest")


@query("""WITH m AS (SELECT event_id, event_type = 'purchase' AS s, event_type = 'click' AS e FROM events),
n AS (SELECT *, sum(s::INT) OVER (ORDER BY event_id) AS k FROM m),
w AS (SELECT *, sum(e::INT) OVER (PARTITION BY k ORDER BY event_id) AS ends FROM n)
SELECT event_id, CAST(k AS BIGINT) AS section FROM w WHERE k > 0 AND ends = 0""")
def sections(spark, sf_dir):
    out = L.sections(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", start="^purchase$", end="^click$")
    return out.select("event_id", F.col("_section").alias("section"))


@query("""WITH r AS (SELECT event_id, event_type, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS k FROM events)
SELECT min(event_id) AS first_id, count(*) AS n, md5(string_agg(event_type, ' ' ORDER BY event_id)) AS digest FROM r GROUP BY k""")
def multiline_records(spark, sf_dir):
    out = L.multiline(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", "regex", match="^purchase$")
    return out.select(F.col("event_id").alias("first_id"), F.col("_lines").cast("long").alias("n"), F.md5("event_type").alias("digest"))


# formats: lines are made from rows and parsed back ---------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_lines(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", P.json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def parse_logfmt_lines(spark, sf_dir):
    line = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(' type="'), F.col("event_type"), F.lit('" value='), F.format_string("%.9f", F.col("value")))
    r = P.logfmt(line, {"user": "int", "type": "string", "value": "float"})
    return events(spark, sf_dir).select("event_id", r.alias("r")).select("event_id", F.col("r.user").alias("user_id"), F.col("r.type").alias("event_type"), MX.round_("r.value", 6).alias("value"))


@query("SELECT c_custkey, c_name || ', \"x\"' AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def parse_csv_lines(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""x"""'))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, F.col("c_nationkey").cast("string"), "c_mktsegment")
    r = P.csv(line, [("key", "int"), ("name", None), ("nation", "int"), ("segment", None)])
    return table(spark, sf_dir, "customer").select(r.alias("r")).select(F.col("r.key").alias("c_custkey"), "r.name", F.col("r.nation").cast("int").alias("nation"), "r.segment")


@query("""SELECT event_id, 34 AS pri, 4 AS facility, 2 AS severity, 'crit' AS level, 'host' || (user_id % 7) AS host, user_id AS pid, event_type AS msg FROM events""")
def parse_syslog_lines(spark, sf_dir):
    line = F.concat(F.lit("<34>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 7).cast("string"), F.lit(" app["), F.col("user_id").cast("string"), F.lit("]: "), F.col("event_type"))
    r = events(spark, sf_dir).select("event_id", P.syslog(line).alias("r"))
    return r.select("event_id", "r.pri", "r.facility", "r.severity", "r.level", "r.host", "r.pid", "r.msg")


@query("""SELECT event_id, '10.0.0.' || (user_id % 250) AS ip, 'GET' AS method, '/' || event_type AS path, CAST(200 + event_id % 300 AS INTEGER) AS status, user_id AS bytes, 'agent' AS user_agent FROM events""")
def parse_combined_lines(spark, sf_dir):
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '), (200 + F.col("event_id") % 300).cast("string"), F.lit(" "), F.col("user_id").cast("string"), F.lit(' "-" "agent"'))
    r = events(spark, sf_dir).select("event_id", P.combined(line).alias("r"))
    return r.select("event_id", "r.ip", "r.method", "r.path", "r.status", "r.bytes", "r.user_agent")


@query("SELECT event_id, event_type AS event, CAST(user_id AS VARCHAR) AS suser, 'a=b' AS note FROM events")
def parse_cef_lines(spark, sf_dir):
    line = F.concat(F.lit(r"CEF:0|v|p\|q|1.0|100|"), F.col("event_type"), F.lit("|5|suser="), F.col("user_id").cast("string"), F.lit(r" note=a\=b"))
    r = events(spark, sf_dir).select("event_id", P.cef(line).alias("r"))
    return r.select("event_id", "r.event", F.col("r.extension")["suser"].alias("suser"), F.col("r.extension")["note"].alias("note"))


@query("SELECT event_id, event_type AS a, user_id AS b, 'tail ' || event_type || ' x' AS rest FROM events")
def parse_cols_lines(spark, sf_dir):
    line = F.concat(F.col("event_type"), F.lit("  skip "), F.col("user_id").cast("string"), F.lit(" tail "), F.col("event_type"), F.lit(" x"))
    return events(spark, sf_dir).select("event_id", P.cols(line, "a - b:int *rest").alias("r")).select("event_id", "r.*")


@query("SELECT event_id, event_type AS kind, user_id AS usr FROM events WHERE event_id % 3 = 0")
def parse_regex_lines(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), F.col("event_type"), F.lit("] user "), F.col("user_id").cast("string"))).otherwise("no match")
    r = events(spark, sf_dir).select("event_id", P.regex(line, r"\[(?P<kind>\w+)\] user (?P<usr:int>\d+)").alias("r"))
    return r.where("r is not null").select("event_id", "r.kind", "r.usr")


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'json' WHEN event_id % 3 = 1 THEN 'logfmt' ELSE 'line' END AS format, count(*) AS n FROM events GROUP BY 1")
def parse_cascade(spark, sf_dir):
    k = F.col("event_id") % 3
    v = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("a="), F.col("event_type"))).otherwise(F.concat(F.lit("plain text "), F.col("event_type")))
    r = P.cascade(v, [("json", P.json(v, "k long")), ("logfmt", P.logfmt(v, {"a": "string"})), ("line", P.line(v))])
    return events(spark, sf_dir).select(r["_format"].alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS a, CAST(date_trunc('second', ts) AS TIMESTAMP) AS b, CAST(date_trunc('second', ts) AS TIMESTAMP) AS c FROM events")
def parse_timestamps(spark, sf_dir):
    iso, epoch, access = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'")
    return events(spark, sf_dir).select("event_id", D.parse_ts(iso).alias("a"), D.parse_ts(epoch).alias("b"), D.parse_ts(access).alias("c"))


# event steps -------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'purchase') AND value > 10 AND user_id IS DISTINCT FROM 5")
def filter_events(spark, sf_dir):
    out = EV.keep_if(events(spark, sf_dir), F.col("event_type").isin("click", "purchase"), "value > 10", EV.differs(F.col("user_id"), F.lit(5)))
    return out.select("event_id", "value")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value * 2 ELSE value END AS value, CASE WHEN event_id % 4 <> 0 THEN upper(event_type) ELSE event_type END AS event_type FROM events")
def exec_all_or_nothing(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "value", "event_type")
    return EV.exec_(e, value="value * 2", event_type="if(event_id % 4 = 0, null, upper(event_type))")


@query("SELECT count(*) FILTER (NOT coalesce(value > 0, false)) AS positive, count(*) FILTER (NOT coalesce(user_id < 100, false)) AS small FROM events")
def assert_counts(spark, sf_dir):
    return EV.check(events(spark, sf_dir), positive="value > 0", small="user_id < 100")[1]


@query("SELECT event_id FROM events WHERE lower(event_type) IN ('click', 'view') AND lower(event_type) NOT IN ('view')")
def level_filter(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("level", F.upper("event_type"))
    return EV.levels(e, ["click", "View"], ["VIEW"]).select("event_id")


@query("SELECT event_type, event_id FROM events")
def key_projection(spark, sf_dir):
    return EV.keys(events(spark, sf_dir), ["event_type", "event_id", "value"], ["value"])


@query("SELECT ts, event_type AS msg FROM events")
def core_fields(spark, sf_dir):
    return EV.core(events(spark, sf_dir).withColumnRenamed("event_type", "msg").select("event_id", "ts", "user_id", "msg"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts <= (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def time_range(spark, sf_dir):
    from datetime import timedelta

    e = events(spark, sf_dir)
    first = e.agg(F.min("ts")).first()[0]
    return EV.between(e, "ts", first + timedelta(days=1), first + timedelta(days=3)).select("event_id")


@query("SELECT event_id FROM (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 100)")
def take_events(spark, sf_dir):
    return EV.take(events(spark, sf_dir).where("event_type = 'click'").select("event_id"), 100, "event_id")


@query("""WITH h AS (SELECT event_id, value > (SELECT quantile_cont(value, 0.98) FROM events) AS hit FROM events),
w AS (SELECT event_id, hit, coalesce(max(hit::INT) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS b,
  coalesce(max(hit::INT) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS a FROM h)
SELECT event_id, CASE WHEN hit THEN 'match' WHEN b = 1 AND a = 1 THEN 'both' WHEN b = 1 THEN 'before' ELSE 'after' END AS context_type FROM w WHERE hit OR b = 1 OR a = 1""")
def context_rows(spark, sf_dir):
    e = events(spark, sf_dir)
    cut = e.agg(F.percentile("value", 0.98)).first()[0]
    return EV.context(e, F.col("value") > cut, "event_id", before=2, after=3).select("event_id", "context_type")


@query("WITH x AS (SELECT user_id, list(event_type ORDER BY event_id) AS l FROM events GROUP BY user_id) SELECT user_id, unnest(l) AS kind FROM x")
def emit_each(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("kind"))).alias("items"))
    return EV.emit_each(g, "items", ["user_id"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_enrich(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey").select("c_nationkey", "n_name")
    return EV.lookup(table(spark, sf_dir, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 7 = 0")
def sample_every(spark, sf_dir):
    return EV.sample_every(events(spark, sf_dir).select("event_id"), 7, "event_id")


@query("""SELECT event_id, round(value, 6) AS current, round(lag(value, 1) OVER w, 6) AS before, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_values(spark, sf_dir):
    w = EV.window_values(events(spark, sf_dir), "event_id", 3, ["value"], by=["user_id"])
    return w.select("event_id", MX.round_(F.get("window", F.lit(0))["value"], 6).alias("current"), MX.round_(F.get("window", F.lit(1))["value"], 6).alias("before"), MX.round_(A.mean(A.pluck_as_nums("window", "value")), 6).alias("mean"))


@query("""WITH g AS (SELECT event_id, abs(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))) AS d FROM events)
SELECT event_id, CASE WHEN d >= 3600000000 THEN d ELSE 0 END AS gap_us FROM g""")
def gap_marks(spark, sf_dir):
    return EV.mark_gaps(events(spark, sf_dir), "ts", "event_id", 3600, by=["user_id"]).select("event_id", F.coalesce("gap_us", F.lit(0).cast("long")).alias("gap_us"))


# metrics ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def freq_table(spark, sf_dir):
    return ME.freq(events(spark, sf_dir), "event_type")


@query("SELECT event_type, count(*) FILTER (value > 50) AS big, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def track_scalars(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(ME.inc(F.col("value") > 50).alias("big"), MX.round_(ME.total("value"), 4).alias("total"), MX.round_(ME.average("value"), 6).alias("mean"), ME.least("value").alias("least"), ME.most("value").alias("most"))


@query("SELECT user_id AS value, min(event_id) AS first_seen FROM events GROUP BY 1")
def track_unique(spark, sf_dir):
    return ME.unique(events(spark, sf_dir), "user_id", "event_id")


@query("SELECT true AS close")
def track_cardinality(spark, sf_dir):
    e = events(spark, sf_dir)
    row = ME.with_distinct(e, "user_id", ME.cardinality("user_id").alias("est"))
    return row.select((F.abs(F.col("est") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def track_top(spark, sf_dir):
    return ME.top(events(spark, sf_dir), "user_id", 10)


@query("SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def track_bottom(spark, sf_dir):
    return ME.bottom(events(spark, sf_dir), "user_id", 10)


@query("SELECT CAST(user_id AS VARCHAR) AS value, max(value) AS score FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def track_top_by(spark, sf_dir):
    return ME.top_by(events(spark, sf_dir), "user_id", "value", 10)


@query("SELECT CAST(user_id AS VARCHAR) AS value, min(value) AS score FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def track_bottom_by(spark, sf_dir):
    return ME.bottom_by(events(spark, sf_dir), "user_id", "value", 10)


@query("""SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, CAST(count(value) AS DOUBLE) AS count, round(sum(value), 4) AS sum,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def describe(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("event_type").agg(*ME.stats("value", exact=True))
    return d.select("event_type", "min", "max", MX.round_("avg", 6).alias("avg"), "count", MX.round_("sum", 4).alias("sum"), *[MX.round_(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@query("SELECT 'n' AS metric, NULL AS key, CAST(count(*) AS DOUBLE) AS value FROM events UNION ALL SELECT 'kinds', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY 2")
def metrics_table(spark, sf_dir):
    return ME.Metrics(events(spark, sf_dir)).track("n", "inc").track("kinds", "freq", "event_type").table()


@query("SELECT 'k' AS path, count(*) AS events, round(0.0, 4) AS missing_pct FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def discover_fields(spark, sf_dir):
    return ME.discover(events(spark, sf_dir), "props").select("path", "events", MX.round_("missing_pct", 4).alias("missing_pct"))


@query("SELECT count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ts IS NULL) AS without_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS span_seconds FROM events")
def run_statistics(spark, sf_dir):
    return ME.run_stats(events(spark, sf_dir), "ts")


@query("SELECT 'user <num> did ' || event_type AS template, 'v1:' || substr(sha256('user <num> did ' || event_type), 1, 16) AS template_id, count(*) AS count FROM events GROUP BY 1")
def drain_templates(spark, sf_dir):
    e = events(spark, sf_dir).select(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type").alias("line"))
    return DR.templates(e, "line", similarity=0.99)


# spans -------------------------------------------------------------------------------------------------------------------


@query("SELECT '#' || CAST((n - 1) // 250 AS VARCHAR) AS span_id, count(*) AS span_size, min(event_id) AS first_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type <> 'view') GROUP BY 1")
def count_spans(spark, sf_dir):
    s = SP.count_spans(events(spark, sf_dir).where("event_type <> 'view'"), "event_id", 250)
    return SP.close_spans(s, F.min("event_id").alias("first_id"))


@query("""WITH b AS (SELECT user_id, event_id, value, date_trunc('hour', ts) AS w FROM events),
o AS (SELECT *, max(w) OVER (ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM b)
SELECT CASE WHEN w < open THEN 'late' ELSE 'included' END AS span_status, count(*) AS n FROM o GROUP BY 1""")
def time_spans_late(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("seq", F.col("user_id") * 1_000_000_000 + F.col("event_id"))
    return SP.time_spans(e, "ts", "seq", "1 hour").groupBy("span_status").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events),
s AS (SELECT *, sum((p IS NULL OR p <> event_type)::INT) OVER (ORDER BY event_id) AS k FROM c)
SELECT any_value(event_type) AS span_value, count(*) AS span_size, min(event_id) AS first_id FROM s GROUP BY k""")
def field_spans(spark, sf_dir):
    s = SP.field_spans(events(spark, sf_dir), "event_type", "event_id")
    return SP.close_spans(s, F.first("span_value").alias("span_value"), F.min("event_id").alias("first_id")).drop("span_id")


@query("""WITH g AS (SELECT user_id, event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events),
s AS (SELECT *, sum((top IS NULL OR epoch_us(ts) - epoch_us(top) > 7200000000)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM g)
SELECT user_id, 'idle-#' || CAST(k AS BIGINT) AS span_id, count(*) AS span_size, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""")
def idle_spans(spark, sf_dir):
    s = SP.idle_spans(events(spark, sf_dir), "ts", "event_id", 7200, by=["user_id"])
    return SP.close_spans(s, ts="ts", by=["user_id"])


@query("""WITH n AS (SELECT event_id, user_id, '#' || CAST((row_number() OVER (ORDER BY event_id) - 1) // 500 AS VARCHAR) AS span_id FROM events),
f AS (SELECT user_id, arg_min(span_id, event_id) AS span_id FROM n GROUP BY 1) SELECT span_id, count(*) AS new_values FROM f GROUP BY 1""")
def span_new_values(spark, sf_dir):
    return SP.first_seen(SP.count_spans(events(spark, sf_dir), "event_id", 500), "user_id", "event_id")


# outputs -----------------------------------------------------------------------------------------------------------------


@query("""SELECT '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS line, event_id FROM events""")
def output_json(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(O.as_json(e.select("event_type", "user_id")).alias("line"), "event_id")


@query("""SELECT 'event_type=' || event_type || ' user_id=' || user_id AS line, event_id FROM events""")
def output_logfmt(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select(O.as_logfmt(e.select("event_type", "user_id")).alias("line"), "event_id")


@query("SELECT chr(34) || event_type || ',' || repeat(chr(34), 3) || ',' || user_id AS line, event_id FROM events")
def output_csv(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.concat("event_type", F.lit(',"')))
    return e.select(O.as_csv(e, ["k", "user_id"]).alias("line"), "event_id")


@query("""WITH n AS (SELECT event_id, left(event_type, 1) AS c, (row_number() OVER (ORDER BY event_id) - 1) // 80 AS line FROM events)
SELECT line, string_agg(c, '' ORDER BY event_id) AS text FROM n GROUP BY 1""")
def output_keymap(spark, sf_dir):
    return O.keymap(events(spark, sf_dir), "event_type", "event_id").select("line", "text")


@query("""WITH q AS (SELECT quantile_cont(value, 0.9) AS a, quantile_cont(value, 0.95) AS b, quantile_cont(value, 0.99) AS c FROM events),
n AS (SELECT event_id, CASE WHEN value IS NULL THEN '.' WHEN value < a THEN '_' WHEN value < b THEN '1' WHEN value < c THEN '2' ELSE '3' END AS m, (row_number() OVER (ORDER BY event_id) - 1) // 80 AS line FROM events, q)
SELECT line, string_agg(m, '' ORDER BY event_id) AS text FROM n GROUP BY 1""")
def output_tailmap(spark, sf_dir):
    return O.tailmap(events(spark, sf_dir), "value", "event_id", exact=True).select("line", "text")


# functions ---------------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, upper(p_name) AS up, contains(p_name, 'a') AS has_a, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS digits,
len(p_type) - len(replace(p_type, 'a', '')) AS n_a, levenshtein(p_brand, 'Brand#11') AS dist, nullif(p_brand, '') AS some, p_name[2:4] AS sl, reverse(p_brand) AS rev,
CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 2) ELSE '' END AS aft, CASE WHEN contains(p_brand, '#') THEN split_part(p_brand, '#', 1) ELSE '' END AS bef,
p_brand LIKE 'Brand#1_' AS gl, p_brand ILIKE 'brand%' AS igl, strpos(p_brand, '#') - 1 AS at FROM part""")
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.upper("p_name").alias("up"), S.contains("p_name", "a").alias("has_a"), S.is_digit(F.col("p_size").cast("string")).alias("digits"), S.count("p_type", "a").alias("n_a"), S.edit_distance("p_brand", "Brand#11").alias("dist"), S.or_empty("p_brand").alias("some"), S.slice_text("p_name", "1:4").alias("sl"), S.slice_text("p_brand", "::-1").alias("rev"), S.after("p_brand", "#").alias("aft"), S.before("p_brand", "#").alias("bef"), S.like("p_brand", "Brand#1?").alias("gl"), S.ilike("p_brand", "brand*").alias("igl"), S.index_of("p_brand", "#").alias("at"))


@query(r"""SELECT p_partkey, regexp_extract(p_brand, '#([0-9])', 1) AS d, array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') AS vowels, regexp_replace(p_brand, '([0-9])([0-9])', '\2-\1') AS swapped,
len(string_split(p_name, ' ')) AS words, lpad(CAST(p_size AS VARCHAR), 6, '0') AS padded, CASE WHEN length(p_name) <= 8 THEN p_name ELSE p_name[1:7] || '…' END AS short, printf('%.2f', p_retailprice) AS price FROM part""")
def regex_and_display(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.extract_regex("p_brand", "#([0-9])").alias("d"), F.array_join(S.extract_regexes("p_name", "[aeiou]"), "").alias("vowels"), S.replace_regex("p_brand", "([0-9])([0-9])", "$2-$1").alias("swapped"), F.size(S.split("p_name", " ")).cast("long").alias("words"), S.rjust(F.col("p_size").cast("string"), 6, "0").alias("padded"), S.shorten("p_name", 8).alias("short"), S.format_decimals("p_retailprice", 2).alias("price"))


@query(r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host, regexp_extract(url, 'https?://([^/\s?#]+)', 1) AS domain FROM pages""")
def url_functions(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", X.parse_url("url").alias("u"))
    return p.select("page_id", "u.scheme", F.col("u.host").alias("host"), X.extract_domain("url").alias("domain"))


@query(r"""SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS t, to_base64(event_type::BLOB) AS b64, lower(hex(event_type)) AS hx, sha256(event_type) AS sha, url_encode(event_type || ' &') AS enc,
'10.1.' || (user_id % 256) || '.0' AS masked, user_id % 2 = 0 AS inside FROM events""")
def encoding_and_network(spark, sf_dir):
    e = events(spark, sf_dir)
    ip = F.concat(F.lit("10.1."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    kv = X.parse_kv(F.concat(F.lit("bare u="), F.col("user_id").cast("string"), F.lit(" t=x t="), F.col("event_type")))
    net = F.concat(F.when(F.col("user_id") % 2 == 0, "10.2.").otherwise("10.3."), F.lit("7.9"))
    return e.select("event_id", kv["u"].alias("u"), kv["t"].alias("t"), N.encode_b64("event_type").alias("b64"), N.encode_hex("event_type").alias("hx"), N.hash_text("event_type").alias("sha"), N.encode_url(F.concat("event_type", F.lit(" &"))).alias("enc"), N.mask_ip(ip).alias("masked"), N.is_in_cidr(net, "10.2.0.0/16").alias("inside"))


@query("""SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS s, round(list_avg(embedding::DOUBLE[]), 6) AS m, round(list_var_pop(embedding::DOUBLE[]), 6) AS v,
round(list_min(embedding::DOUBLE[]), 6) AS lo, round(list_max(embedding::DOUBLE[]), 6) AS hi, round(list_aggregate(embedding::DOUBLE[], 'quantile_cont', 0.9), 6) AS p90 FROM embeddings""")
def array_functions(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    r = lambda c, n: MX.round_(c, 6).alias(n)
    return v.select("vec_id", r(A.sum_("a"), "s"), r(A.mean("a"), "m"), r(A.variance("a"), "v"), r(A.min_("a"), "lo"), r(A.max_("a"), "hi"), r(A.percentile("a", 90), "p90"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS missing, json_exists(props, '$.k') AS has_k, 'type=' || event_type AS lf FROM events""")
def map_functions(spark, sf_dir):
    m = F.create_map(F.lit("type"), F.col("event_type"))
    return events(spark, sf_dir).select("event_id", M.get_path("props", "k").alias("k"), M.get_path("props", "x.y", "none").alias("missing"), M.has_path("props", "k").alias("has_k"), M.to_logfmt(m).alias("lf"))


@query("""SELECT event_id, date_trunc('hour', ts) AS floor_h, strftime(ts, '%Y-%m-%d %H:%M') AS txt, CAST(year(ts) AS INTEGER) AS y, epoch_us(ts) * 1000 AS ns,
5400000000000 AS dur, ts + INTERVAL 90 MINUTE AS later FROM events""")
def datetime_functions(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", D.round_to("ts", D.NS["h"]).alias("floor_h"), D.format_ts("ts", "%Y-%m-%d %H:%M").alias("txt"), D.part("ts", "year").alias("y"), D.ts_nanos("ts").alias("ns"), D.to_duration(F.lit("1h 30m")).alias("dur"), D.plus("ts", 90 * D.NS["m"]).alias("later"))


@query("""SELECT l_orderkey, l_linenumber, least(30.0, greatest(10.0, l_quantity)) AS c, CAST(l_orderkey % 7 AS BIGINT) AS m, CAST(l_linenumber AS BIGINT) AS i, l_linestatus = 'O' AS b FROM lineitem""")
def number_functions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", MX.clamp("l_quantity", 10.0, 30.0).alias("c"), MX.mod("l_orderkey", 7).alias("m"), MX.to_int(F.col("l_linenumber").cast("string")).alias("i"), MX.to_bool(F.when(F.col("l_linestatus") == "O", "on").otherwise("off")).alias("b"))


@query("SELECT event_id, 'user <ipv4> sent <email> at <uuid>' AS text FROM events")
def normalized_text(spark, sf_dir):
    line = F.concat(F.lit("user 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" sent a"), F.col("event_id").cast("string"), F.lit("@example.org at 0a1b2c3d-0000-4000-8000-0123456789ab"))
    return events(spark, sf_dir).select("event_id", MK.normalized(line).alias("text"))


from . import queries_formats, queries_functions  # noqa: E402, F401  they register themselves
