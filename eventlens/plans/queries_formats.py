"""Registered queries of sources and formats: lines are made from rows by SQL that both engines read, and parsed back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import datetime as D
from ..functions import masks as MK
from ..sources import formats as P
from ..sources import lines as L
from .queries import ORACLE_SQL, QUERIES, events, query, table

#: Fields of a line: SQL over events for texts and numbers.
_USER, _ID, _KIND = "CAST(user_id AS STRING)", "CAST(event_id AS STRING)", "event_type"
_INT = "user_id"


def _line(template: str, fields: dict[str, str]) -> str:
    """SQL of a line: {name} in the template is the field's SQL, all else literal text."""
    out = []
    for part in re.split(r"(\{\w+\})", template):
        if part:
            out.append(f"CAST({fields[part[1:-1]]} AS STRING)" if re.fullmatch(r"\{\w+\}", part) else "'" + part.replace("'", "''") + "'")
    return " || ".join(out)


def _spark_sql(sql: str) -> str:
    """Spark's dialect doubles no quotes and reads backslashes."""
    return sql.replace("\\", "\\\\")


def named_query(name: str, label: str, templates: list[tuple[str, str]], fields: dict[str, str],):
    """A query for a named format: rows whose condition holds have lines of that template; fields beyond it are null."""
    whens = " ".join(f"WHEN {cond} THEN {_line(t, fields)}" for cond, t in templates)
    shown = []
    for f, sql in fields.items():
        has = [cond for cond, t in templates if "{" + f + "}" in t]
        expr = f"CAST({sql} AS BIGINT)" if sql in ("user_id", "event_id") else sql
        shown.append(f'CASE WHEN {" OR ".join(f"({c})" for c in has)} THEN {expr} END AS "{f}"')
    ORACLE_SQL[name] = f"SELECT event_id AS row_id, {', '.join(shown)} FROM events"

    def run(spark, sf_dir):
        line = F.expr(_spark_sql(f"CASE {whens} END"))
        rows = events(spark, sf_dir).select(F.col("event_id").alias("row_id"), line.alias("line"))
        return rows.select("row_id", P.named("line", label).alias("r")).select("row_id", *[F.col(f"r.{f}").alias(f) for f in fields])

    run.__name__ = name
    run.__doc__ = f"Lines of {label} made from rows and parsed back."
    QUERIES[name] = run


_ALL = "true"
named_query("named_glog", "glog", [(_ALL, "{level}{ts}  {pid} {source}] {msg}")],
            {"level": "CASE WHEN event_type = 'click' THEN 'E' ELSE 'I' END", "ts": "'0102 15:04:05.123456'", "pid": _INT, "source": f"'server.go:' || {_ID}", "msg": f"'Starting ' || {_KIND} || ': ok'"})
named_query("named_cri", "cri", [(_ALL, "{ts} {stream} {tag} {msg}")],
            {"ts": "'2024-07-17T12:12:05.123456789Z'", "stream": "CASE WHEN user_id % 2 = 0 THEN 'stdout' ELSE 'stderr' END", "tag": "CASE WHEN event_id % 2 = 0 THEN 'F' ELSE 'P' END", "msg": "props"})
named_query("named_nginx_error", "nginx-error", [("event_id % 2 = 0", "{ts} [{level}] {pid}#{tid}: {msg}"), ("event_id % 2 = 1", "{ts} [{level}] {pid}#{tid}:{msg}")],
            {"ts": "'2024/01/02 15:04:05'", "level": _KIND, "pid": _INT, "tid": "event_id", "msg": f"'*' || {_ID} || ' open() failed (2: No such file)'"})
named_query("named_apache_error", "apache-error", [("event_id % 3 = 0", "[{ts}] [{module}:{level}] [pid {pid}:tid {tid}] [client {client}] {msg}"), ("event_id % 3 = 1", "[{ts}] [{level}] [client {client}] {msg}"), ("event_id % 3 = 2", "[{ts}] [{level}] {msg}")],
            {"ts": "'Fri Oct 11 14:32:52.123456 2024'", "module": "'core'", "level": _KIND, "pid": _INT, "tid": "event_id", "client": f"'72.15.99.187:' || {_USER}", "msg": f"'AH00126: Invalid URI ' || {_ID}"})
named_query("named_log4j", "log4j", [(_ALL, "{ts} {level}  [{thread}] {logger} - {msg}")],
            {"ts": "'2024-01-02 15:04:05,123'", "level": "CASE WHEN event_type = 'click' THEN 'ERROR' ELSE 'INFO' END", "thread": f"'pool-1-thread-' || {_USER}", "logger": f"'com.example.' || {_KIND}", "msg": f"'done - ' || {_ID}"})
named_query("named_python_logging", "python-logging", [(_ALL, "{ts} - {logger} - {level} - {msg}")],
            {"ts": "'2024-01-02 15:04:05,123'", "logger": f"'app.' || {_KIND}", "level": "CASE WHEN event_type = 'click' THEN 'CRITICAL' ELSE 'WARNING' END", "msg": f"'took ' || {_ID} || ' - end'"})
named_query("named_postgres", "postgres", [(_ALL, "{ts} {log_tz} [{pid}] {level}:  {msg}")],
            {"ts": "'2024-01-02 15:04:05.123'", "log_tz": "CASE WHEN user_id % 2 = 0 THEN 'UTC' ELSE 'CEST' END", "pid": _INT, "level": "CASE WHEN event_type = 'click' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG3' ELSE 'LOG' END", "msg": f"'relation \"t' || {_ID} || '\" does not exist'"})
named_query("named_redis", "redis", [(_ALL, "{pid}:{role} {ts} {level} {msg}")],
            {"pid": _INT, "role": "CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'C' END", "ts": "'06 Feb 2024 12:00:00.123'", "level": "CASE WHEN event_type = 'click' THEN '#' ELSE '*' END", "msg": f"'Ready ' || {_ID}"})
_S3_LINE = '{owner} {bucket} [{ts}] {client} {requester} {req_id} {op} {key} "{method} {uri}?{query} {httpver}" {status} {error_code} {bytes_sent} {obj_size} {total_time} {turnaround_time} "{referer}" "{user_agent}"'
named_query("named_s3", "s3", [("event_id % 2 = 0", _S3_LINE + " {version_id} {host_id} {sig_version} {cipher_suite} {auth_type} {host_header} {tls_version}"), ("event_id % 2 = 1", _S3_LINE)],
            {"owner": "'79a59df9'", "bucket": f"'bucket-' || {_KIND}", "ts": "'06/Feb/2024:00:00:38 +0000'", "client": "'192.0.2.3'", "requester": "'-'", "req_id": _ID, "op": "'REST.GET.OBJECT'", "key": f"'photos/' || {_ID} || '.jpg'", "method": "'GET'", "uri": f"'/photos/' || {_ID}", "query": f"'x-id=' || {_KIND}", "httpver": "'HTTP/1.1'", "status": "'200'", "error_code": "'-'", "bytes_sent": _USER, "obj_size": "'-'", "total_time": "'14'", "turnaround_time": "'12'", "referer": "'-'", "user_agent": f"'aws cli/' || {_USER}", "version_id": "'-'", "host_id": "'host-id-xyz'", "sig_version": "'SigV4'", "cipher_suite": "'ECDHE-RSA'", "auth_type": "'AuthHeader'", "host_header": "'b.s3.amazonaws.com'", "tls_version": "'TLSv1.2'"})
_HA = "{ts} {host} {proc}[{pid}]: {client_ip}:{client_port} [{accept_date}] {frontend} {backend}/{server} "
_HA_COUNTS = "{actconn}/{feconn}/{beconn}/{srv_conn}/{retries} {srv_queue}/{backend_queue}"
named_query("named_haproxy", "haproxy", [("event_id % 3 = 0", _HA + "{tq}/{tw}/{tc}/{tr}/{tt} {status} {bytes_read} - - {termination_state} " + _HA_COUNTS + ' "{msg}"'), ("event_id % 3 = 1", _HA + "{tw}/{tc}/{tt} {bytes_read} {termination_state} " + _HA_COUNTS)],
            {"ts": "'Feb 06 12:14:14'", "host": "'localhost'", "proc": "'haproxy'", "pid": _INT, "client_ip": "'10.0.1.2'", "client_port": "event_id", "accept_date": "'06/Feb/2024:12:14:14.655'", "frontend": "'http-in'", "backend": _KIND, "server": "'srv1'", "tq": "'10'", "tw": "'0'", "tc": "'-1'", "tr": "'69'", "tt": "'109'", "status": "'200'", "bytes_read": "event_id", "termination_state": "CASE WHEN event_id % 3 = 0 THEN '----' ELSE '--' END", "actconn": _INT, "feconn": _INT, "beconn": _INT, "srv_conn": _INT, "retries": _INT, "srv_queue": _INT, "backend_queue": _INT, "msg": f"'GET /' || {_KIND} || ' HTTP/1.1'"})
named_query("named_iso8601_level", "iso8601-level", [("event_id % 2 = 0", "{ts} {level} {msg}"), ("event_id % 2 = 1", "[{ts}] {level} {msg}")],
            {"ts": "CASE WHEN user_id % 2 = 0 THEN '2024-01-02T15:04:05.123Z' ELSE '2024-06-12 08:00:00' END", "level": "CASE WHEN event_type = 'click' THEN 'ERR' ELSE 'WARNING' END", "msg": f"'Starting service on port ' || {_USER}"})


# other formats -------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, 165 AS pri, 20 AS facility, 5 AS severity, 'notice' AS level, 1 AS version, '2003-10-11T22:14:15.003Z' AS ts, 'host' || (user_id % 7) AS host, CASE WHEN user_id % 2 = 0 THEN 'app' END AS prog,
CASE WHEN event_id % 2 = 0 THEN user_id END AS pid, 'ID' || user_id AS msgid, event_type || ' done' AS msg FROM events""")
def parse_syslog_5424(spark, sf_dir):
    """RFC 5424 lines with and without structured data, program and process."""
    line = F.expr("""'<165>1 2003-10-11T22:14:15.003Z host' || (user_id % 7) || ' ' || if(user_id % 2 = 0, 'app', '-') || ' ' || if(event_id % 2 = 0, cast(user_id as string), '-') || ' ID' || user_id || ' '
      || case when event_id % 3 = 0 then '-' when event_id % 3 = 1 then '[ex@32473 iut="3" event="A]B"]' else '[a b="1"][c d="2"]' end || ' ' || event_type || ' done'""".replace('A]B', 'A'))
    r = events(spark, sf_dir).select("event_id", P.syslog(line).alias("r"))
    return r.select("event_id", "r.*")


@query("SELECT event_id, event_type AS a, user_id AS b, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value > 50 END AS c, CASE WHEN event_id % 3 = 2 THEN 'more' END AS c4 FROM events")
def parse_tsv_lines(spark, sf_dir):
    """A typed header, short rows and rows with one field more."""
    names = P.header("a\tb:int\tc:bool", "\t")
    v = F.expr("concat_ws('\t', event_type, cast(user_id as string), case when event_id % 3 = 0 then null else if(value > 50, 'yes', 'f') end, if(event_id % 3 = 2, 'more', null))")
    return events(spark, sf_dir).select("event_id", P.csv(v, names, "\t", extra=1).alias("r")).select("event_id", "r.*")


@query("""SELECT (event_id - (SELECT min(event_id) FROM events)) + 1 AS seq, event_id AS id, event_type || ', x' AS kind FROM events""")
def read_csv_with_header(spark, sf_dir):
    """The first line names the columns and their types; blank lines don't count."""
    e = events(spark, sf_dir)
    low = e.agg(F.min("event_id")).first()[0]
    rows = e.select((F.col("event_id") - low + 1).alias("seq"), F.expr("concat(event_id, ',\"', event_type, ', x\"')").alias("line"))
    head = spark.createDataFrame([(-1, "  "), (0, "id:int,kind")], "seq long, line string")
    return P.read_delimited(rows.unionByName(head), "line", "seq").select("seq", "id", "kind")


@query("SELECT event_id, event_type AS c1, CAST(user_id AS VARCHAR) AS c2 FROM events")
def read_csv_without_header(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("line"))
    return P.read_delimited(e, "line", "event_id", has_header=False).select("event_id", "c1", "c2")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a,"x' WHEN event_id % 3 = 1 THEN 'in ""side' ELSE 'end",' || event_type END AS line, event_id // 3 AS g FROM events)
SELECT g AS rec, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY event_id)) AS digest FROM l GROUP BY g HAVING count(*) = 3""")
def csv_record_assembly(spark, sf_dir):
    """Records whose quoted field spans three lines."""
    e = events(spark, sf_dir)
    low = e.agg(F.min("event_id")).first()[0]
    first = low + (-low) % 3
    line = F.expr("case when event_id % 3 = 0 then 'a,\"x' when event_id % 3 = 1 then 'in \"\"side' else concat('end\",', event_type) end")
    rec = L.csv_records(e.where(F.col("event_id") >= first).select("event_id", line.alias("line")), "line", "event_id")
    out = rec.select((F.col("event_id") / 3).cast("long").alias("rec"), F.size(F.split("line", "\n")).cast("long").alias("lines"), F.md5("line").alias("digest"))
    return out.where("lines = 3")


@query("SELECT event_id, event_type || ' ' || user_id AS line, chr(9) || event_type || ' ' AS raw FROM events")
def line_and_raw(spark, sf_dir):
    """The line without its ending, and the line as it is."""
    e = events(spark, sf_dir)
    out = e.select("event_id", P.line(F.expr("concat(event_type, ' ', user_id, '\\r\\n')")).alias("a"), P.raw(F.concat(F.lit("\t"), "event_type", F.lit(" "))).alias("b"))
    return out.select("event_id", "a.line", "b.raw")


_SAMPLES = {
    "json": '{"a": 1}', "cef": "CEF:0|v|p|1|100|e|5|x=1", "syslog": "<34>Oct 11 22:14:15 h su: x", "combined": '1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 5', "cri": "2024-07-17T12:12:05Z stdout F hi",
    "logfmt": "level=info msg=hi", "csv": "name,age,city", "tsv": "name\tage", "log4j": "2024-01-02 15:04:05,123 INFO [main] a.B - up", "redis": "1:M 06 Feb 2024 12:00:00.123 * x", "line": "just some random log text here",
}


@query("SELECT f AS format, f AS found FROM (VALUES " + ", ".join(f"('{f}')" for f in _SAMPLES) + ") t(f)")
def detect_formats(spark, sf_dir):
    """The format told from the first line of a stream that isn't blank."""
    rows = []
    for label, sample in _SAMPLES.items():
        stream = spark.createDataFrame([(0, " "), (1, sample), (2, "{}")], "seq long, line string").coalesce(1)
        rows.append((label, P.detect_frame(stream, "line", "seq")))
    return spark.createDataFrame(rows, "format string, found string")


_TS = [
    ("2024-03-05T06:07:08Z", None), ("2024-03-05 06:07:08", None), ("1709618828", None), ("1709618828000", None), ("1709618828000000", None), ("05/Mar/2024:06:07:08 +0000", None), ("Tue, 05 Mar 2024 06:07:08 +0000", None),
    ("2024/03/05 06:07:08", None), ("2024-03-05T07:07:08+01:00", None), ("05 Mar 2024 06:07:08", None), ("2024-03-05 06:07:08,000", None),
]


@query("SELECT event_id, event_id % " + str(len(_TS)) + " AS form, TIMESTAMP '2024-03-05 06:07:08' AS at FROM events")
def parse_timestamp_forms(spark, sf_dir):
    """Eleven spellings of one instant."""
    texts = F.array(*[F.lit(t) for t, _ in _TS])
    return events(spark, sf_dir).select("event_id", (F.col("event_id") % len(_TS)).alias("form"), D.parse_ts(F.get(texts, (F.col("event_id") % len(_TS)).cast("int"))).alias("at"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN event_id % 3 = 1 THEN TIMESTAMP '2023-12-30 23:59:59' ELSE NULL END AS near,
TIMESTAMP '2024-07-01 10:00:00' AS zoned, TIMESTAMP '2024-01-01 11:00:00' AS winter FROM events""")
def timestamps_without_year_or_zone(spark, sf_dir):
    """The year that puts a date nearest to now; wall-clock times of a zone."""
    e = events(spark, sf_dir)
    text = F.expr("case when event_id % 3 = 0 then 'Jan  2 03:04:05' when event_id % 3 = 1 then 'Dec 30 23:59:59' else 'no time' end")
    return e.select("event_id", D.parse_ts(text, now="2024-01-01 12:00:00").alias("near"), D.parse_ts(F.lit("2024-07-01 12:00:00"), tz="Europe/Berlin").alias("zoned"), D.parse_ts(F.lit("2024-01-01 12:00:00"), tz="Europe/Berlin").alias("winter"))


@query("SELECT event_id, event_type AS ts, CAST(user_id AS VARCHAR) AS level, event_type || '!' AS msg FROM events")
def canonical_fields(spark, sf_dir):
    """The first timestamp, level and message field by name, whatever their order in the row."""
    e = events(spark, sf_dir).select("event_id", F.concat("event_type", F.lit("!")).alias("content"), F.col("user_id").alias("severity"), F.lit("x").alias("time"), F.col("event_type").alias("timestamp"), F.lit("y").alias("body"))
    return e.select("event_id", P.canonical(e, P.TS_NAMES).alias("ts"), P.canonical(e, P.LEVEL_NAMES).alias("level"), P.canonical(e, P.MESSAGE_NAMES).alias("msg"))


# line preparation ------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_id, event_type, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS k FROM events)
SELECT min(event_id) AS first_id, count(*) AS n, md5(string_agg(CASE WHEN event_type = 'purchase' THEN 'head' ELSE '  at ' || event_type END, chr(10) ORDER BY event_id)) AS digest FROM r GROUP BY k""")
def multiline_indent(spark, sf_dir):
    """Indented lines go on with the record before them."""
    e = events(spark, sf_dir).select("event_id", F.expr("if(event_type = 'purchase', 'head', '  at ' || event_type)").alias("line"))
    out = L.multiline(e, "line", "event_id", "indent", joiner="\n")
    return out.select(F.col("event_id").alias("first_id"), F.col("_lines").cast("long").alias("n"), F.md5("line").alias("digest"))


@query("""WITH r AS (SELECT event_id, event_type, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS k FROM events)
SELECT min(event_id) AS first_id, count(*) AS n, md5(string_agg(CASE WHEN event_type = 'purchase' THEN '2024-01-02 03:04:05 head' ELSE event_type END, '' ORDER BY event_id)) AS digest FROM r GROUP BY k""")
def multiline_timestamp(spark, sf_dir):
    """A line that begins with a timestamp begins a record; parts are joined by nothing."""
    e = events(spark, sf_dir).select("event_id", F.expr("if(event_type = 'purchase', '2024-01-02 03:04:05 head', event_type)").alias("line"))
    out = L.multiline(e, "line", "event_id", "timestamp", joiner="")
    return out.select(F.col("event_id").alias("first_id"), F.col("_lines").cast("long").alias("n"), F.md5("line").alias("digest"))


@query("""WITH r AS (SELECT event_id, event_type, coalesce(sum((event_type = 'click')::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended, sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id) AS begun FROM events)
SELECT min(event_id) AS first_id, count(*) AS n, md5(string_agg(event_type, ' ' ORDER BY event_id)) AS digest FROM r GROUP BY ended, begun""")
def multiline_with_end(spark, sf_dir):
    """purchase begins a record, click ends one."""
    out = L.multiline(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", "regex", match="^purchase$", end="^click$")
    return out.select(F.col("event_id").alias("first_id"), F.col("_lines").cast("long").alias("n"), F.md5("event_type").alias("digest"))


@query("SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents WHERE length(text) > 0")
def multiline_all(spark, sf_dir):
    """A document's lines joined to one record, document by document."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    one = L.multiline_all(d, "line", "pos", by=["doc_id"])
    return one.select("doc_id", F.length("line").cast("long").alias("chars"), F.md5("line").alias("digest"))


@query("""WITH m AS (SELECT event_id, event_type = 'purchase' AS s, event_type = 'click' AS e FROM events),
n AS (SELECT *, sum(s::INT) OVER (ORDER BY event_id) AS k FROM m),
w AS (SELECT *, sum(e::INT) OVER (PARTITION BY k ORDER BY event_id) AS ends FROM n)
SELECT event_id, CAST(k AS BIGINT) AS section FROM w WHERE k BETWEEN 1 AND 40 AND NOT s AND (ends = 0 OR (ends = 1 AND e))""")
def sections_after_through(spark, sf_dir):
    """After a start, through an end, the first 40 sections."""
    out = L.sections(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", start="^purchase$", after=True, end="^click$", through=True, most=40)
    return out.select("event_id", F.col("_section").alias("section"))


@query("""WITH f AS (SELECT min(event_id) AS stop FROM events WHERE event_type = 'purchase') SELECT event_id, 1 AS section FROM events, f WHERE event_id < stop""")
def sections_without_start(spark, sf_dir):
    """The stream begins inside a section, which a first purchase ends."""
    out = L.sections(events(spark, sf_dir).select("event_id", "event_type"), "event_type", "event_id", end="^purchase$")
    return out.select("event_id", F.col("_section").cast("int").alias("section"))


@query("""SELECT row_number() OVER (ORDER BY ts, event_id % 2, event_id) AS n, event_id FROM events""")
def merge_sorted_streams(spark, sf_dir):
    """Two streams, each sorted by time, as one; ties go by stream, then line."""
    e = events(spark, sf_dir).select("event_id", "ts")
    merged = L.merge_sorted([L.sorted_stream(e.where(F.col("event_id") % 2 == k), "ts", "event_id") for k in (0, 1)], "ts", "_line")
    return L.numbered(merged, ["ts", "_file_rank", "_line"], "n").select("n", "event_id")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'a' || chr(65533) || 'b' END AS text, substr(event_type, 1, 3) AS cut FROM events""")
def utf8_and_length(spark, sf_dir):
    """Bytes that are no UTF-8 become replacement characters; long lines are cut."""
    raw = F.when(F.col("event_id") % 2 == 0, F.expr("cast('ok' as binary)")).otherwise(F.unhex(F.lit("61FF62")))
    return events(spark, sf_dir).select("event_id", L.check_utf8(raw).alias("text"), L.limit_bytes("event_type", 3).alias("cut"))


@query("SELECT 0 AS rows_read, 'value string' AS head")
def no_input(spark, sf_dir):
    """A run without input has no rows, and its steps run."""
    df = L.no_input(spark).where("length(value) > 1")
    return df.agg(F.count("*").cast("int").alias("rows_read"), F.lit("value string").alias("head"))


_MASKED = [
    ("from 10.{u}.0.7:8080 and 192.168.0.{u}", "from <ipv4_port> and <ipv4>", None), ("peer fe80:0:0:0:1:2:3:{h} up", "peer <ipv6> up", None), ("mail u{i}@example.com now", "mail <email> now", None),
    ("see https://example.com/a/{i}?q=1", "see <url>", None), ("host api{i}.prod.example up", "host <fqdn> up", None), ("id 550e8400-e29b-41d4-a716-{i12} ok", "id <uuid> ok", None), ("mac 00:1A:2B:3C:4D:5E or 001A.2B3C.4D5E", "mac <mac> or <mac>", None),
    ("md5 5d41402abc4b2a76b9719d911017c592", "md5 <md5>", None), ("sha aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d", "sha <sha1>", None), ("big e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "big <sha256>", None),
    ("open /var/log/app/{i}.log", "open <path>", None), ("token ya29.a0Af_{i}", "token <oauth>", None), ("call do_{i}(x, 1) now", "call <function> now", None), ("color #FF00a0 here", "color <hexcolor> here", None), ("release v1.2.{u} out", "release <version> out", None),
    ("at 0xdeadBEEF", "at <hexnum>", "hexnum"), ("took {u}ms then 2 hours then 1h30m5s", "took <duration> then <duration> then <duration>", "duration"), ("got -42.5 and 1.23e-10 and {i}", "got <num> and <num> and <num>", "num"),
    ("card 4111-1111-1111-1111 not 4111111111111112", "card <credit_card> not 4111111111111112", "credit_card"), ("ssn 123-45-6789 not 999-99-9999", "ssn <ssn> not 999-99-9999", "ssn"),
    ("call (212) 555-7890 or +1-415-555-2671 not 055-234-5678", "call <phone> or <phone> not 055-234-5678", "phone"), ("email: user@example.com color: #FF0000", "email: <email> color: <hexcolor>", "email,hexcolor"),
]


@query("SELECT event_id, CASE event_id % " + str(len(_MASKED)) + " " + " ".join(f"WHEN {k} THEN '{want}'" for k, (_, want, _) in enumerate(_MASKED)) + " END AS text FROM events")
def masked_kinds(spark, sf_dir):
    """Every kind of mask, values from the rows."""
    e = events(spark, sf_dir)
    k, out = F.col("event_id") % len(_MASKED), None
    values = {"u": F.col("user_id") % 250, "i": F.col("event_id"), "h": F.hex(F.col("event_id") % 65536), "i12": F.lpad(F.col("event_id").cast("string"), 12, "0")}
    for i, (template, _, kinds) in enumerate(_MASKED):
        parts = [values[p[1:-1]].cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
        one = MK.normalized(F.concat(*parts), kinds)
        out = F.when(k == i, one) if out is None else out.when(k == i, one)
    return e.select("event_id", out.alias("text"))


@query("""SELECT event_id, 'from <ipv4>' AS a, ['<email>', event_type] AS b, 'x <hexcolor>' AS c, user_id FROM events""")
def masked_fields(spark, sf_dir):
    """Texts inside structs and arrays too; numbers stay."""
    rows = events(spark, sf_dir).select("event_id", F.lit("from 10.0.0.1").alias("a"), F.array(F.lit("u@example.com"), "event_type").alias("b"), F.struct(F.lit("x #00FF00").alias("c"), F.col("user_id").alias("n")).alias("s"))
    out = MK.normalized_fields(rows)
    return out.select("event_id", "a", "b", "s.c", F.col("s.n").alias("user_id"))
