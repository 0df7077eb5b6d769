"""Registered queries of functions, event steps, metrics and outputs, beside those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import datetime as D
from ..functions import encode as N
from ..functions import extract as X
from ..functions import maps as M
from ..functions import mathx as MX
from ..functions import strings as S
from ..functions import user as U
from ..operators import drain as DR
from ..operators import events as EV
from ..operators import metrics as ME
from ..operators import outputs as O
from ..operators import spans as SP
from ..operators import state as ST
from ..operators import timeargs
from ..sources import formats as P
from .queries import events, query, table

# strings ---------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type AS mid, CAST(user_id AS VARCHAR) AS second, '' AS none, '[' || user_id || '] z' AS from2, 'x[' || event_type || '] y[' AS thru, 'x[' || event_type || ']' AS thru1, event_type || '] y[' || user_id || '] z' AS rest FROM events""")
def text_between(spark, sf_dir):
    """between, starting_with, ending_with with and without nth."""
    e = events(spark, sf_dir).select("event_id", F.expr("'x[' || event_type || '] y[' || user_id || '] z'").alias("t"))
    return e.select("event_id", S.between("t", "[", "]").alias("mid"), S.between("t", "[", "]", 2).alias("second"), S.between("t", "<", "]").alias("none"), S.starting_with("t", "[", -1).alias("from2"), S.ending_with("t", "[").alias("thru"), S.ending_with("t", "]", 1).alias("thru1"), S.between("t", "[", "").alias("rest"))


@query("""SELECT event_id, event_type || ' x' AS a, event_type || ' x  ' AS b, chr(9) || ' ' || event_type || ' x' AS c, event_type AS d, event_type AS e, event_type || '!!' AS f, '--' || event_type AS g FROM events""")
def text_strips(spark, sf_dir):
    """strip, lstrip, rstrip of white space and of characters; clip and its sides."""
    e = events(spark, sf_dir).select("event_id", F.expr("'\\t ' || event_type || ' x  '").alias("w"), F.expr("'--' || event_type || '!!'").alias("p"))
    return e.select("event_id", S.strip("w").alias("a"), S.lstrip("w").alias("b"), S.rstrip("w").alias("c"), S.strip("p", "-!").alias("d"), S.clip("p").alias("e"), S.lclip("p").alias("f"), S.rclip("p").alias("g"))


@query("""SELECT event_id, event_type || '-' || user_id || '-' AS joined, event_type IN ('click', 'view') AS hit, string_split_regex(event_type || '1' || user_id % 10 || 'z', '[0-9]+') AS parts, [event_type, 'z'] AS words, 3 AS n_maps FROM events""")
def text_regex_forms(spark, sf_dir):
    """join, matches, split_regex, extract_regexes with groups, extract_regex_maps."""
    e = events(spark, sf_dir)
    t = F.expr("event_type || '1' || (user_id % 10) || 'z'")
    joined = S.join(F.array("event_type", F.col("user_id").cast("string"), F.lit("")), "-")
    pairs = S.extract_regexes(F.expr("'k=' || event_type || ' l=z'"), r"(\w)=(\w+)")
    maps = S.extract_regex_maps(F.lit("a1 b2 c3"), r"([a-z])\d", "letter")
    return e.select("event_id", joined.alias("joined"), S.matches("event_type", "^(click|view)$").alias("hit"), S.split_regex(t, "[0-9]+").alias("parts"), F.transform(pairs, lambda p: F.get(p, 1)).alias("words"), F.size(F.filter(maps, lambda m: m["letter"].isin("a", "b", "c"))).alias("n_maps"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || ' B' AS small, printf('%.1f KiB', (1024 + event_id % 1000) / 1024.0) AS kib, printf('%.1f MB', 1.5) AS mb, printf('%.1f%%', (user_id % 7) * 10.0) AS pct,
event_type || repeat('.', 12 - length(event_type)) AS l, repeat('█', CAST(user_id % 5 AS INTEGER)) AS bar, '▂▄█ ' AS spark FROM events WHERE event_id < 1000""")
def text_display(spark, sf_dir):
    """human_bytes, human_bytes_si, format_percent, ljust, bar, sparkline."""
    e = events(spark, sf_dir).where("event_id < 1000")
    return e.select("event_id", S.human_bytes("event_id").alias("small"), S.human_bytes(1024 + F.col("event_id") % 1000).alias("kib"), S.human_bytes_si(F.lit(1_500_000)).alias("mb"), S.format_percent((F.col("user_id") % 7) / 10).alias("pct"), S.ljust("event_type", 12, ".").alias("l"), S.bar(F.col("user_id") % 5, 10, 10).alias("bar"), S.sparkline(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0), F.lit(0.0))).alias("spark"))


@query("""SELECT event_id, repeat('*', CAST((11 - length(event_type)) // 2 AS INTEGER)) || event_type || repeat('*', CAST(11 - length(event_type) - (11 - length(event_type)) // 2 AS INTEGER)) AS mid,
left(event_type || user_id, 3) || '…' || right(event_type || user_id, 2) AS short, event_type[2:4] AS sub, starts_with(event_type, 'c') AS st, ends_with(event_type, 'k') AS en, replace(event_type, 'c', 'CC') AS rep, len(event_type) AS n FROM events WHERE length(event_type || user_id) > 6""")
def text_builtins(spark, sf_dir):
    """center, shorten_middle, sub_string, starts_with, ends_with, replace, length."""
    e = events(spark, sf_dir).withColumn("t", F.expr("event_type || user_id")).where("length(t) > 6")
    return e.select("event_id", S.center("event_type", 11, "*").alias("mid"), S.shorten_middle("t", 6).alias("short"), S.sub_string("event_type", 1, 3).alias("sub"), S.starts_with("event_type", "c").alias("st"), S.ends_with("event_type", "k").alias("en"), S.replace("event_type", "c", "CC").alias("rep"), S.length("event_type").alias("n"))


# extraction ------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, '10.0.0.' || (user_id % 250) AS ip, ['10.0.0.' || (user_id % 250), '192.168.1.1'] AS ips, '192.168.1.1' AS last_ip, 'https://h.org/' || event_type AS url, 'http://x.net/a' AS url2,
'u' || event_id || '@ex.org' AS mail, 2 AS n_mail, '{"a":' || user_id || '}' AS js, '[1,2]' AS js2 FROM events""")
def extract_values(spark, sf_dir):
    """Addresses, links, mails and JSON in a text, the first, the nth, all."""
    e = events(spark, sf_dir).select("event_id", F.expr("""'from 10.0.0.' || (user_id % 250) || ' via 192.168.1.1, see https://h.org/' || event_type || '. or (http://x.net/a) mail u' || event_id || '@ex.org, b@c.io {"a":' || user_id || '} then [1,2] end'""").alias("t"))
    return e.select("event_id", X.extract_ip("t").alias("ip"), X.extract_ips("t").alias("ips"), X.extract_ip("t", -1).alias("last_ip"), X.extract_url("t").alias("url"), X.extract_url("t", 2).alias("url2"), X.extract_email("t").alias("mail"), F.size(X.extract_emails("t")).alias("n_mail"), X.extract_json("t").alias("js"), X.extract_json("t", 2).alias("js2"))


@query("""SELECT event_id, event_type AS first, CAST(user_id AS VARCHAR) AS last, event_type || ' ' || user_id AS two, 'mid ' || user_id AS tail, [event_type, '', CAST(user_id AS VARCHAR)] AS several, 'mid' AS piped, (200 + event_id % 300) // 100 || 'xx' AS cls FROM events""")
def extract_columns(spark, sf_dir):
    """col and cols by index, list and range; status_class."""
    e = events(spark, sf_dir).select("event_id", F.expr("event_type || '  mid ' || user_id").alias("t"), F.expr("event_type || '|mid|' || user_id").alias("p"))
    return e.select("event_id", X.col("t", "0").alias("first"), X.col("t", "-1").alias("last"), X.col("t", "0,2").alias("two"), X.col("t", "1:").alias("tail"), X.cols("t", 0, 7, -1).alias("several"), X.col("p", "1", "|").alias("piped"), MX.status_class(200 + F.col("event_id") % 300).alias("cls"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS a, 'x y!' AS b, '' AS c, 'https' AS scheme, 'u' AS usr, 'p' AS pw, 'h.org' AS host, '8443' AS port, '/' || event_type AS path, 'q=' || user_id AS query, CAST(user_id AS VARCHAR) AS q, 'frag' AS fragment, 'rel/x' AS rel FROM events""")
def parse_urls(spark, sf_dir):
    """All parts of a URL, its parameters decoded, the first of equal ones."""
    e = events(spark, sf_dir).select("event_id", "event_type", "user_id", F.expr("'HTTPS://u:p@H.org:8443/' || event_type || '?q=' || user_id || '#frag'").alias("t"), F.expr("'?a=' || user_id || '&a=2&b=x+y%21&c'").alias("q"))
    u, q = X.parse_url("t"), X.parse_query_params("q")
    return e.select("event_id", q["a"].alias("a"), q["b"].alias("b"), q["c"].alias("c"), u["scheme"].alias("scheme"), u["user"].alias("usr"), u["pass"].alias("pw"), u["host"].alias("host"), u["port"].alias("port"), u["path"].alias("path"), u["query"].alias("query"), u["query_map"]["q"].alias("q"), u["fragment"].alias("fragment"), X.parse_url(F.lit("rel/x?y"))["path"].alias("rel"))


@query("""SELECT event_id, event_type || '.x' AS local, 'ex.org' AS domain, 'log' AS ext, event_type AS stem, event_type || '.log' AS name, '/var/log' AS parent, true AS absolute, ['/', 'var', 'log', event_type || '.log'] AS comps,
'text' AS mt, 'html' AS sub, 'utf-8' AS charset, 'json' AS suffix, 'attachment' AS disp, event_type || '.txt' AS filename FROM events""")
def parse_mail_path_media(spark, sf_dir):
    """parse_email, parse_path, parse_media_type, parse_content_disposition."""
    e = events(spark, sf_dir)
    m, p = X.parse_email(F.expr("event_type || '.x@EX.org'")), X.parse_path(F.expr("'/var/./log/' || event_type || '.log'"))
    t, d = X.parse_media_type(F.lit('Text/HTML; charset="utf-8"')), X.parse_content_disposition(F.expr("'attachment; filename=\"' || event_type || '.txt\"'"))
    return e.select("event_id", m["local"].alias("local"), m["domain"].alias("domain"), p["extension"].alias("ext"), p["stem"].alias("stem"), p["file_name"].alias("name"), p["parent"].alias("parent"), p["is_absolute"].alias("absolute"), p["components"].alias("comps"), t["type"].alias("mt"), t["subtype"].alias("sub"), t["params"]["charset"].alias("charset"), X.parse_media_type(F.lit("application/ld+json"))["suffix"].alias("suffix"), d["disposition"].alias("disp"), d["filename"].alias("filename"))


_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.1 Safari/537.36", "Chrome", "120.0.1", "Windows", "10.0", "desktop"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15", "Safari", "17.1", "macOS", "10.15.7", "desktop"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0", "Firefox", "121.0", "Linux", None, "desktop"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1", "Safari", "17.1", "iOS", "17.1", "mobile"),
    ("Mozilla/5.0 (Linux; Android 13; Pixel 7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Mobile Safari/537.36", "Chrome", "119.0.0.0", "Android", "13", "mobile"),
    ("curl/8.4.0", "curl", "8.4.0", None, None, "desktop"),
]


@query("SELECT event_id, a AS agent, v AS version, o AS os, s AS os_version, d AS device FROM events JOIN (VALUES " + ", ".join("(" + str(i) + ", " + ", ".join("NULL" if x is None else f"'{x}'" for x in r[1:]) + ")" for i, r in enumerate(_AGENTS)) + ") t(k, a, v, o, s, d) ON event_id % 6 = k")
def parse_user_agents(spark, sf_dir):
    """Browser, system and device of six agents."""
    texts = F.array(*[F.lit(r[0]) for r in _AGENTS])
    r = events(spark, sf_dir).select("event_id", X.parse_user_agent(F.get(texts, (F.col("event_id") % 6).cast("int"))).alias("r"))
    return r.select("event_id", F.col("r.agent_family").alias("agent"), F.col("r.agent_version").alias("version"), F.col("r.os_family").alias("os"), F.col("r.os_version").alias("os_version"), "r.device")


@query("""SELECT event_id, 'HS256' AS alg, 'JWT' AS typ, CAST(user_id AS VARCHAR) AS sub, to_timestamp(1700000000) AT TIME ZONE 'UTC' AS expires, CASE WHEN event_id % 2 = 0 THEN 'sig' END AS signature, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS absorbed,
CASE WHEN event_id % 2 = 0 THEN 'applied' ELSE 'parse_error' END AS status FROM events""")
def parse_and_absorb_jwt(spark, sf_dir):
    """A token's header and claims; a text that is none."""
    b64 = lambda c: F.regexp_replace(F.translate(N.encode_b64(c), "+/", "-_"), "=+$", "")
    token = F.concat(b64(F.lit('{"alg":"HS256","typ":"JWT"}')), F.lit("."), b64(F.expr("""'{"sub":"' || user_id || '","exp":1700000000}'""")), F.lit(".sig"))
    e = events(spark, sf_dir).select("event_id", token.alias("whole"), F.when(F.col("event_id") % 2 == 0, token).otherwise("a.b").alias("token"))
    out = X.absorb_jwt(e, "token", ["sub"], keep_source=True)
    j, k = X.parse_jwt("whole"), X.parse_jwt("token")
    return out.select("event_id", j["alg"].alias("alg"), j["typ"].alias("typ"), F.get_json_object(j["claims"], "$.sub").alias("sub"), j["expires_at"].alias("expires"), k["signature_b64u"].alias("signature"), F.col("sub").alias("absorbed"), F.col("absorb_status").alias("status"))


@query("""SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS usr, CASE WHEN event_id % 3 = 0 THEN 'bare' WHEN event_id % 3 = 1 THEN '  ' END AS text, CASE event_id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'empty' ELSE 'missing_field' END AS status FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, NULL, NULL, CASE WHEN event_id % 3 = 1 THEN '  ' END, CASE event_id % 3 WHEN 1 THEN 'empty' ELSE 'missing_field' END FROM events WHERE event_id % 3 <> 0""")
def absorb_pairs(spark, sf_dir):
    """The pairs of a text become fields, what is no pair stays; a status tells why nothing did."""
    text = F.expr("case event_id % 3 when 0 then 'kind=' || event_type || ' bare usr=' || user_id when 1 then '  ' end")
    out = X.absorb_kv(events(spark, sf_dir).select("event_id", text.alias("text")), "text", ["kind", "usr"])
    return out.select("event_id", "kind", "usr", "text", F.col("absorb_status").alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS VARCHAR) END AS k, CASE WHEN event_id % 2 = 0 THEN 'applied' ELSE 'parse_error' END AS a, event_type AS kind, 'applied' AS b, CASE WHEN event_type = 'click' THEN 'cl' END AS lead, CASE WHEN event_type = 'click' THEN 'applied' ELSE 'parse_error' END AS c FROM events""")
def absorb_other_forms(spark, sf_dir):
    """absorb_json, absorb_logfmt, absorb_regex."""
    e = events(spark, sf_dir).select("event_id", F.expr("if(event_id % 2 = 0, props, 'no json')").alias("j"), F.expr("'kind=\"' || event_type || '\"'").alias("l"), F.col("event_type").alias("r"))
    a = X.absorb_json(e, "j", ["k"]).withColumnRenamed("absorb_status", "a")
    b = X.absorb_logfmt(a, "l", ["kind"]).withColumnRenamed("absorb_status", "b")
    c = X.absorb_regex(b, "r", r"^(?P<lead>cl)ick")
    return c.select("event_id", "k", "a", "kind", "b", "lead", F.col("absorb_status").alias("c"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS kind, event_id % 2 = 0 AS is_json FROM events")
def parse_maps(spark, sf_dir):
    """parse_json to any shape, parse_logfmt and parse_kv with other separators."""
    e = events(spark, sf_dir)
    kv = X.parse_kv(F.expr("'a:1;kind:' || event_type"), ";", ":")
    v = P.json_variant(F.expr("if(event_id % 2 = 0, props, 'x' || props)"))
    return e.select("event_id", F.variant_get(P.json_variant("props"), "$.k", "string").alias("k"), kv["kind"].alias("kind"), v.isNotNull().alias("is_json"))


# encodings, networks -----------------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_type AS b, event_type AS h, event_type || ' &é' AS u, '&lt;' || event_type || '&gt; &amp; &quot;' AS esc, '<' || event_type || '> & "é' AS unesc, event_type || '\\n\\"' AS jesc, event_type || chr(10) || '"' AS junesc, '{"a":"' || event_type || '","b":' || user_id || '}' AS js FROM events""")
def decodings(spark, sf_dir):
    """Round trips of base64, hex and URL codes; HTML and JSON escapes."""
    e = events(spark, sf_dir)
    return e.select("event_id", N.decode_b64(N.encode_b64("event_type")).alias("b"), N.decode_hex(N.encode_hex("event_type")).alias("h"), N.decode_url(N.encode_url(F.concat("event_type", F.lit(" &é")))).alias("u"), N.escape_html(F.expr("'<' || event_type || '> & \"'")).alias("esc"), N.unescape_html(F.expr("'&lt;' || event_type || '&gt; &amp; &quot;&eacute;'")).alias("unesc"), N.escape_json(F.expr("event_type || '\\n\"'")).alias("jesc"), N.unescape_json(F.expr("event_type || '\\\\n\\\\\"'")).alias("junesc"), N.to_json(F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("b"))).alias("js"))


@query("""SELECT event_id, user_id % 4 = 0 AS v4, user_id % 4 = 1 AS v6, user_id % 4 IN (0, 1) AS private, user_id % 4 = 1 AS in6, CASE user_id % 4 WHEN 0 THEN '10.1.0.0' WHEN 1 THEN 'fd00::1:0' WHEN 2 THEN 'nope' ELSE '::ffff:zz' END AS masked FROM events""")
def addresses(spark, sf_dir):
    """is_ipv4, is_ipv6, is_private_ip, is_in_cidr and mask_ip over both versions and other texts."""
    e = events(spark, sf_dir).select("event_id", "user_id", F.expr("case user_id % 4 when 0 then '10.1.2.3' when 1 then 'fd00::1:2' when 2 then 'nope' else '::ffff:zz' end").alias("a"))
    v6 = F.when(F.col("user_id") % 4 == 1, F.col("a")).otherwise("2001:db8::5")
    return e.select("event_id", N.is_ipv4("a").alias("v4"), N.is_ipv6("a").alias("v6"), N.is_private_ip("a").alias("private"), N.is_in_cidr(v6, "fd00::/8").alias("in6"), F.when(F.col("user_id") % 4 == 0, N.mask_ip("a", 2)).otherwise(N.mask_ip("a")).alias("masked"))


@query("""SELECT count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT event_type) AS hashes, count(DISTINCT event_type) AS buckets, count(DISTINCT event_type) AS names, count(DISTINCT event_type) * 2 AS both, 24 AS chars, 16 AS digits FROM events""")
def hashes_and_pseudonyms(spark, sf_dir):
    """Stable per value, one for each value, different across domains, of fixed lengths."""
    e = events(spark, sf_dir).select("event_type", N.hash_text("event_type", "xxh3").alias("h"), N.bucket("event_type").alias("b"), N.pseudonym("event_type", "a", "secret").alias("p"), N.pseudonym("event_type", "b", "secret").alias("q"))
    return e.agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.countDistinct("h").alias("hashes"), F.countDistinct("b").alias("buckets"), F.countDistinct("p").alias("names"), F.size(F.array_union(F.collect_set("p"), F.collect_set("q"))).cast("long").alias("both"), F.max(F.length("p")).alias("chars"), F.max(F.length("h")).alias("digits"))


# arrays, maps ------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, ['2', '10', CAST(100 + user_id AS VARCHAR), 'b'] AS sorted, ['b', '2', CAST(100 + user_id AS VARCHAR), '10'] AS rev, ['10', '2'] AS every2, ['10', CAST(100 + user_id AS VARCHAR), '2', 'b'] AS uniq, user_id = 7 AS anyc, true AS st, [CAST(user_id AS VARCHAR)] AS big,
['a', 'b', 'c'] AS by_field, CASE WHEN user_id > 10 THEN 'low' ELSE 'high' END AS first_by FROM events""")
def array_order(spark, sf_dir):
    """sorted (numbers first), reversed, slice, unique, contains_any, starts_with_any, sorted_by."""
    e = events(spark, sf_dir)
    a = F.array(F.lit("10"), (100 + F.col("user_id")).cast("string"), F.lit("2"), F.lit("b"))
    items = F.array(F.struct(F.lit("b").alias("k"), F.lit(2).alias("v")), F.struct(F.lit("c").alias("k"), F.lit(3).alias("v")), F.struct(F.lit("a").alias("k"), F.lit(1).alias("v")))
    mixed = F.array(F.struct(F.lit("low").alias("k"), F.lit(10).cast("long").alias("v")), F.struct(F.lit("high").alias("k"), F.col("user_id").alias("v")))
    return e.select("event_id", A.sorted_(a).alias("sorted"), A.reversed_(a).alias("rev"), A.slice_(a, "::2").alias("every2"), A.unique(F.concat(a, a)).alias("uniq"), A.contains_any(a, ["107", "zz"]).alias("anyc"), A.starts_with_any(a, [10]).alias("st"), A.filter_(F.array(F.col("user_id").cast("string"), F.lit("")), lambda x: x != "").alias("big"), A.pluck(A.sorted_by(items, "v"), "k").alias("by_field"), F.when(F.col("user_id") == 10, F.lit("high")).otherwise(F.get(A.sorted_by(mixed, "v"), 0)["k"]).alias("first_by"))


@query("""SELECT vec_id, round(list_stddev_pop(embedding::DOUBLE[]), 6) AS sd, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x * 2, 4))[1:3] AS doubled, round(list_sum(embedding::DOUBLE[]), 6) AS total, list_max(embedding) < 100 AS every, list_max(embedding) > 0.5 AS some, len(embedding) + 1 AS pushed, len(embedding) - 1 AS popped, true AS has, round(list_sum(CAST(embedding AS DOUBLE[])[1:2]), 6) AS mixed FROM embeddings""")
def array_higher_order(spark, sf_dir):
    """stddev, map, reduce, all, some, push, pop, contains, pluck_as_nums of mixed items."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    items = F.array(F.struct(F.get("a", 0).cast("string").alias("x")), F.struct(F.lit("no number").alias("x")), F.struct(F.get("a", 1).cast("string").alias("x")))
    return v.select("vec_id", MX.round_(A.stddev("a"), 6).alias("sd"), F.slice(A.map_("a", lambda x: MX.round_(x * 2, 4)), 1, 3).alias("doubled"), MX.round_(A.reduce_("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), A.all_("a", lambda x: x < 100).alias("every"), A.some("a", lambda x: x > 0.5).alias("some"), F.size(A.push("a", F.lit(1.0))).cast("long").alias("pushed"), F.size(A.pop("a")).cast("long").alias("popped"), A.contains("a", F.get("a", 2)).alias("has"), MX.round_(A.sum_(A.pluck_as_nums(items, "x")), 6).alias("mixed"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS deep, 'x' AS item, 4 AS n, event_type AS und, '{"a":{"b":"' || event_type || '","c":["x","' || user_id || '"]}}' AS nested, '{"u":' || user_id || '}' AS shallow FROM events""")
def flatten_and_unflatten(spark, sf_dir):
    """Nested JSON as one level of paths in three styles and to a depth, and paths as nested JSON."""
    e = events(spark, sf_dir).select("event_id", "event_type", "user_id", F.expr("""'{"a":{"b":[{"u":' || user_id || '},"x"]},"e":[],"t":"' || event_type || '"}'""").alias("j"))
    f = A.flattened("j")
    m = F.create_map(F.lit("a_b"), F.col("event_type"), F.lit("a_c_0"), F.lit("x"), F.lit("a_c_1"), F.col("user_id").cast("string"))
    return e.select("event_id", f["a.b[0].u"].alias("deep"), A.flattened("j", "dot")["a.b.1"].alias("item"), F.size(F.map_keys(f)).alias("n"), A.flattened("j", "underscore")["t"].alias("und"), M.unflatten(m).alias("nested"), M.get_path(A.flattened("j", "bracket", 1)["a"], "b[0]").alias("shallow"))


@query("""SELECT event_id, json_extract_string(props, '$.k') = '5' AS eq, true AS has_t, false AS has_z, event_type AS got, 'none' AS missing, ['t'] AS kept, ['u'] AS dropped, event_type AS renamed, 'new' AS merged, event_type AS enriched, CAST(user_id AS VARCHAR) AS added, 't:' || event_type || ';u:' || user_id AS kv FROM events""")
def map_editing(spark, sf_dir):
    """path_equals, has, get, keep, drop, rename_field, merge, enrich, to_kv."""
    m = F.create_map(F.lit("t"), F.col("event_type"), F.lit("u"), F.col("user_id").cast("string"))
    other = F.create_map(F.lit("t"), F.lit("new"), F.lit("v"), F.col("user_id").cast("string"))
    e = events(spark, sf_dir)
    return e.select("event_id", M.path_equals("props", "k", "5").alias("eq"), M.has(m, "t").alias("has_t"), M.has(m, "z").alias("has_z"), M.get(m, "t").alias("got"), M.get(m, "z", "none").alias("missing"), F.map_keys(M.keep(m, ["t"])).alias("kept"), F.map_keys(M.drop(m, ["t"])).alias("dropped"), M.rename_field(m, "t", "x")["x"].alias("renamed"), M.merge(m, other)["t"].alias("merged"), M.enrich(m, other)["t"].alias("enriched"), M.enrich(m, other)["v"].alias("added"), M.to_kv(m, ";", ":").alias("kv"))


@query("""SELECT event_id, '<' || (user_id % 192) || '>Mar  5 06:07:08 h' || user_id || ' app[' || event_id || ']: ' || event_type AS syslog, 'CEF:0|v|p' || chr(92) || '|q|1|7|' || event_type || '|5|usr=' || user_id || ' k=a' || chr(92) || '=b' AS cef,
'10.0.0.1 - - [05/Mar/2024:06:07:08 +0000] "GET /' || event_type || ' HTTP/1.1" 200 ' || user_id || ' "-" "ua"' AS combined FROM events""")
def lines_from_fields(spark, sf_dir):
    """to_syslog, to_cef, to_combined."""
    at, e = F.expr("timestamp'2024-03-05 06:07:08'"), events(spark, sf_dir)
    ext = F.create_map(F.lit("usr"), F.col("user_id").cast("string"), F.lit("k"), F.lit("a=b"))
    lit = lambda x: F.lit(x)
    return e.select("event_id", M.to_syslog(F.col("user_id") % 192, at, F.expr("'h' || user_id"), lit("app"), F.col("event_id"), F.col("event_type")).alias("syslog"), M.to_cef(lit("v"), lit("p|q"), lit("1"), lit("7"), F.col("event_type"), lit("5"), ext).alias("cef"), M.to_combined(lit("10.0.0.1"), at, F.expr("'GET /' || event_type || ' HTTP/1.1'"), lit(200), F.col("user_id"), F.lit(None).cast("string"), lit("ua")).alias("combined"))


# datetimes, numbers --------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, TIMESTAMP '2024-03-05 06:07:08' AS a, TIMESTAMP '2024-03-05 05:07:08' AS b, NULL::TIMESTAMP AS c, date_trunc('hour', ts) + CASE WHEN ts > date_trunc('hour', ts) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS up,
strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(extract(millisecond FROM ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, timezone('Europe/Berlin', timezone('UTC', ts)) AS berlin, 'Europe/Berlin' AS zone,
CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, hour(timezone('Europe/Berlin', timezone('UTC', ts)))::INTEGER AS h2 FROM events""")
def datetime_forms(spark, sf_dir):
    """to_datetime with a format and a zone, ceil_to, to_iso, to_timezone, all parts."""
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    z = D.to_timezone("ts", "Europe/Berlin")
    parts = [D.part("ts", n).alias(a) for n, a in (("month", "mo"), ("day", "d"), ("hour", "h"), ("minute", "mi"), ("second", "s"))]
    return e.select("event_id", D.to_datetime(F.lit("05.03.2024 06h07:08"), "%d.%m.%Y %Hh%M:%S").alias("a"), D.to_datetime(F.lit("2024-03-05 06:07:08"), "%Y-%m-%d %H:%M:%S", "Europe/Berlin").alias("b"), D.to_datetime(F.lit("no"), "%Y").alias("c"), D.ceil_to("ts", D.NS["h"]).alias("up"), D.to_iso("ts").alias("iso"), z["local"].alias("berlin"), z["tz"].alias("zone"), *parts, D.part("ts", "hour", "Europe/Berlin").alias("h2"))


@query("""SELECT event_id, user_id * 1000000000 AS sec, user_id * 60000000000 AS mins, user_id * 3600000000000 AS hours, user_id * 86400000000000 AS days, user_id * 1000000 AS ms, user_id AS back_s, user_id * 1000 AS back_ms, user_id // 60 AS back_m, user_id // 3600 AS back_h, user_id // 86400 AS back_d, '1h 1m 1s' AS shown, '-2d 5ms' AS neg,
ts - INTERVAL 90 MINUTE AS earlier, 5400000000000 AS diff, 4000000000 AS dd, user_id * 3000000000 AS times, user_id * 500000000 AS over, true AS less FROM events""")
def durations(spark, sf_dir):
    """Durations from and to units, as text, and arithmetic with datetimes."""
    e = events(spark, sf_dir).withColumn("d", F.col("user_id") * 1_000_000_000)
    of = [D.duration_from("user_id", u).alias(n) for u, n in (("s", "sec"), ("m", "mins"), ("h", "hours"), ("d", "days"), ("ms", "ms"))]
    back = [D.duration_as("d", u).alias(n) for u, n in (("s", "back_s"), ("ms", "back_ms"), ("m", "back_m"), ("h", "back_h"), ("d", "back_d"))]
    return e.select("event_id", *of, *back, D.humanize_duration(F.lit(3_661_000)).alias("shown"), D.humanize_duration(F.lit(-172_800_005)).alias("neg"), D.minus("ts", 90 * D.NS["m"]).alias("earlier"), D.difference(F.col("ts"), D.plus("ts", 90 * D.NS["m"])).alias("diff"), D.duration_difference(F.lit(1_000_000_000), F.lit(5_000_000_000)).alias("dd"), D.duration_times("d", 3).alias("times"), D.duration_over("d", 2).alias("over"), (F.col("ts") < D.plus("ts", 1000)).alias("less"))


@query("""SELECT event_id, 1234.5 AS f, 1234567.25 AS de, user_id AS io, 7 AS idef, 2.5 AS fdef, true AS bdef, 'bigint' AS ty, 'dflt' AS env, true AS in_range, true AS in_unit, abs(user_id - 50) AS ab, CAST(floor(value) AS BIGINT) AS fl, CAST(ceil(value) AS BIGINT) AS ce, round(sqrt(user_id), 6) AS sq, round(sin(user_id), 6) AS si, round(ln(user_id + 1), 6) AS lo, 0 AS mz, -1 AS mn FROM events""")
def number_forms(spark, sf_dir):
    """to_float with separators, the _or forms, type_of, get_env, rand and rand_int in range, mathematics."""
    e = events(spark, sf_dir)
    r = MX.rand_int(3, 5, 1)
    return e.select("event_id", MX.to_float(F.lit("1,234.5"), ",").alias("f"), MX.to_float(F.lit("1.234.567,25"), ".", ",").alias("de"), MX.to_int_or(F.col("user_id").cast("string"), 7).alias("io"), MX.to_int_or(F.lit("x"), 7).cast("int").alias("idef"), MX.to_float_or(F.lit("1.2.3"), 2.5).alias("fdef"), MX.to_bool_or(F.lit("maybe"), True).alias("bdef"), MX.type_of("user_id").alias("ty"), MX.get_env("EVENTLENS_NO_SUCH", "dflt").alias("env"), r.between(3, 5).alias("in_range"), ((MX.rand(2) >= 0) & (MX.rand(3) < 1)).alias("in_unit"), MX.abs_(F.col("user_id") - 50).alias("ab"), MX.floor("value").alias("fl"), MX.ceiling("value").alias("ce"), MX.round_(MX.sqrt("user_id"), 6).alias("sq"), MX.round_(MX.sin("user_id"), 6).alias("si"), MX.round_(MX.log(F.col("user_id") + 1), 6).alias("lo"), MX.mod(F.lit(7), 0).alias("mz"), MX.mod(F.lit(-7), 3).alias("mn"))


@query("SELECT count(*) AS n, true AS near, true AS whole_keys FROM events")
def samples_by_probability(spark, sf_dir):
    """A fifth of the rows, within six standard deviations; by key, all of a key's rows or none."""
    e = events(spark, sf_dir).withColumns({"a": MX.sample_prob(0.2, 5).cast("int"), "b": MX.sample_key("user_id", 0.5).cast("int")})
    per = e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    near = F.abs(F.sum("a") - 0.2 * F.sum("n")) <= 6 * F.sqrt(0.16 * F.sum("n"))
    return per.agg(F.sum("n").alias("n"), near.alias("near"), F.bool_and(F.col("lo") == F.col("hi")).alias("whole_keys"))


# event steps ---------------------------------------------------------------------------------------------------------------


@query("""SELECT a, round(epoch(t - TIMESTAMP '2024-05-06 12:00:00')) AS seconds FROM (VALUES ('1h', TIMESTAMP '2024-05-06 11:00:00'), ('+30m', TIMESTAMP '2024-05-06 12:30:00'), ('2 days ago', TIMESTAMP '2024-05-04 12:00:00'), ('today', TIMESTAMP '2024-05-06 00:00:00'), ('yesterday', TIMESTAMP '2024-05-05 00:00:00'),
('tomorrow', TIMESTAMP '2024-05-07 00:00:00'), ('now-90s', TIMESTAMP '2024-05-06 11:58:30'), ('2024-01-02', TIMESTAMP '2024-01-02 00:00:00'), ('2024-01-02T03:04:05+01:00', TIMESTAMP '2024-01-02 02:04:05'), ('08:30', TIMESTAMP '2024-05-06 08:30:00'), ('1714990000', TIMESTAMP '2024-05-06 10:06:40'), ('since+2h', TIMESTAMP '2024-05-06 02:00:00')) v(a, t)""")
def time_arguments(spark, sf_dir):
    """Every form of a time argument, against a fixed now."""
    from datetime import UTC, datetime

    now = datetime(2024, 5, 6, 12, tzinfo=UTC)
    forms = ["1h", "+30m", "2 days ago", "today", "yesterday", "tomorrow", "now-90s", "2024-01-02", "2024-01-02T03:04:05+01:00", "08:30", "1714990000"]
    rows = [(a, float(round((timeargs.resolve(a, now) - now).total_seconds()))) for a in forms]
    rows.append(("since+2h", (timeargs.resolve_range("today", "since+2h", now)[1] - now).total_seconds()))
    return spark.createDataFrame(rows, "a string, seconds double")


@query("""WITH h AS (SELECT event_id, event_type = 'purchase' AND value > 95 AS hit FROM events),
w AS (SELECT event_id, hit, coalesce(max(hit::INT) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 0) AS b, coalesce(max(hit::INT) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS a FROM h)
SELECT event_id, CASE WHEN hit THEN 'match' WHEN b = 1 AND a = 1 THEN 'both' WHEN b = 1 THEN 'before' ELSE 'after' END AS context_type FROM w WHERE hit OR b = 1 OR a = 1""")
def context_of_levels(spark, sf_dir):
    """Neighbours of events by their level."""
    e = events(spark, sf_dir).withColumn("level", F.expr("if(event_type = 'purchase' and value > 95, 'ERROR', 'info')"))
    return EV.level_context(e, "event_id", before=1, after=2, include=["error"]).select("event_id", "context_type")


@query("""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS at, event_type AS kind FROM events WHERE event_type <> 'view'""")
def rewrite_and_skip(spark, sf_dir):
    """normalize_ts of access-log times; skip; a removed field; rows with nothing left go."""
    e = events(spark, sf_dir).select("event_id", F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'").alias("at"), F.col("event_type").alias("kind"), F.lit("gone").alias("extra"))
    out = EV.normalize_ts(EV.skip_if(e, F.col("kind") == "view"), "at", D.parse_ts("at"))
    return EV.remove(out, "extra").select("event_id", "at", "kind")


@query("SELECT user_id AS uid, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1")
def removal_drops_empty(spark, sf_dir):
    """An event whose fields are all null after a removal is gone."""
    e = events(spark, sf_dir).select(F.expr("if(user_id % 2 = 0, user_id, null)").alias("uid"), F.col("event_type").alias("kind"))
    return EV.remove(e, "kind").groupBy("uid").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = event_id)")
def semi_and_anti_join(spark, sf_dir):
    """Events of known customers, without those that another table names."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("event_id"))
    return EV.without(EV.only_in(events(spark, sf_dir), c, ["user_id"]), s, ["event_id"]).select("event_id", "event_type")


@query("""WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders),
j AS (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY e.event_id ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS n FROM events e LEFT JOIN o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts)
SELECT event_id, o_orderkey AS last_order FROM j WHERE n = 1""")
def as_of_join(spark, sf_dir):
    """Each event with its user's last order until then."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), "o_orderkey")
    return EV.as_of(events(spark, sf_dir), o, "ts", "at", ["user_id"], {"last_order": "o_orderkey"}, order="event_id", tie="o_orderkey").select("event_id", "last_order")


@query("""SELECT event_id, round(value, 6) AS current, round(lag(value, 2) OVER w, 6) AS before, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean
FROM events WINDOW w AS (ORDER BY event_id)""")
def window_of_stream(spark, sf_dir):
    """The last rows of the whole stream."""
    w = EV.window_values(events(spark, sf_dir), "event_id", 3, ["value"])
    return w.select("event_id", MX.round_(F.get("window", F.lit(0))["value"], 6).alias("current"), MX.round_(F.get("window", F.lit(2))["value"], 6).alias("before"), MX.round_(A.mean(A.pluck_as_nums("window", "value")), 6).alias("mean"))


@query("""WITH g AS (SELECT event_id, abs(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY event_id))) AS d FROM events)
SELECT event_id, d AS gap_us FROM g WHERE d >= 3600000000""")
def gaps_of_stream(spark, sf_dir):
    """Gaps between neighbours of the whole stream."""
    return EV.mark_gaps(events(spark, sf_dir), "ts", "event_id", 3600).where("gap_us is not null").select("event_id", "gap_us")


# metrics, outputs ----------------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT user_id) AS exact, 0 AS off_by_more_than_percent FROM events")
def cardinality_against_exact(spark, sf_dir):
    """The estimate, and its mergeable form over two halves, off by how many whole steps of 3 percent."""
    e = events(spark, sf_dir)
    halves = e.groupBy((F.col("event_id") % 2).alias("h")).agg(ME.cardinality_sketch("user_id").alias("s"))
    merged = halves.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("m"))
    row = ME.with_distinct(e, "user_id", ME.cardinality("user_id").alias("est")).crossJoin(F.broadcast(merged))  # one row
    steps = F.floor(F.greatest(F.abs(F.col("est") - F.col("exact")), F.abs(F.col("m") - F.col("exact"))) / F.col("exact") / 0.03).cast("int")
    return row.select("exact", steps.alias("off_by_more_than_percent"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def percentile_sketches(spark, sf_dir):
    """The sketches' percentiles lie between the exact ones a hundredth to either side."""
    e = events(spark, sf_dir)
    g = e.groupBy("event_type").agg(*ME.percentiles("value", (0.5, 0.95)), F.percentile("value", F.array(*[F.lit(p) for p in (0.49, 0.51, 0.94, 0.96)])).alias("q"))
    return g.select("event_type", (F.col("p50").between(F.col("q")[0], F.col("q")[1]) & F.col("p95").between(F.col("q")[2], F.col("q")[3])).alias("near"))


@query("""WITH n AS (SELECT event_id, upper(left(event_type, 1)) AS c, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS line FROM events)
SELECT line, string_agg(CASE WHEN event_id % 10 = 0 THEN '?' ELSE c END, '' ORDER BY event_id) AS text, substr(arg_min(moment, event_id), 1, 16) AS start FROM n GROUP BY 1""")
def output_levelmap(spark, sf_dir):
    """The first letter of each event's level, lines with their first time."""
    e = events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.expr("if(event_id % 10 = 0, null, upper(event_type))").alias("level"))
    return O.levelmap(e, "event_id", 50, "ts").select("line", "text", F.left("start", F.lit(16)).alias("start"))


@query("""SELECT event_id, 'ts=' || chr(39) || 'now' || chr(39) || ' msg=' || chr(39) || event_type || chr(92) || chr(39) || 's' || chr(39) || ' n=' || user_id AS plain, 'now ' || event_type || chr(39) || 's ' || user_id AS brief, 'ts | string | now' || chr(10) || 'msg | string | ' || event_type || chr(39) || 's' || chr(10) || 'n | bigint | ' || user_id AS inspected FROM events""")
def output_default_and_inspect(spark, sf_dir):
    """key='value' pairs, values alone, and one line a field with its type."""
    e = events(spark, sf_dir).select("event_id", F.col("user_id").alias("n"), F.concat("event_type", F.lit("'s")).alias("msg"), F.lit("now").alias("ts"), F.lit(None).cast("string").alias("none"))
    own = e.select("n", "msg", "ts", "none")
    short = e.select("n", "msg", "ts")
    return e.select("event_id", O.as_default(own).alias("plain"), O.as_default(own, brief=True).alias("brief"), O.as_inspect(short).alias("inspected"))


@query("""SELECT event_id, chr(34) || event_type || chr(9) || user_id || chr(34) || chr(9) || 'a:1,b:' || event_type || chr(9) || '' || chr(9) || chr(34) || chr(34) AS tsv, chr(34) || 'a:1,b:' || event_type || chr(34) || ',' || chr(34) || '0:x,1:' || user_id || chr(34) || ',' || chr(34) || ' y' || chr(34) AS csv FROM events""")
def output_tsv_and_nested(spark, sf_dir):
    """Quoting in TSV, null and empty cells; a nested cell is key:value pairs."""
    e = events(spark, sf_dir).select("event_id", F.concat("event_type", F.lit("\t"), F.col("user_id").cast("string")).alias("t"), F.struct(F.lit(1).alias("a"), F.col("event_type").alias("b")).alias("s"), F.array(F.lit("x"), F.col("user_id").cast("string")).alias("l"), F.lit(None).cast("string").alias("n"), F.lit("").alias("z"), F.lit(" y").alias("y"))
    return e.select("event_id", O.as_csv(e, ["t", "s", "n", "z"], "\t").alias("tsv"), O.as_csv(e, ["s", "l", "y"]).alias("csv"))


# steps with a memory, functions of users, reports ----------------------------------------------------------------------


def _count_step(state, event):
    """state["count"] = (state["count"] ?? 0) + 1; before and after with a default."""
    before = state.get("count", 100)
    state["count"] = (state["count"] or 0) + 1
    return {"event_id": event["event_id"], "before": before, "after": state.get("count", 100)}


@query("""WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT event_id, CASE WHEN k = 1 THEN 100 ELSE k - 1 END AS before, k AS after FROM n""")
def state_counter(spark, sf_dir):
    """A counter a user, read with a default before and after it is set."""
    return ST.stateful(events(spark, sf_dir).select("event_id", "user_id"), "event_id", _count_step, "event_id long, before long, after long", by=["user_id"])


def _machine_step(state, event):
    """Pairs each purchase with the click before it; the map forgets once they are paired."""
    if event["event_type"] == "click":
        state.set("click", event["event_id"])
        state.mixin({"kind": "click"})
        return None
    if event["event_type"] == "purchase" and state.contains("click"):
        out = {"user_id": event["user_id"], "click_id": state["click"], "purchase_id": event["event_id"], "left": len(state + {"x": 1})}
        state.clear()
        return out
    state.fill_with({"other": 1})
    return None


@query("""WITH c AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS click_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS last_purchase,
count(*) FILTER (event_type NOT IN ('click')) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, click_id, event_id AS purchase_id FROM c WHERE event_type = 'purchase' AND click_id IS NOT NULL AND (last_purchase IS NULL OR click_id > last_purchase)""")
def state_machine(spark, sf_dir):
    """A purchase after a click of its user, each click used once."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return ST.stateful(e, "event_id", _machine_step, "user_id long, click_id long, purchase_id long, left long", by=["user_id"]).drop("left")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_of_key(spark, sf_dir):
    """Dedupe: the first event of each user and kind."""
    return ST.first_of(events(spark, sf_dir).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, event_type || ':' || user_id AS label, length(event_type) * 2 AS n FROM events")
def user_scalars(spark, sf_dir):
    """A function of a user over two columns, and one under a name in a text expression."""
    label = U.scalar(lambda a, b: f"{a}:{b}", "string")
    U.registered(spark, "twice_length", lambda s: None if s is None else 2 * len(s), "long")
    return events(spark, sf_dir).select("event_id", label("event_type", "user_id").alias("label"), F.expr("twice_length(event_type)").alias("n"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def user_aggregate(spark, sf_dir):
    """An aggregate of a user: the spread of values, from partial states."""
    how = U.Aggregate(lambda: None, lambda s, v: (min(s[0], v), max(s[1], v)) if s else (v, v), lambda a, b: a if b is None else b if a is None else (min(a[0], b[0]), max(a[1], b[1])), lambda s: None if s is None else s[1] - s[0], "double")
    return U.aggregate(events(spark, sf_dir).select("event_type", "value"), ["event_type"], "value", how, "spread").select("event_type", MX.round_("spread", 6).alias("spread"))


@query("SELECT 'events=' || count(*) || ' kinds=' || count(DISTINCT event_type) || ' click=' || count(*) FILTER (event_type = 'click') AS line FROM events")
def end_of_run(spark, sf_dir):
    """What runs once with the finalised metrics."""
    m = ME.Metrics(events(spark, sf_dir)).track("n", "inc").track("kinds", "freq", "event_type")
    line = m.finish(lambda found: f"events={found['n']} kinds={len(found['kinds'])} click={found['kinds'].get('click', 0)}")
    return spark.createDataFrame([(line,)], "line string")


@query("""WITH k AS (SELECT event_type, count(*) AS c FROM events GROUP BY 1), t AS (SELECT string_agg('kinds' || chr(9) || event_type || chr(9) || c || chr(10), '' ORDER BY c DESC, event_type) AS body FROM k)
SELECT body || 'n' || chr(9) || chr(9) || (SELECT count(*) FROM events) || chr(10) AS tsv, (SELECT 'kinds (' || count(*) || ' entries):' FROM k) AS head FROM t""")
def metrics_report(spark, sf_dir):
    """The report as tab-separated text, and the first line of the short form."""
    m = ME.Metrics(events(spark, sf_dir)).track("n", "inc").track("kinds", "freq", "event_type")
    return spark.createDataFrame([(m.text("tsv"), m.text("short").split("\n")[0])], "tsv string, head string")


@query("""WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT 'a' AS path, count(*) AS events, 'object' AS kind, CAST(count(*) AS BIGINT) AS of_kind, 2 AS max_size FROM events UNION ALL SELECT 'a.b', count(*), 'string', count(*), NULL FROM events
UNION ALL SELECT 'a.l', count(*) FILTER (event_id % 2 = 0), 'array', count(*) FILTER (event_id % 2 = 0), 2 FROM events UNION ALL SELECT 'a.l[]', count(*) FILTER (event_id % 2 = 0), 'int', 2 * count(*) FILTER (event_id % 2 = 0), NULL FROM events UNION ALL SELECT 't', count(*), 'bool', count(*), NULL FROM events)
SELECT path, events, round(100 * (1 - events / n), 4) AS missing_pct, kind, of_kind, max_size FROM e, n""")
def discover_nested(spark, sf_dir):
    """Nested fields and items of arrays, counts by kind, sizes."""
    text = F.expr("""'{"a":{"b":"' || event_type || '"' || if(event_id % 2 = 0, ',"l":[1,' || user_id || ']', '') || '},"t":' || if(user_id % 2 = 0, 'true', 'false') || '}'""")
    found = ME.discover(events(spark, sf_dir).select(text.alias("j")), "j")
    return found.select("path", "events", "missing_pct", F.get("types", F.lit(0)).alias("kind"), F.element_at("kinds", F.get("types", F.lit(0))).alias("of_kind"), "max_size")


@query("SELECT count(*) AS lines, count(*) FILTER (event_id % 5 = 0) AS parse_errors, count(*) FILTER (event_id % 5 <> 0 AND event_type <> 'click') AS filtered, count(*) FILTER (event_id % 5 <> 0 AND event_type = 'click') AS events FROM events")
def run_counters(spark, sf_dir):
    """Lines read, lines that are no JSON, events filtered out, events left."""
    read = events(spark, sf_dir).select("event_type", P.json(F.expr("if(event_id % 5 = 0, 'bad', props)"), "k long").alias("r"))
    left = read.where("r is not null and event_type = 'click'")
    return ME.run_stats(left, read=read, parsed="r").select("lines", "parse_errors", "filtered", "events")


@query("""SELECT CASE WHEN event_type = 'click' THEN 'filtered' ELSE 'included' END AS span_status, count(*) AS n, count(*) FILTER (event_type <> 'click') AS in_span FROM events WHERE event_id < 500 GROUP BY 1""")
def span_filtered(spark, sf_dir):
    """Events that a filter drops after spans were given are marked, and in no span."""
    e = events(spark, sf_dir).where("event_id < 500").withColumn("ts", F.expr("timestamp_seconds(event_id * 10)"))
    s = SP.span_status(SP.time_spans(e, "ts", "event_id", "1 hour"), F.col("event_type") != "click")
    return s.groupBy("span_status").agg(F.count("*").alias("n"), F.count("span_id").alias("in_span"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'session opened for <*> from <ipv4>' ELSE 'session opened for <*> from <ipv4>' END AS template FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 'disk <path> at <num> percent' FROM events WHERE event_type = 'purchase')
SELECT template, 'v1:' || substr(sha256(template), 1, 16) AS template_id, count(*) AS count, min(event_id) AS first_line, max(event_id) AS last_line FROM t GROUP BY 1""")
def drain_merges(spark, sf_dir):
    """Lines that differ in a word are merged at the default similarity; others are apart; lines and samples are kept."""
    e = events(spark, sf_dir).where("event_type in ('click', 'view', 'purchase')")
    text = F.expr("""case event_type when 'purchase' then 'disk /var/data/d' || event_id || '/x at ' || user_id || ' percent'
        else 'session opened for ' || if(user_id % 2 = 0, 'alice', 'bob') || ' from 10.0.0.' || (user_id % 250) end""")
    return DR.templates(e.select("event_id", text.alias("line")), "line", "event_id").drop("sample")
