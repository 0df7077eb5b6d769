"""Extraction from text, and parsers of structured text that return structs or maps."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c, quote

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
URL = r"https?://[^\s<>\"']*[^\s<>\"'.,;:!?)\]}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def all_of(s, pattern: str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(pattern), F.lit(0))


def nth_of(items: Column, nth: int) -> Column:
    """The nth item from 1, or from the end below 0; '' where there is none."""
    if nth == 0:
        return F.when(items.isNotNull(), "")
    return F.when(items.isNotNull(), F.coalesce(F.try_element_at(items, F.lit(nth)), F.lit("")))


def extract_ips(s) -> Column:
    return all_of(s, IP)


def extract_ip(s, nth: int = 1) -> Column:
    return F.regexp_extract(_c(s), IP, 0) if nth == 1 else nth_of(extract_ips(s), nth)


def extract_urls(s) -> Column:
    return all_of(s, URL)


def extract_url(s, nth: int = 1) -> Column:
    return F.regexp_extract(_c(s), URL, 0) if nth == 1 else nth_of(extract_urls(s), nth)


def extract_emails(s) -> Column:
    return all_of(s, EMAIL)


def extract_email(s, nth: int = 1) -> Column:
    return F.regexp_extract(_c(s), EMAIL, 0) if nth == 1 else nth_of(extract_emails(s), nth)


def extract_domain(s) -> Column:
    """A URL's authority, user and port included; else an email's domain; else ''."""
    url = F.nullif(F.regexp_extract(_c(s), r"https?://([^/\s?#]+)", 1), F.lit(""))
    return F.when(_c(s).isNotNull(), F.coalesce(url, F.regexp_extract(_c(s), r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", 1)))


def json_spans(text: str) -> list[str]:
    """The JSON objects and arrays of a text, outermost ones, in order."""
    out, decoder, i = [], json.JSONDecoder(), 0
    while True:
        found = [x for x in (text.find("{", i), text.find("[", i)) if x >= 0]
        if not found:
            return out
        at = min(found)
        try:
            _, end = decoder.raw_decode(text, at)
            out.append(text[at:end])
            i = end
        except (ValueError, RecursionError):
            i = at + 1


def extract_jsons(s) -> Column:
    """Arrow UDF: matching brackets is not a regular language."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else json_spans(x))

    return F.pandas_udf(run, "array<string>")(_c(s))


def extract_json(s, nth: int = 1) -> Column:
    return nth_of(extract_jsons(s), nth)


# columns of a text ------------------------------------------------------------------------------------------------


def fields(s, sep: str | None = None) -> Column:
    """The parts between separators; any white space where none is named."""
    if sep is None:
        return F.filter(F.split(_c(s), r"\s+", -1), lambda x: x != "")
    return F.split(_c(s), quote(sep), -1)


def col(s, spec: str, sep: str | None = None, joiner: str = " ") -> Column:
    """0-based fields: an index (negative from the end), a list "0,2,-1", or a range "1:3"; those out of range are left out."""
    parts = fields(s, sep)
    n = F.size(parts)
    picked = []
    for one in spec.split(","):
        one = one.strip()
        if ":" in one:
            a, b = (int(x) if x.strip() else None for x in one.split(":"))
            start = F.lit(a or 0) if (a or 0) >= 0 else F.greatest(F.lit(0), n + a)
            stop = n if b is None else (F.least(n, F.lit(b)) if b >= 0 else n + b)
            picked.append(F.slice(parts, start + 1, F.greatest(F.lit(0), stop - start)))
        else:
            i = int(one)
            at = F.lit(i) if i >= 0 else n + i
            picked.append(F.when((at >= 0) & (at < n), F.array(F.get(parts, at))).otherwise(F.array().cast("array<string>")))
    return F.array_join(F.concat(*picked), joiner)


def cols(s, *index: int, sep: str | None = None) -> Column:
    """Fields by index as an array; '' for those out of range."""
    parts = fields(s, sep)
    n = F.size(parts)
    return F.array(*[F.coalesce(F.get(parts, F.lit(i) if i >= 0 else n + i), F.lit("")) for i in index])


def column_spec(spec: str) -> list[tuple[str | None, int, str | None, bool]]:
    """(name, fields taken, type, rest) of each token: name, name(n), -, -(n), *rest, with :type."""
    out = []
    for token in spec.split():
        m = re.fullmatch(r"(\*)?([A-Za-z_]\w*|-)(?:\((\d+)\))?(?::(int|float|bool|string))?", token)
        if not m or (m[1] and token != spec.split()[-1]) or (m[3] and int(m[3]) < 1):
            raise ValueError(f"bad column token: {token}")
        out.append((None if m[2] == "-" else m[2], int(m[3] or 1), m[4], bool(m[1])))
    return out


def parse_cols(s, spec: str, sep: str | None = None) -> Column:
    """A struct by a column spec; a shortage gives null, more fields than named are let be."""
    from .conversion import typed

    tokens = column_spec(spec)
    parts, taken, out = fields(s, sep), 0, []
    joiner = " " if sep is None else sep
    for name, n, kind, rest in tokens:
        if rest:
            lead = rf"^\s*(?:\S+\s+){{{taken}}}" if sep is None else rf"^(?:(?:(?!{quote(sep)})[\s\S])*{quote(sep)}){{{taken}}}"
            value = F.nullif(F.when(F.size(parts) > taken, F.regexp_replace(_c(s), lead, "")), F.lit(""))
        else:
            value = F.when(F.size(parts) >= taken + n, F.array_join(F.slice(parts, taken + 1, n), joiner))
        taken += n
        if name:
            out.append(typed(value, kind).alias(name))
    return F.struct(*out)


# key=value, URLs and the like ---------------------------------------------------------------------------------------


def parse_kv(s, sep: str | None = None, kv_sep: str = "=") -> Column:
    """A map of key and value texts; tokens without kv_sep are left out; the last of equal keys wins."""
    pairs = F.filter(fields(s, sep), lambda t: F.contains(t, F.lit(kv_sep)))
    k = lambda t: F.trim(F.substring_index(t, kv_sep, 1))
    v = lambda t: F.trim(F.substring(t, F.locate(kv_sep, t) + len(kv_sep), F.length(t)))
    entries = F.filter(F.transform(pairs, lambda t: F.struct(k(t).alias("k"), v(t).alias("v"))), lambda e: e["k"] != "")
    return last_wins(entries)


def last_wins(entries: Column) -> Column:
    """A map of (k, v) entries, the last of equal keys; independent of the session's duplicate policy."""
    n = F.size(entries)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.lit(0), n - i - 1)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(kept)


def first_wins(entries: Column) -> Column:
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(kept)


def parse_query_params(s) -> Column:
    """A map of decoded parameters; the first of equal keys wins; a leading ? is let be."""
    text = F.regexp_replace(_c(s), r"^\?", "")
    parts = F.filter(F.split(text, "&", -1), lambda p: p != "")
    dec = lambda x: F.coalesce(F.try_url_decode(x), x)
    entries = F.transform(parts, lambda p: F.struct(dec(F.substring_index(p, "=", 1)).alias("k"), dec(F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("v")))
    return first_wins(entries)


_URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/?#]*)(?::([^@/?#]*))?@)?(\[[^\]]*\]|[^:/?#]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parse_url(s) -> Column:
    """scheme, user, pass, host, port, path, query, query_map, fragment; default ports vanish; a text that is no URL is a path."""
    text = _c(s)
    is_url = text.rlike(_URL_RE)
    g = lambda i: F.nullif(F.regexp_extract(text, _URL_RE, i), F.lit(""))
    scheme = F.lower(g(1))
    port = F.when(~((scheme == "http") & (g(5) == "80") | (scheme == "https") & (g(5) == "443") | (scheme == "ftp") & (g(5) == "21")), g(5))
    rel = r"^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    r = lambda i: F.nullif(F.regexp_extract(text, rel, i), F.lit(""))
    query = F.when(is_url, g(7)).otherwise(r(2))
    path = F.when(is_url, F.coalesce(g(6), F.lit("/"))).otherwise(r(1))
    return F.when(text.isNotNull(), F.struct(scheme.alias("scheme"), g(2).alias("user"), g(3).alias("pass"), F.lower(g(4)).alias("host"), port.alias("port"), path.alias("path"), query.alias("query"), F.when(query.isNotNull(), parse_query_params(query)).alias("query_map"), F.when(is_url, g(8)).otherwise(r(3)).alias("fragment")))


def parse_email(s) -> Column:
    """local, domain; null unless the address is well formed."""
    text = F.trim(_c(s))
    ok = text.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$") & (F.length(text) <= 254) & (F.length(F.substring_index(text, "@", 1)) <= 64)
    return F.when(ok, F.struct(F.substring_index(text, "@", 1).alias("local"), F.lower(F.substring_index(text, "@", -1)).alias("domain")))


def parse_path(s) -> Column:
    text = _c(s)
    absolute = F.startswith(text, F.lit("/"))
    parts = F.filter(F.split(text, "/", -1), lambda p: (p != "") & (p != "."))
    name = F.when(F.size(parts) > 0, F.nullif(F.element_at(parts, -1), F.lit("..")))
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    up = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))
    parent = F.when(F.size(parts) > 0, F.concat(F.when(absolute, "/").otherwise(""), F.array_join(up, "/")))
    return F.when(text.isNotNull(), F.struct(text.alias("input"), absolute.alias("is_absolute"), (~absolute).alias("is_relative"), absolute.alias("has_root"), parent.alias("parent"), name.alias("file_name"), stem.alias("stem"), F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.when(absolute, F.concat(F.array(F.lit("/")), parts)).otherwise(parts).alias("components"), F.lit(None).cast("string").alias("prefix"), F.when(absolute, "/").alias("root")))


def parse_user_agent(s) -> Column:
    """agent_family, agent_version, os_family, os_version, device."""
    text = _c(s)
    agents = [("Edge", r"Edge?(?:A|iOS)?/([0-9.]+)"), ("Opera", r"(?:OPR|Opera)/([0-9.]+)"), ("Samsung Internet", r"SamsungBrowser/([0-9.]+)"), ("Firefox", r"(?:Firefox|FxiOS)/([0-9.]+)"), ("Chrome", r"(?:Chrome|CriOS)/([0-9.]+)"), ("Safari", r"Version/([0-9.]+).*Safari/"), ("Internet Explorer", r"(?:MSIE |rv:)([0-9.]+)"), ("curl", r"^curl/([0-9.]+)"), ("Wget", r"^Wget/([0-9.]+)"), ("Googlebot", r"Googlebot/([0-9.]+)"), ("Bingbot", r"bingbot/([0-9.]+)"), ("Python Requests", r"python-requests/([0-9.]+)")]
    systems = [("Windows", r"Windows NT ([0-9.]+)"), ("iOS", r"(?:iPhone|CPU) OS ([0-9_]+)"), ("macOS", r"Mac OS X ([0-9_.]+)"), ("Android", r"Android ([0-9.]+)"), ("ChromeOS", r"CrOS \S+ ([0-9.]+)"), ("Linux", r"Linux()")]

    def pick(table):
        name = version = None
        for label, pattern in table:
            hit, v = text.rlike(pattern), F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
            name = F.when(hit, label) if name is None else name.when(hit, label)
            version = F.when(hit, v) if version is None else version.when(hit, v)
        return name, version

    (agent, av), (system, sv) = pick(agents), pick(systems)
    device = F.when(text.rlike("(?i)bot|crawler|spider"), "bot").when(text.rlike("iPad|Tablet") | (text.contains("Android") & ~text.contains("Mobile")), "tablet").when(text.rlike("Mobile|iPhone"), "mobile").otherwise("desktop")
    return F.when(text.isNotNull(), F.struct(agent.alias("agent_family"), av.alias("agent_version"), system.alias("os_family"), F.translate(sv, "_", ".").alias("os_version"), device.alias("device")))


def _params(rest: Column) -> Column:
    parts = F.regexp_extract_all(rest, F.lit(r';\s*([A-Za-z0-9!#$&^_.+*-]+\s*=\s*(?:"(?:[^"\\]|\\.)*"|[^;\s]*))'), F.lit(1))
    k = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    v = lambda p: F.regexp_replace(F.regexp_replace(F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p))), r'^"([\s\S]*)"$', "$1"), r"\\(.)", "$1")
    return first_wins(F.transform(parts, lambda p: F.struct(k(p).alias("k"), v(p).alias("v"))))


def parse_media_type(s) -> Column:
    text = F.trim(_c(s))
    head = r"^([A-Za-z0-9!#$&^_.-]+)/([A-Za-z0-9!#$&^_.+-]+)\s*(;[\s\S]*)?$"
    kind, sub = F.lower(F.regexp_extract(text, head, 1)), F.lower(F.regexp_extract(text, head, 2))
    some = lambda x: F.nullif(x, F.lit(""))
    return F.when(text.rlike(head), F.struct(kind.alias("type"), sub.alias("subtype"), some(F.regexp_extract(sub, r"^([a-z]+)\.", 1)).alias("tree"), some(F.regexp_extract(sub, r"\+([^+]+)$", 1)).alias("suffix"), _params(F.regexp_extract(text, head, 3)).alias("params")))


def parse_content_disposition(s) -> Column:
    text = F.trim(_c(s))
    head = r"^([A-Za-z0-9!#$&^_.+-]+)\s*(;[\s\S]*)?$"
    params = _params(F.regexp_extract(text, head, 2))
    star = F.regexp_extract(F.try_element_at(params, F.lit("filename*")), r"(?i)^(?:utf-8|iso-8859-1)'[^']*'(.*)$", 1)
    name = F.coalesce(F.try_url_decode(F.replace(F.nullif(star, F.lit("")), F.lit("+"), F.lit("%2B"))), F.try_element_at(params, F.lit("filename")))
    return F.when(text.rlike(head), F.struct(F.lower(F.regexp_extract(text, head, 1)).alias("disposition"), params.alias("params"), name.alias("filename")))


def parse_jwt(s) -> Column:
    """header and claims as JSON text, signature_b64u, alg, kid, typ, expires_at, issued_at, not_before; nothing is verified."""
    parts = F.split(_c(s), r"\.", -1)

    def text(i):
        raw = F.translate(F.get(parts, i), "-_", "+/")
        padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4))))
        return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))

    head, claims = text(0), text(1)
    ok = (F.size(parts) == 3) & F.get_json_object(head, "$").isNotNull() & F.get_json_object(claims, "$").isNotNull()
    at = lambda k: F.timestamp_seconds(F.get_json_object(claims, f"$.{k}").try_cast("long"))
    of = lambda k: F.get_json_object(head, f"$.{k}")
    return F.when(ok, F.struct(head.alias("header"), claims.alias("claims"), F.get(parts, 2).alias("signature_b64u"), of("alg").alias("alg"), of("kid").alias("kid"), of("typ").alias("typ"), at("exp").alias("expires_at"), at("iat").alias("issued_at"), at("nbf").alias("not_before")))


# absorbing: a field's pairs become columns -----------------------------------------------------------------------------


def absorb(df, field: str, parsed: Column, keys: list[str], keep_source: bool = False, overwrite: bool = True, rest: Column | None = None):
    """df with parsed[key] for each of keys as a column, a column absorb_status, and field as the rest (or dropped).

    Status: applied, missing_field (null), empty (blank), parse_error (parsed is null or has no pair).
    """
    src = F.col(field)
    status = F.when(src.isNull(), "missing_field").when(F.trim(src) == "", "empty").when(parsed.isNull() | (F.size(parsed) == 0), "parse_error").otherwise("applied")
    out = df.withColumn("__map", parsed).withColumn("absorb_status", status)
    new = {}
    for k in keys:
        v = F.try_element_at(F.col("__map"), F.lit(k))
        new[k] = F.coalesce(v, F.col(k).cast("string")) if overwrite and k in df.columns else (F.coalesce(F.col(k).cast("string"), v) if k in df.columns else v)
    out = out.withColumns(new)
    if not keep_source and field not in keys:
        out = out.withColumn(field, F.when(F.col("absorb_status") == "applied", F.lit(None) if rest is None else F.nullif(rest, F.lit(""))).otherwise(F.col(field)))
    return out.drop("__map")


def absorb_kv(df, field: str, keys: list[str], sep: str | None = None, kv_sep: str = "=", **options):
    """The pairs become columns; what is no pair stays in field."""
    rest = F.array_join(F.filter(fields(field, sep), lambda t: ~F.contains(t, F.lit(kv_sep))), " " if sep is None else sep)
    return absorb(df, field, parse_kv(field, sep, kv_sep), keys, rest=rest, **options)


def absorb_json(df, field: str, keys: list[str], **options):
    """All or nothing: only a JSON object is merged."""
    is_object = F.ltrim(F.col(field)).startswith("{") & F.get_json_object(F.col(field), "$").isNotNull()
    parsed = F.when(is_object, F.from_json(F.col(field), "map<string,string>"))
    return absorb(df, field, parsed, keys, **options)


def absorb_logfmt(df, field: str, keys: list[str], **options):
    from ..sources.formats import logfmt_map

    return absorb(df, field, logfmt_map(F.col(field)), keys, **options)


def absorb_jwt(df, field: str, keys: list[str], **options):
    return absorb(df, field, F.from_json(parse_jwt(field)["claims"], "map<string,string>"), keys, **options)


def absorb_regex(df, field: str, pattern: str, keep_source: bool = False, overwrite: bool = True):
    """Named groups become columns; without a match the source is removed too, unless it is kept."""
    from .strings import java_regex

    java, names = java_regex(pattern)
    hit = F.col(field).rlike(java)
    own = [(n, i + 1) for i, n in enumerate(names) if n]
    parsed = F.when(hit, F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.nullif(F.regexp_extract(F.col(field), java, i), F.lit("")).alias("v")) for n, i in own]), lambda e: e["v"].isNotNull())))
    out = absorb(df, field, parsed, [n for n, _ in own], keep_source=True, overwrite=overwrite)
    return out if keep_source or field in [n for n, _ in own] else out.withColumn(field, F.lit(None).cast("string"))
