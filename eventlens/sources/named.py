"""Named line formats, each a layout of fields.

A layout is a line with fields in braces, {name} or {name:kind}; a blank stands for any white space, ~ for white space or
none, and what stands between (( and )) may be left out. Field names, level words and the order of formats are fixed
values, as users' queries name them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"\d{2}:\d{2}:\d{2}"
_DAY = r"\d{4}-\d{2}-\d{2}"
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})"


def _one_of(words: str) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words.split()) + ")"


#: What a field of a kind may hold.
KINDS = {
    "word": r"\S+", "name": r"\w+", "rest": r"[\s\S]*", "inside": r"[^\]]+", "quoted": r"[^\"]*", "int": r"\d+", "count": r"(?:\d+|-)", "signed": r"-?\d+",
    # timestamps
    "day_and_clock": rf"\d{{4}} {_CLOCK}\.\d{{1,6}}",
    "zoned_time": rf"{_DAY}T{_CLOCK}(?:\.\d{{1,9}})?{_OFFSET}",
    "slash_time": rf"\d{{4}}/\d{{2}}/\d{{2}} {_CLOCK}",
    "comma_time": rf"{_DAY} {_CLOCK},\d{{3}}",
    "dot_time": rf"{_DAY} {_CLOCK}(?:\.\d{{1,6}})?",
    "month_time": rf"\d{{1,2}} [A-Za-z]{{3}} \d{{4}} {_CLOCK}\.\d{{3}}",
    "syslog_time": rf"[A-Za-z]{{3}}\s+\d{{1,2}} {_CLOCK}",
    "any_iso_time": rf"{_DAY}[T ]{_CLOCK}(?:[.,]\d{{1,9}})?{_OFFSET}?",
    # levels and marks
    "glog_level": "[IWEF]",
    "cri_stream": _one_of("stdout stderr"),
    "cri_tag": "[FP]",
    "log4j_level": _one_of("TRACE DEBUG INFO WARN ERROR FATAL"),
    "python_level": _one_of("DEBUG INFO WARNING ERROR CRITICAL"),
    "postgres_level": "(?:" + _one_of("LOG ERROR FATAL PANIC WARNING NOTICE INFO STATEMENT DETAIL HINT CONTEXT") + "|DEBUG[1-5]?)",
    "redis_role": "[XCSM]",
    "redis_level": r"[.*#\-]",
    "app_level": _one_of("TRACE DEBUG INFO NOTICE WARNING WARN ERROR ERR FATAL CRITICAL CRIT"),
    # parts
    "place": r"[^\s:]+:\d+", "module": r"[^\]:]+", "zone": "[A-Z]{2,5}", "host_or_star": r"[-\w.:*]+", "before_query": r"[^\s?]+", "query": r"[^\s]*", "address": "[^:]+", "front": r"[^\s~]+",
    "backend": r"[^\s/]+", "http_status": r"(?:\d{3}|-1)", "four": ".{4}", "two": ".{2}", "braced": r"[^}]*",
}
_S3 = (
    '{owner} {bucket} [{ts:inside}] {client:host_or_star} {requester} {req_id} {op} {key} "{method} {uri:before_query}((?{query:query})) {httpver}" {status:count} {error_code} '
    '{bytes_sent:count} {obj_size:count} {total_time:count} {turnaround_time:count} "{referer:quoted}" "{user_agent:quoted}"'
)
_PROXY = "{ts:syslog_time} {host} {proc:name}[{pid:int}]: {client_ip:address}:{client_port:int} [{accept_date:inside}] {frontend:front}((~)) {backend:backend}/{server} "
_COUNTS = "{actconn:int}/{feconn:int}/{beconn:int}/{srv_conn:int}/{retries:int} {srv_queue:int}/{backend_queue:int}"
LAYOUTS = {
    "glog": ["{level:glog_level}{ts:day_and_clock} {pid:int} {source:place}] {msg:rest}"],
    "cri": ["{ts:zoned_time} {stream:cri_stream} {tag:cri_tag} {msg:rest}"],
    "nginx-error": ["{ts:slash_time} [{level:name}] {pid:int}#{tid:int}:~{msg:rest}"],
    "apache-error": ["[{ts:inside}] [(({module:module}:)){level:name}](( [pid {pid:int}((:tid {tid:int}))]))(( [client {client:inside}])) {msg:rest}"],
    "log4j": ["{ts:comma_time} {level:log4j_level} [{thread:inside}] {logger} - {msg:rest}"],
    "python-logging": ["{ts:comma_time} - {logger} - {level:python_level} - {msg:rest}"],
    "postgres": ["{ts:dot_time} {log_tz:zone} [{pid:int}] {level:postgres_level}: {msg:rest}"],
    "redis": ["{pid:int}:{role:redis_role} {ts:month_time} {level:redis_level} {msg:rest}"],
    # the longer of two comes first
    "s3": [_S3 + " {version_id} {host_id} {sig_version} {cipher_suite} {auth_type} {host_header} {tls_version}", _S3],
    "haproxy": [
        _PROXY + "{tq:signed}/{tw:signed}/{tc:signed}/{tr:signed}/{tt:int_text} {status:http_status} {bytes_read:int} {:word} {:word} {termination_state:four} " + _COUNTS
        + '(( {{req_headers:braced}} {{resp_headers:braced}})) "{msg:quoted}"',
        _PROXY + "{tw:signed}/{tc:signed}/{tt:int_text} {bytes_read:int} {termination_state:two} " + _COUNTS,
    ],
    "iso8601-level": ["(([)){ts:any_iso_time}((])) {level:app_level} {msg:rest}"],
}
#: How timestamps of a format read, where the general forms don't cover them.
TS_FORMATS = {"glog": "%m%d %H:%M:%S%.f", "apache-error": "%a %b %d %H:%M:%S%.f %Y", "redis": "%d %b %Y %H:%M:%S%.f"}
KINDS["int_text"] = r"\d+"
_TOKEN = re.compile(r"\{(\w*)(?::(\w+))?\}|\(\(|\)\)|\s+|~|[\s\S]")


def compile_layout(layout: str) -> tuple[str, list[tuple[str, bool]]]:
    """(pattern, [(field, is a whole number)]) of a layout; groups come in the fields' order."""
    out, fields, depth = [], [], 0
    for m in _TOKEN.finditer(layout):
        token = m[0]
        if m[1] is not None:
            kind = m[2] or "word"
            if m[1]:
                fields.append((m[1], kind == "int"))
                out.append(f"({KINDS[kind]})")
            else:
                out.append(f"(?:{KINDS[kind]})")
        elif token in ("((", "))"):
            depth += 1 if token == "((" else -1
            out.append("(?:" if token == "((" else ")?")
        elif token.isspace():
            out.append(r"\s+")
        elif token == "~":
            # in parentheses of its own it is the sign itself
            out.append("~" if depth else r"\s*")
        else:
            out.append("\\" + token if token in r"\.[]{}()*+-?^$|#&" else token)
    return "".join(out), fields


def parse(v, name: str) -> Column:
    """A struct of the fields of all layouts of the format, null where a line lacks one; null for a line that is none.

    Each layout's pattern runs once a line. Empty fields are null.
    """
    from .formats import _c, _groups

    compiled = [compile_layout(x) for x in LAYOUTS[name]]
    whole = {f: is_int for _, fields in compiled for f, is_int in fields}

    def row(fields):
        at = {f: i + 1 for i, (f, _) in enumerate(fields)}

        def one(group):
            def field(f):
                x = F.nullif(group(at[f]), F.lit("")) if f in at else F.lit(None).cast("string")
                return (x.try_cast("long") if whole[f] else x).alias(f)

            return F.struct(*[field(f) for f in whole])

        return one

    parsed = [_groups(_c(v), rf"^(?:{pattern})\z", len(fields), row(fields)) for pattern, fields in compiled]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def match(text: str) -> str | None:
    """The first format, in the order of LAYOUTS, that reads the text."""
    for name, layouts in LAYOUTS.items():
        if any(re.fullmatch(compile_layout(x)[0], text) for x in layouts):
            return name
    return None
