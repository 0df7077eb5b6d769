"""Datetimes and durations on columns. Durations are long nanoseconds; datetimes keep microseconds, as Spark does."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c

NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}
_LONG = {
    "ns": "nanoseconds?|nanos?|nsecs?|ns", "us": "microseconds?|micros?|usecs?|us|µs", "ms": "milliseconds?|millis?|msecs?|ms", "s": "seconds?|secs?|s",
    "m": "minutes?|mins?|m", "h": "hours?|hrs?|h", "d": "days?|d", "w": "weeks?|w",
}
#: strftime directive -> Java pattern.
STRFTIME = {
    "Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE",
    "A": "EEEE", "y": "yy", "j": "DDD", "z": "Z", "Z": "VV", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy", "3f": "SSS", "6f": "SSSSSS", ".f": ".SSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS", ":z": "xxx",
}


def micros(ts) -> Column:
    """Microseconds since the epoch, of timestamps with and without a zone."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def java_format(fmt: str) -> str:
    """A strftime pattern in Java's letters, its literal text quoted."""
    out, lit, i = [], "", 0

    def flush():
        nonlocal lit
        if lit:
            out.append("'" + lit.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in lit) else lit)
            lit = ""

    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] == "%":
                lit, i = lit + "%", i + 2
                continue
            for n in (3, 2, 1):
                if (d := fmt[i + 1 : i + 1 + n]) in STRFTIME and len(d) == n:
                    flush()
                    out.append(STRFTIME[d])
                    i += 1 + n
                    break
            else:
                raise ValueError(f"unknown directive in {fmt!r} at {i}")
        else:
            lit, i = lit + fmt[i], i + 1
    flush()
    return "".join(out)


#: Java patterns tried in order where a text is none of the numeric and ISO forms.
PATTERNS = [
    "yyyy-MM-dd HH:mm:ss,SSS", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "EEE, dd MMM yyyy HH:mm:ss Z", "EEE MMM d HH:mm:ss yyyy", "dd MMM yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm:ss", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd HHmmss", "MMM d yyyy HH:mm:ss", "yyyy-MM-dd HH:mm",
]
_SHAPES = {"yyyy": "[0-9]{4}", "SSSSSS": "[0-9]{6}", "SSS": "[0-9]{3}", "MMMM": "[A-Z][a-z]+", "MMM": "[A-Z][a-z]{2}", "EEEE": "[A-Z][a-z]+", "EEE": "[A-Z][a-z]{2}", "DDD": "[0-9]{3}", "xxx": "[+-][0-9]{2}:[0-9]{2}", "VV": r"\\S+", "Z": "[+-][0-9]{4}", "a": "[AP]M"}


def shape(pattern: str) -> str:
    """A regular expression for texts that a Java pattern may read: the parser takes exception to near misses."""
    out = []
    for m in re.finditer(r"'((?:[^']|'')*)'|(([A-Za-z])\3*)|[^A-Za-z']", pattern):
        quoted, run, other = m[1], m[2], m[0]
        if quoted:
            out.append(re.escape(quoted))
        elif run:
            out.append(_SHAPES.get(run) or ("[0-9]{1,2}" if len(run) == 1 else f"[0-9]{{{len(run)}}}"))
        else:
            out.append(re.escape(other) if other != " " else " ")
    return "^" + "".join(out) + r"\z"


def try_parse(text: Column, pattern: str) -> Column:
    """The text read by a Java pattern, else null. A weekday says nothing that the date doesn't, and the parser takes none: it is cut out first."""
    cuts = [m.span() for m in re.finditer(r"'(?:[^']|'')*'|E+", pattern) if m[0][0] == "E"]
    if not cuts:
        return F.when(text.rlike(shape(pattern)), F.try_to_timestamp(text, F.lit(pattern)))
    a, z = cuts[0]
    head, day, tail = pattern[:a], pattern[a:z], pattern[z:]
    bare = lambda x: shape(x)[1:-2]
    without = F.regexp_replace(text, f"^({bare(head)}){bare(day)}({bare(tail)})\\z", "$1$2")
    return F.when(text.rlike(shape(pattern)), try_parse(F.trim(without), (head + tail).strip()) if len(cuts) > 1 else F.try_to_timestamp(F.trim(F.regexp_replace(without, "^, ", "")), F.lit((head + tail).strip().removeprefix(", "))))


def from_epoch(v) -> Column:
    """Seconds, milli-, micro- or nanoseconds by the number of digits; a fraction is of seconds."""
    s = F.trim(_c(v).cast("string"))
    n = F.when(s.rlike(r"^-?[0-9]+\z"), s.try_cast("long"))
    digits = F.length(F.regexp_replace(s, "^-", ""))
    whole = F.when(digits <= 11, F.timestamp_seconds(n)).when(digits <= 14, F.timestamp_millis(n)).when(digits <= 17, F.timestamp_micros(n)).otherwise(F.timestamp_micros(F.floor(n / 1000)))
    part = F.when(s.rlike(r"^-?[0-9]{1,11}\.[0-9]+\z"), F.timestamp_micros(F.round(s.try_cast("decimal(30,9)") * 1_000_000).cast("long")))
    return F.coalesce(whole, part)


def with_year(text: Column, pattern: str, now) -> Column:
    """A text without a year, in the year that puts it nearest to now and not over a day after it."""
    now = F.to_timestamp(F.lit(now)) if isinstance(now, str) else (_c(now))
    at = [F.try_to_timestamp(F.concat((F.year(now) + d).cast("string"), F.lit(" "), text), F.lit("yyyy " + pattern)) for d in (-1, 0, 1)]
    near = F.array(*[F.when(t <= now + F.expr("interval 24 hours"), F.struct(F.abs(micros(t) - micros(now)).alias("gap"), t.alias("t"))) for t in at])
    return F.array_min(F.filter(near, lambda x: x.isNotNull()))["t"]


def parse_ts(v, fmt: str | None = None, tz: str = "UTC", now=None) -> Column:
    """A timestamp from a text or number, null where it can't be read.

    Numbers by their digits, then ISO forms, RFC 2822, access logs and PATTERNS; with now also forms without a year.
    Texts without a zone are in tz.
    """
    text = F.trim(_c(v).cast("string"))
    local = lambda t: t if tz == "UTC" else F.to_utc_timestamp(t, tz)
    if fmt:
        java = java_format(fmt)
        t = try_parse(text, java)
        return t if any(d in fmt for d in ("%z", "%Z", "%:z")) else local(t)
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?: ?(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?)?\z")
    zoned = text.rlike(r"(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})\z") & text.rlike("[T ][0-9]{2}:")
    # long fractions are cut to microseconds; +0100 becomes +01:00
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]{6})[0-9]+", "$1"), r" ?([+-][0-9]{2})([0-9]{2})\z", "$1:$2"), r" ?UTC\z", "Z")
    cast = tidy.try_cast("timestamp")
    tries = [from_epoch(text), F.when(iso, F.when(zoned, cast).otherwise(local(cast)))]
    for p in PATTERNS:
        t = try_parse(text, p)
        tries.append(t if p.endswith((" Z", "'Z'")) else local(t))
    if now is not None:
        short = F.regexp_replace(text, r"\s+", " ")
        tries.append(F.when(text.rlike(r"^[A-Z][a-z]{2} +[0-9]{1,2} [0-9:]{8}\z"), local(with_year(short, "MMM d HH:mm:ss", now))))
    return F.coalesce(*tries)


def to_datetime(v, fmt: str | None = None, tz: str = "UTC") -> Column:
    return parse_ts(v, fmt, tz)


def to_duration(s) -> Column:
    """Nanoseconds of "1h 30m", "2.5 seconds"; null for other text."""
    text = F.lower(F.trim(_c(s)))
    units = "|".join(_LONG.values())
    total = F.lit(0).cast("double")
    for unit, names in _LONG.items():
        parts = F.regexp_extract_all(text, F.lit(rf"([0-9]+(?:\.[0-9]+)?)\s*(?:{names})(?![a-zµ])"), F.lit(1))
        total = total + F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.cast("double")) * NS[unit]
    return F.when(text.rlike(rf"^(?:[0-9]+(?:\.[0-9]+)?\s*(?:{units})(?![a-zµ])\s*)+\z"), F.round(total).cast("long"))


def duration_from(n, unit: str) -> Column:
    return (_c(n) * NS[unit]).cast("long")


def duration_as(d, unit: str) -> Column:
    """Whole units, cut towards 0."""
    return _div(_c(d), NS[unit])


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("long") + F.when((a < 0) & (F.pmod(a, F.lit(b)) != 0), 1).otherwise(0)


def humanize_duration(ms) -> Column:
    """1d 2h 3m 4s 5ms, zero parts left out; 0ms for nothing."""
    n = F.abs(_c(ms).cast("long"))
    parts, left = [], n
    for name, size in (("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        k = F.floor(left / size).cast("long")
        parts.append(F.when(k > 0, F.concat(k.cast("string"), F.lit(name))))
        left = left - k * size
    text = F.concat_ws(" ", *parts)
    return F.when(n.isNull(), None).when(n == 0, "0ms").otherwise(F.concat(F.when(_c(ms) < 0, "-").otherwise(""), text))


def now() -> Column:
    """The run's time: one instant for all rows and partitions."""
    return F.current_timestamp()


def to_iso(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def format_ts(ts, fmt: str) -> Column:
    return F.date_format(_c(ts), java_format(fmt))


def part(ts, name: str, tz: str = "UTC") -> Column:
    """year, month, day, hour, minute or second in a zone."""
    local = _c(ts) if tz == "UTC" else F.from_utc_timestamp(_c(ts), tz)
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[name](local)


def ts_nanos(ts) -> Column:
    return micros(ts) * 1000


def to_timezone(ts, tz: str) -> Column:
    """(wall-clock time in tz, its name): Spark's timestamps carry no zone."""
    return F.struct(F.from_utc_timestamp(_c(ts), tz).alias("local"), F.lit(tz).alias("tz"))


def round_to(ts, ns: int) -> Column:
    """Down to a multiple of the interval since the epoch."""
    us = max(1, ns // 1000)
    n = micros(ts)
    return F.timestamp_micros(n - F.pmod(n, F.lit(us)))


def ceil_to(ts, ns: int) -> Column:
    us = max(1, ns // 1000)
    n = micros(ts)
    return F.timestamp_micros(n + F.pmod(-n, F.lit(us)))


def plus(ts, ns) -> Column:
    return F.timestamp_micros(micros(ts) + _div(ns if isinstance(ns, Column) else F.lit(ns), 1000))


def minus(ts, ns) -> Column:
    return plus(ts, -(ns if isinstance(ns, Column) else F.lit(ns)))


def difference(a, b) -> Column:
    """Nanoseconds between two datetimes, never negative."""
    return F.abs(micros(a) - micros(b)) * 1000


def duration_difference(a, b) -> Column:
    return F.abs(_c(a) - _c(b))


def duration_times(d, n: int) -> Column:
    return _c(d) * n


def duration_over(d, n: int) -> Column:
    if n == 0:
        raise ZeroDivisionError("duration divided by 0")
    return _div(_c(d), n) if n > 0 else -_div(_c(d), -n)
