"""Numbers, conversions, samples."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c, once


def clamp(v, low, high) -> Column:
    if low > high:
        raise ValueError("clamp: low is above high")
    return F.when(_c(v).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _c(v))))


def mod(a, b) -> Column:
    """The remainder with the sign of a; 0 for a division by 0."""
    a, b = _c(a), b if isinstance(b, Column) else F.lit(b)
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_mod(a, b), a * 0))


def round_(v, digits: int = 0) -> Column:
    """Half away from zero by the arithmetic of doubles, as SQL engines round: a negative number that rounds to zero is -0.0, of which Spark's round makes 0.0."""
    unit = 10.0**digits
    one = lambda x: F.when(F.abs(x * unit) < float("inf"), F.signum(x) * F.abs(F.round(x * unit)) / unit).otherwise(x)
    return once(_c(v).cast("double"), one)


def _digits(v, thousands: str | None, decimal: str | None = None) -> Column:
    s = _c(v).cast("string")
    if thousands:
        s = F.replace(s, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        s = F.replace(s, F.lit(decimal), F.lit("."))
    return s


def to_int(v, thousands: str | None = None) -> Column:
    """A long from an exact integer text; null for all else, floats included."""
    s = _digits(v, thousands)
    return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("long"))


def to_float(v, thousands: str | None = None, decimal: str | None = None) -> Column:
    s = _digits(v, thousands, decimal)
    return F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), s.try_cast("double"))


def to_bool(v) -> Column:
    s = F.lower(F.trim(_c(v).cast("string")))
    number = s.try_cast("double")
    return F.when(s.isin("true", "yes", "1", "on"), True).when(s.isin("false", "no", "0", "off"), False).when(number.isNotNull() & s.rlike(r"^[+-]?[0-9.]+\z"), number != 0)


def to_int_or(v, default: int, thousands: str | None = None) -> Column:
    return F.coalesce(to_int(v, thousands), F.lit(default).cast("long"))


def to_float_or(v, default: float, thousands: str | None = None, decimal: str | None = None) -> Column:
    return F.coalesce(to_float(v, thousands, decimal), F.lit(default).cast("double"))


def to_bool_or(v, default: bool) -> Column:
    return F.coalesce(to_bool(v), F.lit(default))


def rand(seed: int | None = None) -> Column:
    return F.rand(seed)


def rand_int(low: int, high: int, seed: int | None = None) -> Column:
    """Both ends included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def sample_prob(p: float, seed: int | None = None) -> Column:
    return F.rand(seed) < p


def sample_key(key, p: float) -> Column:
    """A sample that takes a key's rows all or none, the same in every run."""
    return F.pmod(F.xxhash64(_c(key)), F.lit(1_000_000)) < int(p * 1_000_000)


def get_env(name: str, default: str | None = None) -> Column:
    return F.lit(os.environ.get(name, default))


def read_file(path: str) -> str:
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def read_lines(path: str) -> list[str]:
    return read_file(path).splitlines()


def type_of(v) -> Column:
    return F.typeof(_c(v))


def status_class(n) -> Column:
    n = _c(n).cast("int")
    return F.when(n.between(100, 599), F.concat((n / 100).cast("int").cast("string"), F.lit("xx"))).otherwise("unknown")


abs_, floor, ceiling, sqrt, sin, log = F.abs, F.floor, F.ceil, F.sqrt, F.sin, F.ln
