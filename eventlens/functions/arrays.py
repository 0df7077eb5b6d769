"""Array functions on columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _c, _stepped, indices, once, slice_spec


def _number(x: Column) -> Column:
    return x.try_cast("double")


def _order(a: Column, b: Column) -> Column:
    """Nulls, then numbers (texts that read as numbers too), then other texts."""
    x, y = _number(a), _number(b)
    rank = lambda v, n: F.when(v.isNull(), 0).when(n.isNotNull(), 1).otherwise(2)
    ra, rb = rank(a, x), rank(b, y)
    s, t = a.cast("string"), b.cast("string")
    return F.when(ra != rb, ra - rb).when(ra == 1, F.when(x < y, -1).when(x > y, 1).otherwise(0)).when(ra == 2, F.when(s < t, -1).when(s > t, 1).otherwise(0)).otherwise(0).cast("int")


def sorted_(a) -> Column:
    return F.array_sort(_c(a), _order)


def sorted_by(a, field: str) -> Column:
    """Structs by a field, missing ones first."""
    return F.array_sort(_c(a), lambda x, y: _order(x[field], y[field]))


def reversed_(a) -> Column:
    return F.reverse(_c(a))


def slice_(a, spec: str) -> Column:
    """Python slicing, step included."""
    _, _, step = slice_spec(spec)
    return F.transform(_stepped(indices(F.size(_c(a)), spec), step), lambda i: F.get(_c(a), i))


def unique(a) -> Column:
    return F.array_distinct(_c(a))


def contains_any(a, wanted: list) -> Column:
    return F.arrays_overlap(F.transform(_c(a), lambda x: x.cast("string")), F.array(*[F.lit(str(w)) for w in wanted]))


def starts_with_any(a, wanted: list) -> Column:
    """Whether the first item is one of the wanted."""
    return F.coalesce(F.get(_c(a), 0).cast("string").isin([str(w) for w in wanted]), F.lit(False))


def pluck(a, field: str) -> Column:
    return F.filter(F.transform(_c(a), lambda x: x[field]), lambda v: v.isNotNull())


def as_nums(a) -> Column:
    return F.filter(F.transform(_c(a), lambda x: F.when(x.cast("string").isin("true", "false"), (x.cast("string") == "true").cast("double")).otherwise(_number(x))), lambda v: v.isNotNull())


def pluck_as_nums(a, field: str) -> Column:
    return as_nums(F.transform(_c(a), lambda x: x[field]))


def _extreme(a, pick) -> Column:
    """Of numbers or of texts; null for an empty array or a mix."""
    col = F.filter(_c(a), lambda x: x.isNotNull())
    numbers = F.forall(col, lambda x: _number(x).isNotNull())
    texts = F.forall(col, lambda x: _number(x).isNull())
    by_number = pick(F.transform(col, lambda x: F.struct(_number(x).alias("n"), x.alias("v"))))["v"]
    return F.when(F.size(col) == 0, None).when(numbers, by_number).when(texts, pick(col))


def min_(a) -> Column:
    return _extreme(a, F.array_min)


def max_(a) -> Column:
    return _extreme(a, F.array_max)


def _all_numbers(a) -> Column:
    col = F.filter(_c(a), lambda x: x.isNotNull())
    return (F.size(col) > 0) & F.forall(col, lambda x: _number(x).isNotNull())


def sum_(a) -> Column:
    return F.when(_all_numbers(a), F.aggregate(as_nums(a), F.lit(0.0), lambda s, x: s + x))


def mean(a) -> Column:
    return sum_(a) / F.size(as_nums(a))


def variance(a) -> Column:
    """Population variance."""
    squares = once(mean(a), lambda m: F.aggregate(F.transform(as_nums(a), lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x))
    return F.when(_all_numbers(a), squares / F.size(as_nums(a)))


def stddev(a) -> Column:
    return F.sqrt(variance(a))


def percentile(a, p: float) -> Column:
    """Linear interpolation, p from 0 to 100; null when no item is a number."""
    if not 0 <= p <= 100:
        raise ValueError("percentile: p is outside 0..100")
    v = F.array_sort(as_nums(a))
    at = (F.size(v) - 1) * (p / 100)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.when(F.size(v) > 0, F.get(v, low) + (F.get(v, high) - F.get(v, low)) * (at - low))


def flatten_value(value, style: str = "bracket", depth: int = 0, prefix: str = "") -> dict:
    """A nested value as one level of paths; an empty container is null; beyond the depth (0: none) values stay whole."""
    out: dict = {}

    def walk(v, path, level):
        if isinstance(v, (dict, list)) and (not depth or level < depth):
            if not v:
                out[path] = None
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                if not path:
                    step = str(k) if isinstance(v, dict) or style != "bracket" else f"[{k}]"
                elif isinstance(v, list) and style == "bracket":
                    step = f"{path}[{k}]"
                else:
                    step = f"{path}{'_' if style == 'underscore' else '.'}{k}"
                walk(x, step, level + 1)
        else:
            out[path] = v

    walk(value, prefix, 0)
    return out


def _text(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))


def flattened(json_text, style: str = "bracket", depth: int = 0) -> Column:
    """A map of path and value text of a JSON array or object; an Arrow UDF, for the nesting has no declared shape."""

    def one(x):
        try:
            v = json.loads(x)
        except (TypeError, ValueError):
            return None
        return {k: _text(w) for k, w in flatten_value(v, style, depth).items()} if isinstance(v, (dict, list)) else None

    def run(v: pd.Series) -> pd.Series:
        return v.map(one)

    return F.pandas_udf(run, "map<string,string>")(_c(json_text))


def filter_(a, keep) -> Column:
    return F.filter(_c(a), keep)


def map_(a, f) -> Column:
    return F.transform(_c(a), f)


def reduce_(a, start, f) -> Column:
    return F.aggregate(_c(a), start, f)


def all_(a, test) -> Column:
    return F.forall(_c(a), test)


def some(a, test) -> Column:
    return F.exists(_c(a), test)


def push(a, item) -> Column:
    return F.array_append(_c(a), item)


def pop(a) -> Column:
    """Without the last item."""
    return F.slice(_c(a), F.lit(1), F.greatest(F.lit(0), F.size(_c(a)) - 1))


def contains(a, item) -> Column:
    return F.array_contains(_c(a), item)
