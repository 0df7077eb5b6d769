"""Map and JSON functions on columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import _c


def path_parts(path: str) -> list[str | int]:
    """a.b[0].c[-1] as its steps."""
    out: list[str | int] = []
    for m in re.finditer(r"\[(-?\d+)\]|([^.\[\]]+)", path):
        out.append(int(m[1]) if m[1] is not None else m[2])
    return out


def _json_path(parts) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + p.replace("'", "\\'") + "']" for p in parts)


def get_path(text, path: str, default=None) -> Column:
    """The value at a path of JSON text, as text; negative indexes count from the end; null or the default where missing."""
    parts, col, run = path_parts(path), _c(text), []
    for p in parts:
        if isinstance(p, int) and p < 0:
            array = F.from_json(F.get_json_object(col, _json_path(run)) if run else col, "array<string>")
            col, run = F.try_element_at(array, F.lit(p)), []
        else:
            run.append(p)
    out = F.get_json_object(col, _json_path(run)) if run else col
    return out if default is None else F.coalesce(out, F.lit(default))


def has_path(text, path: str) -> Column:
    """Whether the path is there; a null value counts."""
    parts = path_parts(path)
    parent = get_path(text, "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in parts[:-1]).lstrip(".")) if len(parts) > 1 else _c(text)
    last = parts[-1]
    if isinstance(last, int):
        n = F.json_array_length(parent)
        return F.coalesce((n > last) if last >= 0 else (n >= -last), F.lit(False))
    return F.coalesce(F.array_contains(F.json_object_keys(parent), last), F.lit(False))


def path_equals(text, path: str, value) -> Column:
    return get_path(text, path).eqNullSafe(F.lit(value).cast("string"))


def has(m, key: str) -> Column:
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)).isNotNull(), F.lit(False))


def get(m, key: str, default=None) -> Column:
    v = F.try_element_at(_c(m), F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def keep(m, keys: list[str]) -> Column:
    return F.map_filter(_c(m), lambda k, v: k.isin(keys))


def drop(m, keys: list[str]) -> Column:
    return F.map_filter(_c(m), lambda k, v: ~k.isin(keys))


def _concat(a: Column, b: Column) -> Column:
    """Entries of both; b's where keys meet."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def merge(a, b) -> Column:
    return _concat(_c(a), _c(b))


def enrich(a, b) -> Column:
    """b's entries only for keys that a lacks; a null that is there stays."""
    return _concat(_c(b), _c(a))


def rename_field(m, old: str, new: str) -> Column:
    """The entry under its new name, over one that had it; unchanged where there is none."""
    col = _c(m)
    one = F.create_map(F.lit(new), F.try_element_at(col, F.lit(old)))
    return F.when(F.map_contains_key(col, old), _concat(F.map_filter(col, lambda k, v: k != old), one)).otherwise(col)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.drop(new).withColumnRenamed(old, new) if old in df.columns else df


def merge_columns(df: DataFrame, other: dict[str, Column], overwrite: bool = True) -> DataFrame:
    """Columns of other over (or under) those of df: nulls give way."""
    order = (lambda o, n: F.coalesce(n, o)) if overwrite else F.coalesce
    return df.withColumns({k: order(F.col(k), v) if k in df.columns else v for k, v in other.items()})


def _tree(flat: dict, sep: str):
    root: dict = {}
    for path, v in flat.items():
        at, steps = root, path.split(sep)
        for s in steps[:-1]:
            if not isinstance(at.get(s), dict):
                at[s] = {}
            at = at[s]
        if not isinstance(at.get(steps[-1]), dict):
            at[steps[-1]] = v

    def lists(x):
        if not isinstance(x, dict):
            return x
        x = {k: lists(v) for k, v in x.items()}
        if x and all(k.isdigit() for k in x) and sorted(map(int, x)) == list(range(len(x))):
            return [x[str(i)] for i in range(len(x))]
        return x

    return lists(root)


def unflatten(m, sep: str = "_") -> Column:
    """JSON text of the nested value; siblings numbered from 0 make an array; an Arrow UDF."""

    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else json.dumps(_tree(dict(x), sep), separators=(",", ":"), ensure_ascii=False))

    return F.pandas_udf(run, "string")(_c(m))


# to text --------------------------------------------------------------------------------------------------------


def logfmt_value(v: Column) -> Column:
    esc = F.replace(F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    return F.when((v == "") | v.rlike(r'[\s"=\\]'), F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(v)


def logfmt_key(k: Column) -> Column:
    return F.regexp_replace(k, r'[\s="]', "_")


def to_logfmt(m) -> Column:
    e = F.filter(F.map_entries(_c(m)), lambda x: x["value"].isNotNull())
    return F.array_join(F.transform(e, lambda x: F.concat(logfmt_key(x["key"]), F.lit("="), logfmt_value(x["value"].cast("string")))), " ")


def to_kv(m, sep: str = " ", kv_sep: str = "=") -> Column:
    e = F.filter(F.map_entries(_c(m)), lambda x: x["value"].isNotNull())
    return F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(kv_sep), x["value"].cast("string"))), sep)


def _or(x: Column, default: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))


def to_syslog(pri, ts, host, prog, pid, msg) -> Column:
    """<pri>Mon dd hh:mm:ss host prog[pid]: msg."""
    tag = F.concat(_or(_c(prog), "-"), F.when(_c(pid).isNotNull(), F.concat(F.lit("["), _c(pid).cast("string"), F.lit("]"))).otherwise(""))
    return F.concat(F.lit("<"), _or(_c(pri), "13"), F.lit(">"), F.date_format(_c(ts), "MMM"), F.lit(" "), F.lpad(F.dayofmonth(_c(ts)).cast("string"), 2, " "), F.date_format(_c(ts), " HH:mm:ss"), F.lit(" "), _or(_c(host), "-"), F.lit(" "), tag, F.lit(": "), _or(_c(msg), ""))


def to_cef(vendor, product, version, event_id, event, severity, extension) -> Column:
    head = lambda x: F.replace(F.replace(_or(_c(x), ""), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    e = F.filter(F.map_entries(_c(extension)), lambda x: x["value"].isNotNull())
    ext = F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), F.replace(F.replace(x["value"], F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")))), " ")
    return F.concat_ws("|", F.lit("CEF:0"), *map(head, (vendor, product, version, event_id, event, severity)), ext)


def to_combined(ip, ts, request, status, size, referer, agent, user=None, identity=None) -> Column:
    d = lambda x: F.lit("-") if x is None else _or(_c(x), "-")
    return F.concat(d(ip), F.lit(" "), d(identity), F.lit(" "), d(user), F.date_format(_c(ts), " '['dd/MMM/yyyy:HH:mm:ss Z']' "), F.lit('"'), d(request), F.lit('" '), d(status), F.lit(" "), d(size), F.lit(' "'), d(referer), F.lit('" "'), d(agent), F.lit('"'))
