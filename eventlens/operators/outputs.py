"""Outputs: rows as text lines of a format, maps of characters, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maps import logfmt_key, logfmt_value
from ..sources.formats import LEVEL_NAMES, MESSAGE_NAMES, TS_NAMES, canonical


def ordered_fields(df: DataFrame, skip=()) -> list[str]:
    """Timestamp, level and message first, the rest as they come."""
    names = [c for c in df.columns if c not in skip]
    lead = [next((n for n in group if n in names), None) for group in (TS_NAMES, LEVEL_NAMES, MESSAGE_NAMES)]
    lead = [x for x in lead if x]
    return lead + [c for c in names if c not in lead]


def _is_nested(kind: str) -> bool:
    return kind.startswith(("struct", "array", "map", "variant"))


def _text(df: DataFrame, c: str) -> Column:
    return F.to_json(F.col(c)) if _is_nested(dict(df.dtypes)[c]) else F.col(c).cast("string")


def as_default(df: DataFrame, brief: bool = False) -> Column:
    """key='value' pairs; with brief the values alone. Nulls are left out."""
    kinds = dict(df.dtypes)
    parts = []
    for c in ordered_fields(df):
        v = _text(df, c)
        shown = F.concat(F.lit("'"), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")) if kinds[c] in ("string", "timestamp") and not brief else v
        parts.append(F.when(F.col(c).isNotNull(), shown if brief else F.concat(F.lit(c + "="), shown)))
    return F.concat_ws(" ", *parts)


def as_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in ordered_fields(df)]))


def as_logfmt(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(logfmt_key(F.lit(c)), F.lit("="), logfmt_value(_text(df, c)))) for c in ordered_fields(df)])


def _flat_cells(x: Column, kind, path: str = "") -> list[Column]:
    """(path, text) of each scalar inside a value of a declared shape; steps are joined by underscores."""
    from pyspark.sql import types as T

    step = lambda k: f"{path}_{k}" if path else str(k)
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _flat_cells(x[f.name], f.dataType, step(f.name))]
    pair = lambda k, v: F.struct(k.alias("k"), v.cast("string").alias("v"))
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    lead = F.lit(f"{path}_" if path else "")
    text = (lambda v: F.to_json(v)) if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)) else (lambda v: v.cast("string"))
    if isinstance(kind, T.ArrayType):
        return [F.transform(x, lambda v, i: pair(F.concat(lead, i.cast("string")), text(v)))]
    if isinstance(kind, T.MapType):
        return [F.transform(F.map_entries(x), lambda e: pair(F.concat(lead, e["key"]), text(e["value"])))]
    return [F.array(pair(F.lit(path), x))]


def nested_cell(df: DataFrame, c: str) -> Column:
    """A nested value as k:v pairs with commas between, nulls left out; an empty one is empty."""
    parts = _flat_cells(F.col(f"`{c}`"), df.schema[c].dataType)
    pairs = F.filter(F.concat(*parts) if len(parts) > 1 else parts[0], lambda e: e["v"].isNotNull())
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["k"], F.lit(":"), e["v"])), ",")


def as_csv(df: DataFrame, keys: list[str], sep: str = ",") -> Column:
    """Fields quoted where they must be: empty ones, those with the separator, quotes or line ends, or blanks at an end. Nulls are bare."""
    def one(c):
        if c not in df.columns:
            return F.lit("")
        v = nested_cell(df, c) if _is_nested(dict(df.dtypes)[c]) else F.col(f"`{c}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when((v == "") | v.rlike(rf'["\r\n{sep}]|^ | $'), quoted).otherwise(v), F.lit(""))

    # concat_ws keeps empty strings and leaves out nulls only
    return F.concat_ws(sep, *[one(c) for c in keys])


def as_inspect(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c} | {kinds[c]} | "), F.coalesce(_text(df, c), F.lit("null"))) for c in ordered_fields(df)])


def _chart(df: DataFrame, mark: Column, order: str, width: int, start: Column | None = None) -> DataFrame:
    """line, text: marks in order, width a line, with the first event's start. Rows are numbered in two levels."""
    from ..sources.lines import running_sum

    own = df.select(F.col(order).alias("__o"), mark.alias("__m"), (start if start is not None else F.lit(None).cast("string")).alias("__s"))
    n = running_sum(own, F.lit(1).cast("long"), "__o", "__n").withColumn("line", F.floor((F.col("__n") - 1) / width).cast("long"))
    rows = n.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("__o", "__m"))).alias("__l"), F.min_by("__s", "__o").alias("start"))
    return rows.select("line", "start", F.array_join(F.transform("__l", lambda x: x["__m"]), "").alias("text"))


def levelmap(df: DataFrame, order: str, width: int = 80, ts: str | None = None) -> DataFrame:
    """The first character of each event's level, ? without one."""
    level = canonical(df, LEVEL_NAMES)
    return _chart(df, F.coalesce(F.nullif(F.left(level, F.lit(1)), F.lit("")), F.lit("?")), order, width, F.col(ts).cast("string") if ts else None)


def hide(df: DataFrame) -> DataFrame:
    """No output: the steps run, no row is left."""
    return df.where(F.lit(False))


def keymap(df: DataFrame, field: str, order: str, width: int = 80) -> DataFrame:
    return _chart(df, F.coalesce(F.nullif(F.left(F.col(field).cast("string"), F.lit(1)), F.lit("")), F.lit(".")), order, width)


def tailmap(df: DataFrame, field: str, order: str, width: int = 80, exact: bool = False) -> DataFrame:
    """_ under the 90th percentile, 1 from it, 2 from the 95th, 3 from the 99th, . for none.

    Percentiles are a sketch's, to a ten-thousandth of the ranks; exact ones hold every distinct value in one buffer.
    """
    x, ps = F.col(field).try_cast("double"), F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99))
    cuts = df.agg((F.percentile(x, ps) if exact else F.percentile_approx(x, ps, 10_000)).alias("__q"))
    both = df.crossJoin(F.broadcast(cuts))  # one row
    q = F.col("__q")
    mark = F.when(x.isNull(), ".").when(x < q[0], "_").when(x < q[1], "1").when(x < q[2], "2").otherwise("3")
    return _chart(both, mark, order, width)


def write(df: DataFrame, path: str, format: str, keys: list[str] | None = None, mode: str = "error") -> None:
    """Writes the rows as files of text lines."""
    if format in ("csv", "tsv", "csvnh", "tsvnh"):
        if not keys:
            raise ValueError(f"{format} needs keys")
        df.select(*[F.col(k).cast("string").alias(k) if not _is_nested(dict(df.dtypes)[k]) else F.to_json(k).alias(k) for k in keys]).write.mode(mode).csv(path, sep="\t" if format[0] == "t" else ",", header=not format.endswith("nh"))
        return
    line = {"default": as_default, "json": as_json, "logfmt": as_logfmt, "inspect": as_inspect}[format](df)
    df.select(line.alias("value")).write.mode(mode).text(path)


def append_files(df: DataFrame, path: str, name: str, line: str) -> None:
    """Lines below path, one folder for each value of name."""
    df.select(name, F.col(line).cast("string").alias("value")).write.mode("append").partitionBy(name).text(path)


#: Result of a run as a process would report it.
EXIT_OK, EXIT_FAILED, EXIT_USAGE = 0, 1, 2


