"""The track family: named metrics, each a plain aggregate, and summaries built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import round_
from ..functions.strings import _c


def value_text(v) -> Column:
    """A value as the frequency tables show it: whole floats without a fraction."""
    s = _c(v).cast("string")
    return F.regexp_replace(s, r"^(-?[0-9]+)\.0\z", "$1")


def freq(df: DataFrame, field: str) -> DataFrame:
    """value, count; nulls don't count. Order by count descending, then value, where it is shown."""
    return df.where(F.col(field).isNotNull()).groupBy(value_text(field).alias("value")).agg(F.count("*").alias("count"))


def inc(condition: Column | None = None) -> Column:
    return F.count("*") if condition is None else F.count_if(condition)


def total(v) -> Column:
    return F.sum(_c(v))


def average(v) -> Column:
    """0 where there are no values."""
    return F.coalesce(F.avg(_c(v)), F.lit(0.0))


def least(v) -> Column:
    return F.min(_c(v))


def most(v) -> Column:
    return F.max(_c(v))


def unique(df: DataFrame, field: str, order: str) -> DataFrame:
    """Distinct values with the place of the first of each; order by it for first-seen order."""
    return df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.min(order).alias("first_seen"))


def cardinality(v, error: float = 0.01) -> Column:
    """HyperLogLog estimate; the error is kept between 0.001 and 0.26."""
    return F.approx_count_distinct(_c(v).cast("string"), min(0.26, max(0.001, error)))


def cardinality_sketch(v, lg_k: int = 14) -> Column:
    """The mergeable form; union with F.hll_union_agg, read with F.hll_sketch_estimate."""
    return F.hll_sketch_agg(_c(v).cast("string"), lg_k)


def with_distinct(df: DataFrame, field: str, *aggregates: Column) -> DataFrame:
    """One row of the aggregates and exact, the number of different values; each side is an aggregation of its own.

    In a single agg(), Catalyst groups by the counted value first and keeps a buffer of every other aggregate for each value: a whole sketch a value.
    """
    return df.agg(*aggregates).crossJoin(F.broadcast(df.agg(F.countDistinct(field).alias("exact"))))


def _check(n: int) -> None:
    if n < 1:
        raise ValueError("n must be 1 or more")


def top(df: DataFrame, item: str, n: int = 10) -> DataFrame:
    """The n commonest items, then by value."""
    _check(n)
    return freq(df, item).orderBy(F.desc("count"), "value").limit(n)


def bottom(df: DataFrame, item: str, n: int = 10) -> DataFrame:
    _check(n)
    return freq(df, item).orderBy("count", "value").limit(n)


def top_by(df: DataFrame, item: str, score: str, n: int = 10) -> DataFrame:
    """Items by their highest score."""
    _check(n)
    best = df.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(value_text(item).alias("value")).agg(F.max(score).alias("score"))
    return best.orderBy(F.desc("score"), "value").limit(n)


def bottom_by(df: DataFrame, item: str, score: str, n: int = 10) -> DataFrame:
    """Items by their lowest score."""
    _check(n)
    best = df.where(F.col(item).isNotNull() & F.col(score).isNotNull()).groupBy(value_text(item).alias("value")).agg(F.min(score).alias("score"))
    return best.orderBy("score", "value").limit(n)


def _finite(v) -> Column:
    x = _c(v).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def suffix(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def percentiles(v, ps=(0.5, 0.95, 0.99), exact: bool = False, name: str = "") -> list[Column]:
    """One column a percentile, named <name>_p95. By a sketch, or exact."""
    pre = f"{name}_" if name else ""
    f = (lambda p: F.percentile(_finite(v), p)) if exact else (lambda p: F.approx_percentile(_finite(v), F.lit(p), F.lit(10_000)))
    return [f(p).alias(pre + suffix(p)) for p in ps]


def stats(v, ps=(0.5, 0.95, 0.99), exact: bool = False, name: str = "") -> list[Column]:
    """min, max, avg, count, sum as floats, and percentiles: one aggregation."""
    pre, x = f"{name}_" if name else "", _finite(v)
    return [F.min(x).alias(pre + "min"), F.max(x).alias(pre + "max"), F.coalesce(F.avg(x), F.lit(0.0)).alias(pre + "avg"), F.count(x).cast("double").alias(pre + "count"), F.coalesce(F.sum(x), F.lit(0.0)).alias(pre + "sum"), *percentiles(v, ps, exact, name)]


class Metrics:
    """Named metrics over one DataFrame: scalars in one aggregation, keyed ones as frames. A name belongs to one kind."""

    def __init__(self, df: DataFrame):
        self.df, self.kinds, self.scalars, self.frames = df, {}, {}, {}

    def _claim(self, name: str, kind: str) -> None:
        if self.kinds.setdefault(name, kind) != kind:
            raise ValueError(f"metric {name!r} is already of kind {self.kinds[name]}, not {kind}")

    def track(self, name: str, kind: str, *args, **kw) -> Metrics:
        self._claim(name, kind)
        one = {"inc": inc, "sum": total, "avg": average, "min": least, "max": most, "cardinality": cardinality}
        many = {"freq": freq, "top": top, "bottom": bottom, "top_by": top_by, "bottom_by": bottom_by, "unique": unique}
        if kind in one:
            self.scalars[name] = one[kind](*args, **kw).alias(name)
        elif kind in many:
            self.frames[name] = many[kind](self.df, *args, **kw)
        elif kind in ("percentiles", "stats"):
            for c in {"percentiles": percentiles, "stats": stats}[kind](*args, name=name, **kw):
                self.scalars[f"{name}:{len(self.scalars)}"] = c
        else:
            raise ValueError(f"unknown metric kind: {kind}")
        return self

    def table(self) -> DataFrame:
        """(metric, key, value) of all metrics."""
        out = None
        if self.scalars:
            row = self.df.agg(*self.scalars.values())
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(c).cast("double").alias("value")) for c in row.columns]))
            out = row.select(pairs.alias("r")).select("r.*")
        for name, f in self.frames.items():
            key, value = f.columns
            one = f.select(F.lit(name).alias("metric"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
            out = one if out is None else out.unionByName(one)
        return out


    def finish(self, f=None, most: int = 10_000):
        """The finalised metrics as a dict, given to f, if there is one: what runs once at the end of a run.

        Scalars are values, keyed metrics dicts of the `most` greatest entries at most: a report, on the driver.
        """
        out = dict(self.df.agg(*self.scalars.values()).first().asDict()) if self.scalars else {}
        for name, frame in self.frames.items():
            key, value = frame.columns
            out[name] = {r[0]: r[1] for r in frame.orderBy(F.desc(value), key).limit(most).collect()}
        return f(out) if f else out

    def text(self, form: str = "short", most: int = 10) -> str:
        """The report as text: short (the first entries of keyed metrics) or full, by name; tsv (metric, key, value), or json."""
        import json

        found = self.finish()
        show = lambda v: f"{v:g}" if isinstance(v, float) else str(v)
        if form == "json":
            return json.dumps({k: found[k] for k in sorted(found)}, default=str, ensure_ascii=False)
        if form == "tsv":
            rows = [(n, k, v) for n in sorted(found) for k, v in (found[n].items() if isinstance(found[n], dict) else [("", found[n])])]
            return "".join(f"{n}\t{k}\t{show(v)}\n" for n, k, v in rows)
        if form not in ("short", "full"):
            raise ValueError(f"unknown form: {form}")
        lines = []
        for n in sorted(found):
            if not isinstance(found[n], dict):
                lines.append(f"{n} = {show(found[n])}")
                continue
            entries = list(found[n].items())
            shown = entries if form == "full" else entries[:most]
            lines += [f"{n} ({len(entries)} entries):", *[f"  {k} = {show(v)}" for k, v in shown]]
            if len(shown) < len(entries):
                lines.append(f"  ... {len(entries) - len(shown)} more")
        return "\n".join(lines) + "\n"


#: Kinds of JSON values, and how many examples of a field are kept.
KINDS, SAMPLES = ["null", "object", "array", "bool", "int", "float", "string"], 8


def discover(df: DataFrame, json_col: str, depth: int = 3, most: int = 500) -> DataFrame:
    """The fields of JSON texts, nested ones to a depth, items of arrays as path[]: the `most` commonest, by events.

    path, events, missing_pct, types, a count of values of each kind (kinds), distinct (exact to 256, beyond that
    estimated), the SAMPLES values with the least hashes, the least and greatest value, and the least and greatest size
    of objects and arrays.
    """
    v = F.col("v")
    kind = F.when(v.isNull(), "null").when(v.startswith("{"), "object").when(v.startswith("["), "array").when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?[0-9]+\z"), "int").when(v.rlike(r"^-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?\z"), "float").otherwise("string")
    level = df.select(F.monotonically_increasing_id().alias("e"), F.lit("").alias("path"), F.col(json_col).alias("v"))
    found = None
    for _ in range(depth):
        at = level.where(F.ltrim("v").startswith("{")).select("e", "path", F.explode(F.from_json("v", "map<string,string>")).alias("k", "v"))
        fields = at.select("e", F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), F.col("k")).alias("path"), "v")
        items = level.where(F.ltrim("v").startswith("[")).select("e", F.concat("path", F.lit("[]")).alias("path"), F.explode(F.from_json("v", "array<string>")).alias("v"))
        level = fields.unionByName(items)
        found = level if found is None else found.unionByName(level)
    n = df.count()
    size = F.when(v.startswith("{"), F.size(F.json_object_keys("v"))).when(v.startswith("["), F.json_array_length("v"))
    # values are counted first, so a common one is one row in what follows
    values = found.groupBy("path", "v").agg(F.count_distinct("e").alias("events"), F.count("*").alias("n"))
    per_value = values.select("path", "v", "events", "n", kind.alias("kind"), size.alias("size"), F.xxhash64("v").alias("h"))
    counts = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"__{k}") for k in KINDS]
    pick = F.expr(f"transform(slice(array_sort(collect_list(if(r <= {SAMPLES}, named_struct('h', h, 'v', v), null))), 1, {SAMPLES}), x -> x.v)")
    # a path's values are ranked in 256 parts, so no task sees all of them; the least of all are among each part's
    ranked = per_value.withColumn("r", F.row_number().over(Window.partitionBy("path", F.pmod("h", F.lit(256))).orderBy("h")))
    per = ranked.groupBy("path").agg(F.count("v").alias("exact"), F.approx_count_distinct("v", 0.01).alias("about"), F.array_sort(F.collect_set("kind")).alias("types"), pick.alias("samples"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), *counts)
    events = found.groupBy("path").agg(F.count_distinct("e").alias("events"))
    kinds = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.col(f"__{k}") for k in KINDS])), lambda _, c: c > 0)
    distinct = F.when(F.col("exact") <= 256, F.col("exact")).otherwise(F.col("about")).alias("distinct")
    out = per.join(events, "path").select("path", "events", round_(100 * (1 - F.col("events") / n), 4).alias("missing_pct"), "types", kinds.alias("kinds"), distinct, "samples", "least", "greatest", "min_size", "max_size")
    return out.orderBy(F.desc("events"), "path").limit(most)


def run_stats(df: DataFrame, ts: str | None = None, level: str | None = None, read: DataFrame | None = None, parsed: str | None = None) -> DataFrame:
    """One row: events, first and last timestamp, events without one, distinct levels; with the lines that were read, also
    lines, lines filtered out and, where a column of parsed values is named, lines that could not be parsed.
    """
    out = [F.count("*").alias("events")]
    if ts:
        out += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_if(F.col(ts).isNull()).alias("without_ts"), ((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1_000_000).alias("span_seconds")]
    if level:
        out.append(F.array_sort(F.collect_set(F.upper(level))).alias("levels"))
    row = df.agg(*out)
    if read is None:
        return row
    bad = F.count_if(F.col(parsed).isNull()) if parsed else F.lit(0).cast("long")
    seen = read.agg(F.count("*").alias("lines"), bad.alias("parse_errors"))
    both = row.crossJoin(F.broadcast(seen))  # one row each
    return both.withColumn("filtered", F.col("lines") - F.col("parse_errors") - F.col("events"))
