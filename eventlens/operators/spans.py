"""Spans: consecutive events grouped by count, time, field value or idle gap.

Spans follow arrival, so they need running values over the order. by names columns whose groups are streams of their
own; without it the stream is cut into parts, and what a part needs from those before it is one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.datetime import micros
from ..sources.lines import parts, running_sum


def _carried(df: DataFrame, order: str, name: str, value: Column, by: list[str], pick, last: bool, cut=None) -> DataFrame:
    """df with pick (a max or a last value) of value over the rows before each one, in two levels."""
    cut = cut or parts(df, order)
    own = cut(df.withColumn("__v", value))
    local = pick("__v").over(Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    ends = own.groupBy(*by, "__part").agg((F.max_by(F.when(F.col("__v").isNotNull(), F.col("__v")), F.when(F.col("__v").isNotNull(), F.col(order))) if last else F.max("__v")).alias("__t"))
    before = ends.withColumn("__before", pick("__t").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__t")
    if by:
        null_safe = before.select(*[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col("__part").alias("__p"), "__before")
        on = F.col("__part") == F.col("__p")
        for i, b in enumerate(by):
            on = on & F.col(b).eqNullSafe(F.col(f"__by{i}"))
        joined = own.withColumn("__local", local).join(null_safe, on).drop("__p", *[f"__by{i}" for i in range(len(by))])
    else:
        # one row a part
        joined = own.withColumn("__local", local).join(F.broadcast(before), "__part")
    both = F.coalesce("__local", "__before") if last else F.greatest("__local", "__before")
    return joined.withColumn(name, both).drop("__v", "__part", "__local", "__before")


def before_max(df, order, name, value, by=(), cut=None):
    return _carried(df, order, name, value, list(by), F.max, False, cut)


def before_last(df, order, name, value, by=(), cut=None):
    return _carried(df, order, name, value, list(by), lambda c: F.last(c, ignorenulls=True), True, cut)


def _running(df: DataFrame, value: Column, order: str, name: str, by: list[str], cut=None) -> DataFrame:
    if not by:
        return running_sum(df, value, order, name, cut)
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(order)))


def count_spans(df: DataFrame, order: str, n: int, by=()) -> DataFrame:
    """span_id #k of n emitted events each; use after the filters."""
    out = _running(df, F.lit(1).cast("long"), order, "__n", list(by))
    return out.withColumn("span_no", F.floor((F.col("__n") - 1) / n).cast("long")).withColumn("span_id", F.concat(F.lit("#"), F.col("span_no").cast("string"))).drop("__n")


def time_spans(df: DataFrame, ts: str, order: str, duration: str, by=()) -> DataFrame:
    """Epoch-aligned windows of arrival: span_start, span_end, span_status (included, late, unassigned), span_id.

    An event whose window starts before one already open is late and in no span; one without a timestamp is unassigned.
    """
    us = _micros(duration)
    at = micros(ts)
    begin = at - F.pmod(at, F.lit(us))
    out = before_max(df.withColumn("__b", begin), order, "__open", F.col("__b"), by)
    status = F.when(F.col("__b").isNull(), "unassigned").when(F.col("__b") < F.col("__open"), "late").otherwise("included")
    out = out.withColumn("span_status", status)
    ok = F.col("span_status") == "included"
    return out.withColumns({"span_start": F.when(ok, F.timestamp_micros("__b")), "span_end": F.when(ok, F.timestamp_micros(F.col("__b") + us)), "span_id": F.when(ok, F.concat(F.date_format(F.timestamp_micros("__b"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("/" + duration)))}).drop("__b", "__open")


def span_status(df: DataFrame, keep: Column, statuses: str = "span_status") -> DataFrame:
    """df with status filtered, and no span, for rows that a filter after the spans drops: they are told apart, not lost."""
    gone = ~F.coalesce(keep, F.lit(False))
    own = [c for c in ("span_id", "span_start", "span_end") if c in df.columns]
    kinds = dict(df.dtypes)
    return df.withColumns({statuses: F.when(gone, "filtered").otherwise(F.col(statuses)), **{c: F.when(~gone, F.col(c)).otherwise(F.lit(None).cast(kinds[c])) for c in own}})


def _micros(duration: str) -> int:
    from .timeargs import seconds

    return int(seconds(duration) * 1_000_000)


def field_spans(df: DataFrame, field: str, order: str, by=()) -> DataFrame:
    """A new span whenever the value changes; an event without the field goes on with the open span, (unset) before any."""
    cut = parts(df, order)
    out = before_last(df, order, "__prev", F.col(field).cast("string"), by, cut)
    value = F.coalesce(F.col(field).cast("string"), F.col("__prev"), F.lit("(unset)"))
    seen = F.coalesce(F.col("__prev"), F.lit("(unset)"))
    out = out.withColumn("__value", value).withColumn("__new", F.when(F.col(field).isNotNull() & (F.col("__prev").isNull() | (value != seen)), 1).otherwise(0).cast("long"))
    out = _running(out, F.col("__new"), order, "span_no", list(by), cut)
    return out.withColumn("span_id", F.concat(F.lit("#"), F.col("span_no").cast("string"), F.lit("-"), F.col("__value"))).withColumn("span_value", F.col("__value")).drop("__prev", "__value", "__new")


def idle_spans(df: DataFrame, ts: str, order: str, seconds: float, by=()) -> DataFrame:
    """A new span when an event comes more than the timeout after the latest timestamp so far; late ones join the open span."""
    cut = parts(df, order)
    out = before_max(df, order, "__top", micros(ts), by, cut)
    new = micros(ts).isNotNull() & (F.col("__top").isNull() | (micros(ts) - F.col("__top") > int(seconds * 1e6)))
    out = _running(out.withColumn("__new", new.cast("long")), F.col("__new"), order, "span_no", list(by), cut)
    return out.withColumn("span_id", F.when(F.col(ts).isNotNull(), F.concat(F.lit("idle-#"), F.col("span_no").cast("string")))).drop("__top", "__new")


def close_spans(df: DataFrame, *aggregates: Column, ts: str | None = None, order: str | None = None, by=(), events: list[str] | None = None) -> DataFrame:
    """One row a span: its id, size, first and last timestamp, the aggregates, and the events themselves where asked."""
    own = [F.count("*").alias("span_size")]
    if ts:
        own += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    if events:
        own.append(F.array_sort(F.collect_list(F.struct(order, *[e for e in events if e != order]))).alias("span_events"))
    return df.where("span_id is not null").groupBy(*by, "span_id").agg(*own, *aggregates)




def first_seen(df: DataFrame, field: str, order: str) -> DataFrame:
    """(span_id, new_values): how many values of field came first in each span."""
    first = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.min_by("span_id", order).alias("span_id"))
    return first.groupBy("span_id").agg(F.count("*").alias("new_values"))
