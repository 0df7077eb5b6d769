"""Event-level steps as DataFrame transformations. Each takes and returns a DataFrame; `order` is the arrival column."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.datetime import micros
from ..sources.formats import LEVEL_NAMES, MESSAGE_NAMES, TS_NAMES, canonical


def _expr(e: Column | str) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def keep_if(df: DataFrame, *conditions: Column | str, strict: bool = False) -> DataFrame:
    """Rows for which all conditions hold. An unknown result drops the row, or is an error when strict."""
    for c in conditions:
        e = _expr(c)
        df = df.where(F.coalesce(e, F.raise_error(F.lit("condition has no result")).cast("boolean"))) if strict else df.where(e)
    return df


def same(a: Column, b) -> Column:
    """Equality where a missing value equals a missing value and nothing else."""
    return a.eqNullSafe(b)


def differs(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def exec_(df: DataFrame, strict: bool = False, **new: Column | str) -> DataFrame:
    """New or changed columns, all or none: where one of them has no result, the row stays as it was (or is an error)."""
    tried = {k: _expr(v) for k, v in new.items()}
    work = df.withColumns({f"__new_{k}": v for k, v in tried.items()})
    ok = F.lit(True)
    for k in tried:
        ok = ok & F.col(f"__new_{k}").isNotNull()
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.lit("step failed")).cast("boolean"))
    kinds = dict(work.dtypes)
    out = {k: F.when(ok, F.col(f"__new_{k}")).otherwise(F.col(k).cast(kinds[f"__new_{k}"]) if k in df.columns else F.lit(None)) for k in tried}
    return work.withColumns(out).drop(*[f"__new_{k}" for k in tried])


def check(df: DataFrame, strict: bool = False, **conditions: Column | str) -> tuple[DataFrame, DataFrame]:
    """(df as it is, one row of failure counts by condition); strict makes a failure an error."""
    bad = {k: ~F.coalesce(_expr(c), F.lit(False)) for k, c in conditions.items()}
    counts = df.agg(*[F.count_if(b).alias(k) for k, b in bad.items()])
    if strict:
        for k, b in bad.items():
            df = df.where(F.when(b, F.raise_error(F.lit(f"assertion failed: {k}")).cast("boolean")).otherwise(True))
    return df, counts


def levels(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """By the first level field, without regard to case. Exclusion wins; a row without a level stays only if nothing is included."""
    level = F.lower(canonical(df, LEVEL_NAMES))
    if exclude:
        df = df.where(~F.coalesce(level.isin([x.lower() for x in exclude]), F.lit(False)))
    return df.where(level.isin([x.lower() for x in include])) if include else df


def keys(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Columns in the order asked for; exclusion wins; rows with nothing left go."""
    names = [c for c in (include or df.columns) if c in df.columns and c not in (exclude or [])]
    return df.select(*names).dropna(how="all") if names else df.select().limit(0)


def core(df: DataFrame) -> DataFrame:
    """Only the fields that are a timestamp, a level or a message by name."""
    return keys(df, [c for c in df.columns if c in {*TS_NAMES, *LEVEL_NAMES, *MESSAGE_NAMES}])


def between(df: DataFrame, ts: str, since: datetime | None = None, until: datetime | None = None, strict: bool = False) -> DataFrame:
    """Both ends included; rows without a timestamp go, or are an error when strict."""
    t = F.when(F.col(ts).isNull(), F.raise_error(F.lit("event has no timestamp")).cast("timestamp")).otherwise(F.col(ts)) if strict else F.col(ts)
    df = df.where(t.isNotNull())
    if since is not None:
        df = df.where(t >= F.lit(since))
    return df.where(t <= F.lit(until)) if until is not None else df


def take(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def context(df: DataFrame, match: Column | str, order: str, before: int = 0, after: int = 0, by: list[str] | None = None) -> DataFrame:
    """Matches and their neighbours, each row once, with context_type match, before, after or both.

    Without by the order is global: neighbours are found within parts of the order, and each part also gets the rows of
    its neighbours that reach into it, so no task holds the stream.
    """
    hit = F.coalesce(_expr(match), F.lit(False))
    if by:
        return _mark(df.withColumn("__hit", hit), Window.partitionBy(*by).orderBy(order), before, after)
    spread = _overlapping(df.withColumn("__hit", hit), order, before + after, before + after)
    marked = _mark(spread, Window.partitionBy("__in").orderBy("__n"), before, after, keep_all=True)
    return marked.where(F.col("__own") == F.col("__in")).where("context_type is not null").drop("__own", "__in", "__n")


def _overlapping(df: DataFrame, order: str, before: int, after: int) -> DataFrame:
    """df with row numbers __n in stretches __own, each row also in the stretches (__in) that reach back or on to it.

    A window of so many rows before and after is then whole inside a stretch, and no task holds the stream.
    """
    from ..sources.lines import running_sum

    numbered = running_sum(df, F.lit(1).cast("long"), order, "__n")
    size = max(10_000, 4 * (before + after + 1))
    own = F.floor(F.col("__n") / size)
    reach = F.array_distinct(F.array(F.floor((F.col("__n") - after) / size), own, F.floor((F.col("__n") + before) / size)))
    return numbered.withColumn("__own", own).withColumn("__in", F.explode(reach))


def _mark(df: DataFrame, w, before: int, after: int, keep_all: bool = False) -> DataFrame:
    coming = F.max("__hit").over(w.rowsBetween(1, before)) if before else F.lit(False)
    gone = F.max("__hit").over(w.rowsBetween(-after, -1)) if after else F.lit(False)
    coming, gone = F.coalesce(coming, F.lit(False)), F.coalesce(gone, F.lit(False))
    kind = F.when(F.col("__hit"), "match").when(coming & gone, "both").when(coming, "before").when(gone, "after")
    out = df.withColumn("context_type", kind).drop("__hit")
    return out if keep_all else out.where("context_type is not null")


def level_context(df: DataFrame, order: str, before: int = 0, after: int = 0, include: list[str] | None = None, exclude: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Events of the levels and their neighbours of any level, as context() gives them."""
    level = F.lower(canonical(df, LEVEL_NAMES))
    out = F.coalesce(level.isin([x.lower() for x in exclude]), F.lit(False)) if exclude else F.lit(False)
    inside = F.coalesce(level.isin([x.lower() for x in include]), F.lit(False)) if include else F.lit(True)
    return context(df, inside & ~out, order, before, after, by)


def normalize_ts(df: DataFrame, field: str, parsed: Column) -> DataFrame:
    """field rewritten as RFC 3339 in UTC where it could be read."""
    return df.withColumn(field, F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), F.col(field).cast("string")))


def skip_if(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(~F.coalesce(_expr(condition), F.lit(False)))


def stop(message: str, code: int = 1) -> None:
    raise SystemExit(code) from RuntimeError(message)


def emit_each(df: DataFrame, items: str, base: list[str] | None = None) -> DataFrame:
    """One row for each struct of the array: base columns, then the struct's fields, which win. Empty and null arrays give none."""
    fields = df.schema[items].dataType.elementType.fieldNames()
    rows = df.select(*[c for c in (base or []) if c not in fields], F.explode(items).alias("__item"))
    return rows.where("__item is not null").select(*[c for c in (base or []) if c not in fields], "__item.*")


def remove(df: DataFrame, *fields: str) -> DataFrame:
    """Without the fields; rows with nothing left go."""
    return df.drop(*fields).dropna(how="all")


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Enrichment from a lookup table: a left join that is a broadcast while the optimizer finds the table small."""
    return df.join(table.dropDuplicates(on), on, "left")


def only_in(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys another table has; each row once."""
    return df.join(table.select(*on), on, "left_semi")


def without(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys another table lacks; rows with a null key stay."""
    return df.join(table.select(*on), on, "left_anti")


def as_of(df: DataFrame, other: DataFrame, ts: str, other_ts: str, on: list[str], take: dict[str, str], order: str, tie: str) -> DataFrame:
    """df with columns of other's last row, by its time and then tie, at or before each row's time; take: new name -> other's column.

    Both sides are one stream by key and time in which the last of other's rows is carried on: one shuffle by key, no
    join, no pairs. Rows of df come back each, null where other has none. A key's rows are one task's; the window spills.
    """
    found = F.struct(*[F.col(f"`{c}`").alias(n) for n, c in take.items()])
    kinds = {f.name: f.dataType for f in other.select(found.alias("s")).schema["s"].dataType}
    a = df.select(*on, F.col(ts).cast("timestamp").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(other.schema[tie].dataType).alias("__tie"), F.lit(None).cast(other.select(found.alias("s")).schema["s"].dataType).alias("__found"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))
    b = other.select(*on, F.col(other_ts).cast("timestamp").alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), found.alias("__found"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*on).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = a.unionByName(b).withColumn("__last", F.last("__found", ignorenulls=True).over(w)).where("__side = 1")
    return carried.select("__row.*", *[F.col(f"__last.{n}").alias(n) for n in kinds])


def sample_every(df: DataFrame, n: int, order: str) -> DataFrame:
    """The nth, 2nth, ... row by the order, numbered in two levels."""
    from ..sources.lines import running_sum

    return running_sum(df, F.lit(1).cast("long"), order, "__n").where(F.col("__n") % n == 0).drop("__n")


def window_values(df: DataFrame, order: str, n: int, fields: list[str], by: list[str] | None = None, name: str = "window") -> DataFrame:
    """An array of the current and the n earlier rows' fields, the current first. by splits the stream.

    Without by the stream is cut into stretches that overlap by n rows.
    """
    items = F.collect_list(F.struct(*fields))
    if by:
        return df.withColumn(name, F.reverse(items.over(Window.partitionBy(*by).orderBy(order).rowsBetween(-n, 0))))
    spread = _overlapping(df, order, n, 0)
    out = spread.withColumn(name, F.reverse(items.over(Window.partitionBy("__in").orderBy("__n").rowsBetween(-n, 0))))
    return out.where(F.col("__own") == F.col("__in")).drop("__own", "__in", "__n")


def mark_gaps(df: DataFrame, ts: str, order: str, seconds: float, by: list[str] | None = None) -> DataFrame:
    """gap_us where the step from the last timestamp, in either direction, is at least the duration.

    Without by the last timestamp is carried over parts of the order.
    """
    from .spans import before_last

    out = before_last(df, order, "__last", micros(ts), by or ())
    step = F.abs(micros(ts) - F.col("__last"))
    return out.withColumn("gap_us", F.when(step >= int(seconds * 1e6), step)).drop("__last")
