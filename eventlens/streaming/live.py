"""Structured Streaming forms: file source, watermarked spans, idle sessions, dedupe, arrival-order spans with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def read_parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def time_spans(df: DataFrame, ts: str, duration: str, late: str, *aggregates: Column, by=()) -> DataFrame:
    """Tumbling windows in event time; state is dropped once the watermark passes a window."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, duration), *by).agg(*aggregates)


def hop_spans(df: DataFrame, ts: str, duration: str, slide: str, late: str, *aggregates: Column, by=()) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, duration, slide), *by).agg(*aggregates)


def idle_spans(df: DataFrame, ts: str, gap: str, late: str, *aggregates: Column, by=()) -> DataFrame:
    """Sessions; last_ts is the last event's time, not that time plus the gap."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.max(ts).alias("last_ts"), *aggregates)


def dedupe(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def field_spans(df: DataFrame, key: str, field: str, order: str) -> DataFrame:
    """(key, span_no, value, size): spans of equal values in arrival order, one stream of state a key.

    A span is emitted when the value changes; what is open stays in state.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, value, size = state.get if state.exists else (0, None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[field]:
            if v is None or v == value:
                size += 1
                continue
            if size:
                out.append((k[0], no, value, size))
            no, value, size = no + 1, v, 1
        state.update((no, value, size))
        yield pd.DataFrame(out, columns=[key, "span_no", "value", "size"])

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, span_no long, value string, size long", "no long, value string, size long", "append", GroupStateTimeout.NoTimeout)


def stateful(df: DataFrame, key: str, order: str, step, schema: str) -> DataFrame:
    """The events that step(state, event) emits, one map a key, kept from batch to batch as JSON text.

    Rows of a key in one batch come in their order; batches in the order of arrival.
    """
    import json

    from pyspark.sql.types import _parse_datatype_string

    from ..operators.state import State, _emitted

    names = _parse_datatype_string(schema).fieldNames()

    def run(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = State(json.loads(kept.get[0])) if kept.exists else State()
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for event in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            out += _emitted(step(state, event))
        kept.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a memory table and returns it; for tests and checks."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
