"""A fluent, lazy pipeline over events: the steps in the order they are called."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame

from ..operators import drain, events, metrics, outputs, spans, state, timeargs


class Events:
    """A DataFrame with an arrival order. Every method returns a new, lazy pipeline."""

    def __init__(self, df: DataFrame, order: str = "_seq", ts: str | None = None):
        self.df, self.order, self.ts = df, order, ts

    def _with(self, df: DataFrame) -> Events:
        return Events(df, self.order, self.ts)

    def filter(self, *conditions: Column | str) -> Events:
        return self._with(events.keep_if(self.df, *conditions))

    def exec(self, **new: Column | str) -> Events:
        return self._with(events.exec_(self.df, **new))

    def levels(self, include=None, exclude=None) -> Events:
        return self._with(events.levels(self.df, include, exclude))

    def keys(self, *include: str, exclude=None) -> Events:
        return self._with(events.keys(self.df, list(include) or None, exclude))

    def between(self, since: str | None = None, until: str | None = None, now: datetime | None = None) -> Events:
        a, b = timeargs.resolve_range(since, until, now or datetime.now(UTC))
        return self._with(events.between(self.df, self.ts, a, b))

    def stateful(self, step, schema: str, by=None, begin: dict | None = None) -> Events:
        return self._with(state.stateful(self.df, self.order, step, schema, by, begin))

    def take(self, n: int) -> Events:
        return self._with(events.take(self.df, n, self.order))

    def context(self, match, before: int = 0, after: int = 0) -> Events:
        return self._with(events.context(self.df, match, self.order, before, after))

    def emit_each(self, items: str, base=None) -> Events:
        return self._with(events.emit_each(self.df, items, base))

    def span(self, kind: str, value, by=()) -> Events:
        """kind: count, time, field or idle."""
        f = {"count": lambda: spans.count_spans(self.df, self.order, value, by), "time": lambda: spans.time_spans(self.df, self.ts, self.order, value, by), "field": lambda: spans.field_spans(self.df, value, self.order, by), "idle": lambda: spans.idle_spans(self.df, self.ts, self.order, value, by)}
        return self._with(f[kind]())

    def close(self, *aggregates: Column, by=()) -> DataFrame:
        return spans.close_spans(self.df, *aggregates, ts=self.ts, order=self.order, by=by)

    def freq(self, field: str) -> DataFrame:
        return metrics.freq(self.df, field)

    def describe(self, field: str, exact: bool = False) -> DataFrame:
        return self.df.agg(*metrics.stats(field, exact=exact))

    def card(self, field: str, error: float = 0.01) -> DataFrame:
        return self.df.agg(metrics.cardinality(field, error).alias("cardinality"))

    def templates(self, field: str) -> DataFrame:
        return drain.templates(self.df, field)

    def write(self, path: str, format: str = "json", keys=None) -> None:
        outputs.write(self.df, path, format, keys)


def include(path: str) -> list:
    """Steps from a file, to stand before others: [["filter", [...]], ...]."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_config(text: str) -> tuple[dict[str, list], dict[str, str]]:
    """(saved steps, defaults) of a configuration: [aliases] name = steps as JSON; [defaults] option = value."""
    import configparser

    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str
    parser.read_string(text)
    saved = {k: json.loads(v) for k, v in parser["aliases"].items()} if parser.has_section("aliases") else {}
    return saved, dict(parser["defaults"]) if parser.has_section("defaults") else {}


def run_spec(source: Events, spec: str | list, saved: dict[str, list] | None = None, seen: tuple = ()) -> Events | DataFrame:
    """Runs steps written as JSON: [[method, [args], {options}], ...]; {"use": name} takes a saved list of steps in, {"include": file} a file's."""
    out = source
    for step in json.loads(spec) if isinstance(spec, str) else spec:
        if isinstance(step, dict) and "include" in step:
            out = run_spec(out, include(step["include"]), saved, seen)
        elif isinstance(step, dict):
            name = step["use"]
            if name in seen:
                raise ValueError(f"saved steps use themselves: {' > '.join((*seen, name))}")
            out = run_spec(out, (saved or {})[name], saved, (*seen, name))
        else:
            method, args, options = step[0], step[1] if len(step) > 1 else [], step[2] if len(step) > 2 else {}
            out = getattr(out, method)(*args, **options)
    return out
