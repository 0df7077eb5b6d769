"""Steps with a memory: a map that a step reads and changes from event to event, in the order of arrival.

What a window function can say (running sums, first of a key, last values) is better said with one. A step that needs
more runs here: rows are dealt by key, sorted by their order, and streamed through the step, so a task holds one key's
map and a batch of rows, never a key's rows. A key is the unit of work; without one the stream is a single task's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class State(dict):
    """The map. Reading a key that isn't there gives None; a None counts as not there."""

    def __missing__(self, key):
        return None

    def get(self, key, default=None):
        value = self[key]
        return default if value is None else value

    def contains(self, key) -> bool:
        return key in self

    def set(self, key, value) -> None:
        self[key] = value

    def remove(self, key):
        return self.pop(key, None)

    def is_empty(self) -> bool:
        return not self

    def mixin(self, other: dict) -> None:
        """The other's entries over those that are there."""
        self.update(other)

    def fill_with(self, other: dict) -> None:
        """The other's entries for keys that aren't there."""
        for k, v in other.items():
            self.setdefault(k, v)

    def to_map(self) -> dict:
        return dict(self)

    def __add__(self, other: dict) -> State:
        return State({**self, **other})

    def __iadd__(self, other: dict) -> State:
        self.update(other)
        return self


#: A step: (state, event as a dict) -> the event to emit, several of them, or None.
Step = Callable[[State, dict], dict | list | None]


def _emitted(found) -> list[dict]:
    return [] if found is None else [found] if isinstance(found, dict) else list(found)


def stateful(df: DataFrame, order: str, step: Step, schema: str, by: list[str] | None = None, begin: dict | None = None) -> DataFrame:
    """The events that step emits, of the given schema. Each key of by starts with the entries of begin; null is a key too.

    Rows of a key come in the order of the column order, so the result doesn't depend on partitions. An empty input
    emits nothing.
    """
    from pyspark.sql.types import _parse_datatype_string

    keys = by or []
    spread = df.repartition(*[F.col(k) for k in keys]) if keys else df.coalesce(1)
    rows = spread.sortWithinPartitions(*keys, order)
    names = _parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = State(begin or {}), None
        for batch in batches:
            out = []
            for event in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                key = tuple(event[k] for k in keys)
                if key != at:
                    state, at = State(begin or {}), key
                out += _emitted(step(state, event))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key by its order, the commonest use of a state: one partial aggregate, no state."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__first"))
    return best.select(*[F.col(k) if k in keys else F.col(f"__first.`{k}`") for k in df.columns])
