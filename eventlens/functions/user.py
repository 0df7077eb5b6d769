"""Functions of users: scalars over Arrow batches, and aggregates that merge partial states."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(f: Callable, kind: str, nulls: bool = False) -> Callable[..., Column]:
    """f over single values as a function of columns; it sees no null, unless it asks for them. Exceptions are the job's."""

    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if not nulls and any(x is None or x is pd.NA or x != x for x in r) else f(*r) for r in rows], dtype=object)

    def over(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return run(first, *rest)

    over.__annotations__ = {}
    made = F.pandas_udf(over, kind, F.PandasUDFType.SCALAR)
    return lambda *columns: made(*[c if isinstance(c, Column) else F.col(c) for c in columns])


def registered(spark, name: str, f: Callable, kind: str) -> None:
    """f under a name in SQL texts: filters and transforms written as text may call it."""
    spark.udf.register(name, f, kind)


class Aggregate:
    """zero() -> state, update(state, value) -> state, merge(state, state) -> state, finish(state) -> result."""

    def __init__(self, zero: Callable, update: Callable, merge: Callable, finish: Callable, kind: str):
        self.zero, self.update, self.merge, self.finish, self.kind = zero, update, merge, finish, kind


def aggregate(df: DataFrame, by: list[str], value: str, how: Aggregate, name: str = "result") -> DataFrame:
    """One row a group with the aggregate's result over the values that aren't null; a group without any has zero's.

    Each task folds its rows into one state a group, and only states are shuffled: at most one for each group and task,
    so a group of any size is merged from few rows.
    """
    keys = [f"`{k}`" for k in by]
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)

    def partial(batches):
        states: dict = {}
        for b in batches:
            for *key, v in b.itertuples(index=False, name=None):
                key = tuple(None if k is None or k != k else k for k in key)
                state = states[key] if key in states else how.zero()
                states[key] = state if v is None or v != v else how.update(state, v)
            if len(states) > 100_000:
                yield out(states)
                states = {}
        yield out(states)

    def out(states):
        return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*by, "state"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        state = how.zero()
        for s in pdf["state"]:
            state = how.merge(state, pickle.loads(s))
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in by], how.finish(state))], columns=[*by, name])

    sep = ", " if by else ""
    states = df.select(*keys, F.col(value)).mapInPandas(partial, f"{head}{sep}state binary")
    return states.groupBy(*keys).applyInPandas(merged, f"{head}{sep}`{name}` {how.kind}")
