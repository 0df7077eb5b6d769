"""Declared types of fields: int, float, bool, string; values that don't fit are null, or an error when strict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"


def typed(value: Column, kind: str | None, strict: bool = False) -> Column:
    if kind in (None, "string"):
        return value
    low = F.lower(F.trim(value))
    if kind == "int":
        out = F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast("long"))
    elif kind == "float":
        out = F.when(value.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), value.try_cast("double"))
    elif kind == "bool":
        out = F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)
    else:
        raise ValueError(f"unknown type: {kind}")
    if strict:
        out = F.when(value.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit(f"not {kind}: "), value))).otherwise(out)
    return out


def is_json_number(value: Column) -> Column:
    return value.rlike(JSON_NUMBER)
