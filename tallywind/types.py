"""The six column types and how Spark represents them."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from typing import Any

from pyspark.sql import types as T

from .errors import TypeMismatch

SPARK = {
    "float64": T.DoubleType(),
    "int64": T.LongType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
    "datetime": T.TimestampType(),
    "categorical": T.StringType(),
}
NUMERIC = ("float64", "int64")
ORDERED = ("float64", "int64", "datetime", "string", "bool", "categorical")


def dtype_of(field: T.StructField) -> str:
    """The type's name: integers are int64, floats and decimals float64, timestamps datetime; marked strings categorical."""
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return "categorical" if (field.metadata or {}).get("categorical") else "string"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return kind.simpleString()


def infer(values: Sequence[Any]) -> str:
    """The type of a list of values: whole numbers int64, a fraction or NaN float64; empty or all absent string.

    Mixing numbers, strings and booleans is an error; datetime and categorical
    are never inferred.
    """
    families = {"bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else type(v).__name__ for v in values if v is not None}
    if not families:
        return "string"
    if len(families) > 1:
        raise TypeMismatch(f"values of several types: {sorted(families)}")
    family = families.pop()
    if family == "number":
        return "float64" if any(isinstance(v, float) and (math.isnan(v) or v != int(v) if not math.isinf(v) else True) for v in values if v is not None) else "int64"
    if family in ("bool", "string"):
        return family
    raise TypeMismatch(f"no type for values of {family}")


def convert(value: Any, dtype: str) -> Any:
    """The value as the type holds it; no narrowing, parsing or truthiness."""
    if value is None:
        return None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if dtype == "float64" and number:
        return float(value)
    if dtype == "int64" and number and value == int(value):
        return int(value)
    if dtype == "bool" and isinstance(value, bool):
        return value
    if dtype in ("string", "categorical") and isinstance(value, str):
        return value
    if dtype == "datetime" and number and value == int(value):
        return datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(milliseconds=int(value))
    raise TypeMismatch(f"{value!r} is no {dtype}")
