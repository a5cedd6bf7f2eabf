"""Conversions between the column types; what cannot be converted is NULL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..types import SPARK
from .dates import iso, parse_moment_ms

_WHOLE = r"^[ \t\n\x0b\f\r]*[+-]?[0-9]+\z"
_HEX = r"^[ \t\n\x0b\f\r]*([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]{1,5}))?\z"
_REAL = r"^[ \t\n\x0b\f\r]*[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"


def float_text(x: Column) -> Column:
    """A double as text of 17 significant digits, the shortest form of C's %.17g; `nan`, `inf`, `-inf`."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(["%.17g" % v for v in s.to_numpy(dtype=float)], dtype=object)

    return F.when(x.isNotNull(), text(F.coalesce(x, F.lit(0.0))))


def to_int(s: Column) -> Column:
    """Strict decimal text as int64; blanks before it, a sign and zeros in front are fine."""
    return F.when(s.rlike(_WHOLE), F.btrim(s, F.lit(" \t\n\x0b\x0c\r")).try_cast("bigint"))


def to_float(s: Column, hexadecimal: bool = False) -> Column:
    """Strict text as a double; beyond its range is NULL. On request hexadecimal numbers (0x1.8p3) of up to 16 digits are read too."""
    x = F.btrim(s, F.lit(" \t\n\x0b\x0c\r")).try_cast("double")
    usual = F.when(s.rlike(_REAL) & ((F.abs(x) != float("inf")) | F.lower(s).contains("inf") | F.isnan(x)), x)
    return F.when(s.rlike(_HEX), _from_hex(s)).otherwise(usual) if hexadecimal else usual


def _from_hex(s: Column) -> Column:
    part = lambda i: F.regexp_extract(s, _HEX, i)
    digits = F.concat(part(2), part(3))
    power = F.coalesce(part(4).try_cast("int"), F.lit(0)) - 4 * F.length(part(3))
    whole = F.conv(digits, 16, 10).cast("double")
    half = F.floor(power / 2).cast("int")  # two steps: a power may leave the range where the product does not
    x = whole * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)
    return F.when((F.length(digits) <= 16) & (F.abs(x) < float("inf")), F.when(part(1) == "-", -x).otherwise(x))


def cast(x: Column, source: str, target: str, dayfirst: bool = False) -> Column:
    """x of type `source` as type `target`."""
    if target not in SPARK:
        raise TypeMismatch(f"no type {target!r}")
    if source == "categorical" and target not in ("categorical", "string"):
        return cast(x, "string", target, dayfirst)
    if target == "categorical":
        return x if source in ("string", "categorical") else cast(x, source, "string")
    if source == target or (source == "categorical" and target == "string"):
        return x
    if {source, target} == {"datetime", "bool"}:
        raise TypeMismatch(f"no conversion from {source} to {target}")
    finite = F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), x) if source == "float64" else x
    rules = {
        ("int64", "float64"): lambda: x.cast("double"),
        ("float64", "int64"): lambda: x.try_cast("bigint"),
        ("int64", "datetime"): lambda: F.timestamp_millis(x),
        ("float64", "datetime"): lambda: F.timestamp_millis(finite.try_cast("bigint")),
        ("datetime", "int64"): lambda: F.unix_millis(x),
        ("datetime", "float64"): lambda: F.unix_millis(x).cast("double"),
        ("int64", "string"): lambda: x.cast("string"),
        ("float64", "string"): lambda: float_text(x),
        ("datetime", "string"): lambda: iso(x),
        ("string", "int64"): lambda: to_int(x),
        ("string", "float64"): lambda: to_float(x),
        ("string", "datetime"): lambda: F.timestamp_millis(parse_moment_ms(x, dayfirst)),
        ("string", "bool"): lambda: F.when(x == "true", True).when(x == "false", False),
        ("bool", "int64"): lambda: x.cast("bigint"),
        ("bool", "float64"): lambda: x.cast("double"),
        ("bool", "string"): lambda: x.cast("string"),
        ("int64", "bool"): lambda: _zero_one(x),
        ("float64", "bool"): lambda: _zero_one(x),
    }
    return rules[source, target]()


def _zero_one(x: Column) -> Column:
    wrong = F.raise_error(F.concat(F.lit("neither 0 nor 1: "), x.cast("string"))).cast("boolean")
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(x == 0, False).when(x == 1, True).otherwise(wrong)
