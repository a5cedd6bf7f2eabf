"""Grouping with checked keys: aggregates per group and broadcast back to rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MissingKey, TypeMismatch
from ..session import materialize
from ..types import NUMERIC, dtype_of
from . import stats
from .quantiles import group_quantiles

BUILTIN = ("sum", "mean", "min", "max", "std", "var", "median", "first", "last", "prod", "nunique", "count")


def checked_key(key: Column, name: str) -> Column:
    """The key, raising when it is absent, as part of the plan: no extra pass."""
    return F.when(key.isNull(), F.raise_error(F.lit(f"absent value in key {name!r}"))).otherwise(key)


def require_keys(df: DataFrame, names: Sequence[str]) -> None:
    """Raise MissingKey if a key is absent anywhere: one aggregate over the key columns."""
    row = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    bad = [n for n in names if row[n]]
    if bad:
        raise MissingKey(f"absent values in {bad}")


def aggregate(name: str, x: Column, kind: str, order: Column | None) -> Column:
    """A built-in aggregate by name."""
    if name in ("first", "last"):
        if order is None:
            raise ValueError("first and last need an order")
        return getattr(stats, name)(x, order)
    rules = {
        "sum": lambda: stats.total(x, kind),
        "mean": lambda: F.avg(x),
        "min": lambda: stats.minimum(x, kind),
        "max": lambda: stats.maximum(x, kind),
        "std": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "median": lambda: stats.median(x),
        "prod": lambda: stats.prod(x, kind),
        "nunique": lambda: stats.nunique(x),
        "count": lambda: F.count(F.lit(1)),
    }
    if name not in rules:
        raise ValueError(f"no aggregate {name!r}")
    return rules[name]()


class Groups:
    """The groups of a table by key columns. Results have a row per group; order them by the keys where order matters.

    An absent key raises when the query runs. NaN keys are one group, after all
    numbers. Aggregates pass over absent values; without any, sum is 0 and the
    others are NULL.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.kinds = {f.name: dtype_of(f) for f in df.schema.fields}
        self.df = df.withColumns({k: checked_key(F.col(k), k) for k in self.keys})
        self.line = list(order)
        self.order = (F.struct(*order) if len(order) > 1 else F.col(order[0])) if order else None

    def _columns(self, columns: Sequence[str]) -> list[str]:
        named = list(columns) or [c for c, k in self.kinds.items() if k in NUMERIC and c not in self.keys]
        wrong = [c for c in named if c not in self.kinds]
        if wrong:
            raise TypeMismatch(f"no columns {wrong}")
        return named

    def _quantiles(self, base: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
        """base (a row per group) with exact quantiles beside it, NULL for groups without values: {name: (column, q)}.

        Bins are counted map-side combined (operators.quantiles): no task holds a group.
        """
        columns = list(dict.fromkeys(c for c, _ in wanted.values()))
        stored = materialize(self.df.select(*[F.col(k).alias(f"__{k}") for k in self.keys], *[F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)]), "grouped")
        out = base
        for i, c in enumerate(columns):
            names = {n: q for n, (of, q) in wanted.items() if of == c}
            found = group_quantiles(stored, [f"__{k}" for k in self.keys], f"__v{i}", list(names.values()))
            on = F.lit(True)
            for k in self.keys:
                on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
            out = out.join(found.drop("n").withColumnsRenamed({f"quantile_{j}": n for j, n in enumerate(names)}), on, "left").drop(*[f"__{k}" for k in self.keys])
        return out

    def _each(self, name: str, columns: Sequence[str]) -> DataFrame:
        if name == "median":
            return self.quantile(0.5, *columns)
        named = self._columns(columns)
        return self.df.groupBy(*self.keys).agg(*[aggregate(name, F.col(c), self.kinds[c], self.order).alias(c) for c in named])

    def sum(self, *columns: str) -> DataFrame:
        return self._each("sum", columns)

    def mean(self, *columns: str) -> DataFrame:
        return self._each("mean", columns)

    def min(self, *columns: str) -> DataFrame:
        return self._each("min", columns)

    def max(self, *columns: str) -> DataFrame:
        return self._each("max", columns)

    def std(self, *columns: str) -> DataFrame:
        return self._each("std", columns)

    def var(self, *columns: str) -> DataFrame:
        return self._each("var", columns)

    def median(self, *columns: str) -> DataFrame:
        return self._each("median", columns)

    def prod(self, *columns: str) -> DataFrame:
        return self._each("prod", columns)

    def nunique(self, *columns: str) -> DataFrame:
        return self._each("nunique", columns)

    def first(self, *columns: str) -> DataFrame:
        return self._each("first", columns)

    def last(self, *columns: str) -> DataFrame:
        return self._each("last", columns)

    def quantile(self, q: float, *columns: str) -> DataFrame:
        if not 0 <= q <= 1:
            raise ValueError("q lies between 0 and 1")
        named = self._columns(columns)
        return self._quantiles(self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n"), {c: (c, q) for c in named}).select(*self.keys, *named)

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("count"))

    def agg(self, spec: Mapping[str, str | Sequence[str]]) -> DataFrame:
        """{column: aggregate or aggregates}; results are doubles named column_aggregate. A function of a Column is called and named as the column."""
        out, names, medians = [], [], {}
        for c, fs in spec.items():
            for f in [fs] if isinstance(fs, str) or callable(fs) else fs:
                names.append(c if callable(f) else f"{c}_{f}")
                if callable(f):
                    out.append(f(F.col(c)).alias(c))
                elif f == "median":
                    medians[names[-1]] = (c, 0.5)
                else:
                    out.append(aggregate(f, F.col(c), self.kinds[c], self.order).cast("double").alias(names[-1]))
        base = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"), *out)
        return (self._quantiles(base, medians) if medians else base).select(*self.keys, *names)

    def apply(self, column: str, function: Callable[[pd.Series], Any], returns: str = "double") -> DataFrame:
        """A Python aggregate (pandas Series to scalar) per group, named as the column; Arrow batches, one group at a time in memory."""

        def one(values: pd.Series) -> float:
            return function(values)

        one.__annotations__ = {"values": pd.Series, "return": float}
        return self.df.groupBy(*self.keys).agg(F.pandas_udf(one, returns)(F.col(column)).alias(column))

    def transform(self, name: str | Callable[[pd.Series], Any], column: str, out: str | None = None, returns: str = "double") -> DataFrame:
        """Every row with its group's aggregate of the column, a double.

        Aggregated map-side and joined back, so that no task holds a group. A
        function gets a group's values as a pandas Series, in row order where
        the groups have one, and returns one value for all of them or one for
        each: it needs its group whole, in one task's memory. NULLs are None
        or NaN there.
        """
        if callable(name):
            return self._apply_rows(name, column, out or column, returns)
        allowed = ("sum", "mean", "min", "max", "std", "var", "median", "prod", "first", "last")
        if name not in allowed:
            raise ValueError(f"no transform {name!r}")
        x = F.col(column)
        if name == "median":
            each = self.quantile(0.5, column)
            each = each.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col(column).alias("__value"))
        else:
            value = F.product(x) if name == "prod" else aggregate(name, x, self.kinds[column], self.order)
            each = self.df.groupBy(*[F.col(k).alias(f"__{k}") for k in self.keys]).agg(value.cast("double").alias("__value"))
        on = F.lit(True)
        for k in self.keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        joined = self.df.join(each, on)
        name_out = out or column
        rest = [c for c in self.df.columns if c != name_out]
        columns = [F.col("__value").alias(name_out) if c == name_out else F.col(c) for c in self.df.columns] if name_out in self.df.columns else [*rest, F.col("__value").alias(name_out)]
        return joined.select(*columns)

    def _apply_rows(self, function: Callable[[pd.Series], Any], column: str, out: str, returns: str) -> DataFrame:
        names = self.df.columns
        rest = [c for c in names if c != out]
        types = dict(self.df.dtypes)
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in rest), f"`{out}` {returns}"])
        line = self.line

        def work(group: pd.DataFrame) -> pd.DataFrame:
            if line:
                group = group.sort_values(line, kind="stable").reset_index(drop=True)
            got = function(group[column])
            made = group[rest].copy()
            made[out] = list(got) if np.ndim(got) else [got] * len(group)
            return made

        done = self.df.groupBy(*self.keys).applyInPandas(work, schema)
        return done.select(*[c for c in names if c != out], out) if out not in names else done.select(*names)
