"""Joins, unions, duplicates, reshaping and comparison of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TypeMismatch, UnknownName
from ..types import dtype_of
from .groups import aggregate, checked_key

_HOW = {"inner": "inner", "left": "left", "right": "left", "outer": "full"}


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: dtype_of(f) for f in df.schema.fields}


def _named(df: DataFrame, names: Sequence[str]) -> None:
    for n in names:
        if n not in df.columns:
            raise UnknownName(n, df.columns)


def key_names(on: str | Sequence[str] | None, left_on: Sequence[str] | None, right_on: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """A name; a pair (left name, right name); or left_on and right_on for keys of several columns."""
    if on is None:
        left, right = list(left_on or ()), list(right_on or ())
    elif isinstance(on, str):
        left, right = [on], [on]
    else:
        left, right = [on[0]], [on[1]]
    if not left or len(left) != len(right):
        raise ValueError("keys: on, or left_on and right_on of one length")
    return left, right


def join(
    a: DataFrame,
    b: DataFrame,
    on: str | Sequence[str] | None = None,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_left", "_right"),
    left_on: Sequence[str] | None = None,
    right_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join: inner, left, right or outer.

    Keys of different types never match; an absent key raises when the query
    runs; NaN joins NaN. Columns: those of a, then those of b without its keys;
    equal names get the suffixes; the key has a's name, and b's value where a has
    no row. A right join is the left join of b with a: b's columns come first.
    Spark picks the join strategy from sizes and handles skewed keys at run time.
    """
    if how not in _HOW:
        raise ValueError(f"how: {how!r}")
    left, right = key_names(on, left_on, right_on)
    if how == "right":
        return join(b, a, None, "left", (suffixes[1], suffixes[0]), right, left)
    _named(a, left)
    _named(b, right)
    ka, kb = kinds(a), kinds(b)
    typed = all(ka[x] == kb[y] for x, y in zip(left, right))
    keyed = {*left, *right}
    mine, theirs = [c for c in a.columns if c not in left], [c for c in b.columns if c not in keyed]
    both = set(mine) & set(theirs)
    x = a.select(*[checked_key(F.col(k), k).alias(f"__k{i}") for i, k in enumerate(left)], *[F.col(c).alias(f"__a{i}") for i, c in enumerate(mine)], F.lit(True).alias("__in_a"))
    y = b.select(*[checked_key(F.col(k), k).alias(f"__j{i}") for i, k in enumerate(right)], *[F.col(c).alias(f"__b{i}") for i, c in enumerate(theirs)])
    cond = F.lit(typed)
    for i in range(len(left)):
        if typed:
            cond = cond & (F.col(f"__k{i}") == F.col(f"__j{i}"))
    z = x.join(y, cond, _HOW[how])
    key = {k: F.when(F.col("__in_a"), F.col(f"__k{i}")).otherwise(F.col(f"__j{i}")) if how == "outer" and typed else F.col(f"__k{i}") for i, k in enumerate(left)}
    at = {c: i for i, c in enumerate(mine)}
    out = [key[c].alias(c) if c in key else F.col(f"__a{at[c]}").alias(c + suffixes[0] if c in both else c) for c in a.columns]
    out += [F.col(f"__b{i}").alias(c + suffixes[1] if c in both else c) for i, c in enumerate(theirs)]
    return z.select(*out)


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of all rows, by column name; names and types must agree, the first table's order holds."""
    first = tables[0]
    for t in tables[1:]:
        if kinds(t) != kinds(first):
            raise TypeMismatch(f"columns differ: {kinds(first)} and {kinds(t)}")
    out = first
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _subset(df: DataFrame, order: Sequence[str], subset: Sequence[str] | None, keep: str) -> list[str]:
    if keep not in ("first", "last", "none"):
        raise ValueError(f"keep: {keep!r}")
    names = list(subset) if subset else [c for c in df.columns if c not in order]
    _named(df, names)
    return names


def duplicated(df: DataFrame, order: Sequence[str], subset: Sequence[str] | None = None, keep: str = "first", out: str = "duplicated") -> DataFrame:
    """df with whether a row repeats another (absent values are equal); of equal rows the first, the last or none is spared.

    `order` must tell rows apart. Counted map-side and joined back: a value that
    a third of the rows share is no task's burden.
    """
    names = _subset(df, order, subset, keep)
    place = F.struct(*order)
    spared = {"first": F.min(place), "last": F.max(place), "none": F.min(place)}[keep]
    each = df.groupBy(*[F.col(n).alias(f"__{n}") for n in names]).agg(spared.alias("__spared"), F.count("*").alias("__n"))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    again = F.col("__n") > 1 if keep == "none" else place != F.col("__spared")
    return df.join(each, on).select(*df.columns, again.alias(out))


def drop_duplicates(df: DataFrame, order: Sequence[str], subset: Sequence[str] | None = None, keep: str = "first") -> DataFrame:
    """df without the repeated rows: one aggregate, map-side combined."""
    names = _subset(df, order, subset, keep)
    place, row = F.struct(*order), F.struct(*df.columns)
    one = F.max_by(row, place) if keep == "last" else F.min_by(row, place)
    each = df.groupBy(*[F.col(n).alias(f"__{n}") for n in names]).agg(one.alias("__row"), F.count("*").alias("__n"))
    return (each.where("__n = 1") if keep == "none" else each).select("__row.*")


def _texts(df: DataFrame, column: str) -> list[str]:
    """The new columns of a pivot, in the order of their texts. Their number is the width of the result table."""
    return [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().orderBy(F.col(column).cast("string")).collect()]


def _pivot(df: DataFrame, index: str, columns: str, value: Column, values: Sequence[str] | None) -> DataFrame:
    rows = df.withColumns({index: checked_key(F.col(index), index), columns: checked_key(F.col(columns), columns).cast("string")})
    return rows.groupBy(index).pivot(columns, list(values) if values is not None else _texts(df, columns)).agg(value)


def pivot(df: DataFrame, index: str, columns: str, values: str, order: Sequence[str], new: Sequence[str] | None = None) -> DataFrame:
    """One row per index value, one column per text of `columns`; of several rows the last wins, even if its value is absent."""
    last = F.max_by(F.col(values), F.struct(*order))
    return _pivot(df, index, columns, last, new)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, how: str = "sum", order: Sequence[str] = (), new: Sequence[str] | None = None) -> DataFrame:
    """As pivot, with an aggregate: sum, mean, min, max, count, first or last; results have the aggregate's own type."""
    if how == "count":
        return _pivot(df, index, columns, F.count(F.lit(1)), new)
    if how not in ("sum", "mean", "min", "max", "first", "last"):
        raise ValueError(f"how: {how!r}")
    key = F.struct(*order) if order else None
    return _pivot(df, index, columns, aggregate(how, F.col(values), kinds(df)[values], key), new)


def unstack(df: DataFrame, index: str, column: str, values: str, order: Sequence[str], new: Sequence[str] | None = None) -> DataFrame:
    return pivot_table(df, index, column, values, "first", order, new)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None, variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per row and value column: ids, `variable` (its name), `value`; values of several types become texts."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    _named(df, [*ids, *values])
    types = {kinds(df)[v] for v in values}
    if types == {"float64", "int64"} or len(types) > 1:
        df = df.withColumns({v: F.col(v).cast("string") for v in values})
    return df.unpivot(list(ids), values, variable, value)


def stack(df: DataFrame, values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    return melt(df, [c for c in df.columns if c not in values], values, variable, value)


def explode(df: DataFrame, column: str) -> DataFrame:
    """A row per element of the array column; an empty or absent array gives one row with NULL."""
    return df.withColumn(column, F.explode_outer(column))


def compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The cells in which two tables differ, paired by `key`: key, column, self, other (texts). NaN equals NaN, NULL equals NULL."""
    names = [c for c in a.columns if c != key]
    x = a.select(F.col(key), F.struct(*names).alias("__x"))
    y = b.select(F.col(key), F.struct(*names).alias("__y"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__x.{c}").cast("string").alias("self"), F.col(f"__y.{c}").cast("string").alias("other"), F.col(f"__x.{c}").eqNullSafe(F.col(f"__y.{c}")).alias("same")) for c in names])
    return x.join(y, key, "full").select(key, F.inline(cells)).where(~F.col("same")).drop("same")


def equals(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Same columns in the same order, same types, same cells; NaN equals NaN and NULL equals NULL."""
    if a.columns != b.columns or kinds(a) != kinds(b):
        return False
    names = [c for c in a.columns if c != key]
    x = a.select(F.col(key).alias("__k"), F.struct(*names).alias("x"))
    y = b.select(F.col(key).alias("__j"), F.struct(*names).alias("y"))
    z = x.join(y, F.col("__k") == F.col("__j"), "full")
    bad = z.where(F.col("__k").isNull() | F.col("__j").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return bad.limit(1).count() == 0


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    _named(df, list(names))
    after = [names.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns of one name")
    return df.toDF(*after)
