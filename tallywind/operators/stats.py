"""Reductions of columns: aggregate expressions with the library's rules for absence and NaN, and what needs two passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import group_quantiles

NAN = float("nan")
_TRACKED = 128


def _num(x: Column, kind: str) -> Column:
    return x.cast("double") if kind == "float64" else x


def total(x: Column, kind: str = "float64", min_count: int = 0) -> Column:
    """Sum of the present values; 0 without any; NULL below min_count or where NaN is involved."""
    s = F.coalesce(F.sum(x), F.lit(0).cast("long") if kind == "int64" else F.lit(0.0))
    if kind == "float64":
        s = F.when(~F.isnan(s), s)
    return F.when(F.count(x) >= min_count, s) if min_count else s


def mean(x: Column) -> Column:
    m = F.avg(x)
    return F.when(~F.isnan(m), m)


def minimum(x: Column, kind: str = "float64") -> Column:
    """Least value; NaN passed over."""
    return F.min(F.when(~F.isnan(x), x)) if kind == "float64" else F.min(x)


def maximum(x: Column, kind: str = "float64") -> Column:
    return F.max(F.when(~F.isnan(x), x)) if kind == "float64" else F.max(x)


def var(x: Column) -> Column:
    """Sample variance; NULL below two values or with NaN."""
    v = F.var_samp(x)
    return F.when(~F.isnan(v), v)


def std(x: Column) -> Column:
    v = F.stddev_samp(x)
    return F.when(~F.isnan(v), v)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(x: Column, q: float) -> Column:
    """Exact, with linear interpolation: an aggregate that holds a group's distinct values. Groups and Series use operators.quantiles instead."""
    if not 0 <= q <= 1:
        raise ValueError("q lies between 0 and 1")
    return F.percentile(x, F.lit(float(q)))


def prod(x: Column, kind: str = "float64") -> Column:
    """Product of the present values; without any NULL for doubles, 0 for whole numbers, which raise beyond 64 bits.

    The distinct factors beyond -1..1 are counted in a sketch of 128 places,
    which is exact up to 96 of them; a product that fits has at most 20. So a
    group of any size, with a zero or a product that does not fit, costs no more.
    """
    if kind == "float64":
        return F.product(x)
    size = F.abs(x.cast("decimal(20,0)"))  # the least 64-bit number has no opposite
    one = F.lit(1).cast("long")
    factors = F.filter(F.call_function("approx_top_k", F.when(size > 1, size.cast("string")).otherwise("1"), F.lit(_TRACKED), F.lit(_TRACKED)), lambda f: f["item"] != "1")
    bits = F.coalesce(F.sum(F.log2(F.when(size > 1, size.cast("double")))), F.lit(0.0))
    fits = (bits < 63.5) & (F.size(factors) <= 64)
    exact = F.aggregate(factors, F.lit(1).cast("decimal(38,0)"), lambda a, f: F.aggregate(F.array_repeat(f["item"].cast("decimal(20,0)"), f["count"].cast("int")), a, lambda b, v: (b * v).cast("decimal(38,0)")))
    sign = F.when(F.count_if(x < 0) % 2 == 1, -one).otherwise(one)
    wrong = F.raise_error(F.lit("the product is beyond 64 bits")).cast("long")
    whole = F.when(fits, (exact * sign).cast("long")).otherwise(wrong)
    return F.when((F.count(x) == 0) | (F.count_if(x == 0) > 0), F.lit(0).cast("long")).otherwise(whole)


def nunique(x: Column) -> Column:
    return F.count_distinct(x)


def first(x: Column, order: Column) -> Column:
    """First present value in row order."""
    return F.min_by(x, F.when(x.isNotNull(), order))


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order))


def skew(x: Column) -> Column:
    """Bias-corrected; NULL below three values, 0 for constant ones."""
    n = F.count(x).cast("double")
    g = F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(g)


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess; NULL below four values, 0 for constant ones."""
    n = F.count(x).cast("double")
    g = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, F.lit(None).cast("double")).when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(g)


def sem(x: Column) -> Column:
    """Standard error of the mean; NULL below two values."""
    return F.when(F.count(x) >= 2, F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def covariance(x: Column, y: Column) -> Column:
    """Over complete pairs; NaN below two."""
    return F.coalesce(F.covar_samp(x.cast("double"), y.cast("double")), F.lit(NAN))


def correlation(x: Column, y: Column) -> Column:
    """Over complete pairs; NaN below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.coalesce(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)), F.lit(NAN))


def dot(x: Column, y: Column) -> Column:
    """Sum of products; NULL if any pair is incomplete."""
    return F.when(F.count_if(x.isNull() | y.isNull()) == 0, F.coalesce(F.sum(x.cast("double") * y.cast("double")), F.lit(0.0)))


def mad(df: DataFrame, column: str) -> DataFrame:
    """One row: the median absolute deviation from the median (`mad`); without values none. Exact, whatever the number of rows."""
    x = df.select(F.col(column).alias("x"))
    middle = group_quantiles(x, [], "x").first()  # one number
    if middle is None:
        return df.sparkSession.createDataFrame([(None,)], "mad double")
    return group_quantiles(x.select(F.abs(F.col("x") - F.lit(middle["quantile"])).alias("x")), [], "x").select(F.col("quantile").alias("mad"))


def mode(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row: the most frequent present value (`mode`); of equally frequent ones the first to appear."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return counted.agg(F.max_by(column, F.struct(F.col("n"), -F.col("o"))).alias("mode"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Present values and how often they occur (`value`, `count`), most frequent first, ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def unique(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values, one NULL included, in the order of their first appearance."""
    return df.groupBy(column).agg(F.min(order).alias("__o")).orderBy("__o").select(column)


def matrix(df: DataFrame, columns: Sequence[str], kind: str = "corr") -> DataFrame:
    """Correlation or covariance of all pairs of columns: `__index__` and a column each; one aggregate over the table."""
    f = {"corr": correlation, "cov": covariance}[kind]
    columns = list(columns)
    pairs = [f(F.col(a), F.col(b)).alias(f"__{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]
    one = df.agg(*pairs)
    rows = F.array(*[F.struct(F.lit(a).alias("__index__"), *[F.col(f"__{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(columns)]) for i, a in enumerate(columns)])
    return one.select(F.inline(rows))
