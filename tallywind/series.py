"""A typed column of an ordered frame, with its string, calendar and categorical accessors."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .display import LONG
from .errors import TypeMismatch
from .functions import casts, columns, dates, strings
from .operators import ordered, stats
from .operators.ordered import POS
from .operators.quantiles import group_quantiles
from .types import NUMERIC, ORDERED, SPARK, convert, infer

if TYPE_CHECKING:
    from .frame import Frame


class Series:
    """A column of a frame: an expression, evaluated when a result is asked for.

    Positions count from 1. NULL is absence, NaN a value. Changing methods
    return a new Series; the one they are called on stays as it is.
    """

    def __init__(self, frame: Frame, col: Column, dtype: str, name: str = "value") -> None:
        self.frame, self.col, self.dtype, self.name = frame, col, dtype, name

    # construction

    @classmethod
    def of(cls, values: Sequence[Any], dtype: str | None = None, name: str = "value") -> Series:
        from .frame import Frame

        kind = dtype or infer(values)
        return Frame.from_columns([(name, values, kind)])[name]

    @classmethod
    def full(cls, n: int, value: Any, dtype: str | None = None, name: str = "value") -> Series:
        return cls.of([value] * n, dtype, name)

    @classmethod
    def new(cls, n: int, dtype: str, name: str = "value") -> Series:
        """n absent values."""
        return cls.of([None] * n, dtype, name)

    @classmethod
    def categorical(cls, values: Sequence[str | None], name: str = "value") -> Series:
        return cls.of(values, "categorical", name)

    @classmethod
    def from_codes(cls, codes: Sequence[int | None], levels: Sequence[str], name: str = "value") -> Series:
        if len(set(levels)) < len(levels):
            raise ValueError("a level is named twice")
        if any(c is not None and not 1 <= c <= len(levels) for c in codes):
            raise ValueError("a code has no level")
        return cls.of([None if c is None else levels[c - 1] for c in codes], "categorical", name)

    # helpers

    @property
    def _float(self) -> bool:
        return self.dtype == "float64"

    def _need(self, *kinds: str) -> None:
        if self.dtype not in kinds:
            raise TypeMismatch(f"not for {self.dtype}")

    def _new(self, col: Column, dtype: str | None = None, name: str | None = None) -> Series:
        return Series(self.frame, col, dtype or self.dtype, name or self.name)

    def _kept(self, rows: Callable[[DataFrame], DataFrame] | None = None) -> Series:
        """This column as a frame of its own, after a change of its rows."""
        df = self.frame._df.select(*self.frame.place, self.col.alias(self.name))
        out = self.frame._next(rows(df) if rows else df, {self.name: self.dtype}, self.frame._dense and rows is None)
        return out[self.name]

    def _one(self, *aggregates: Column) -> Any:
        row = self.frame._df.agg(*aggregates).first()
        return row[0] if len(aggregates) == 1 else tuple(row)

    def _with(self, other: Any) -> Column:
        """The other operand as a column of this frame: aligned by position where it comes from another one."""
        if not isinstance(other, Series):
            return F.lit(other)
        return other.col if other.frame is self.frame else self.frame.align(other)

    def _window(self, reach: int, f: Callable[[Any, Column], Column], dtype: str | None = None, ahead: int = 0) -> Series:
        return self._new(self.frame.windowed(self.col, reach, f, ahead), dtype)

    def _running(self, how: Callable[[Column], ordered.Running], dtype: str | None = None, backwards: bool = False, x: Column | None = None) -> Series:
        return self._new(self.frame.running(self.col if x is None else x, how, backwards), dtype)

    # cells

    def __len__(self) -> int:
        return len(self.frame)

    size = property(__len__)

    def get(self, i: int) -> Any:
        """Value at position i; a datetime as epoch milliseconds."""
        n = len(self)
        if not 1 <= i <= n:
            raise IndexError(i)
        x = F.unix_millis(self.col) if self.dtype == "datetime" else self.col
        return self.frame.numbered().where(F.col(POS) == i).select(x).first()[0]

    get_raw = at = __getitem__ = get

    def is_null(self, i: int) -> bool:
        return self.get(i) is None

    def set(self, i: int, value: Any) -> Series:
        if not 1 <= i <= len(self):
            raise IndexError(i)
        self.frame.numbered()
        return self._new(F.when(F.col(POS) == i, F.lit(convert(value, self.dtype)).cast(SPARK[self.dtype])).otherwise(self.col))

    def set_null(self, i: int) -> Series:
        return self.set(i, None)

    def append(self, value: Any) -> Series:
        spark = self.frame._df.sparkSession
        n = len(self)
        self.frame.numbered()
        more = spark.createDataFrame([(n + 1, convert(value, self.dtype))], f"{POS} long, v {SPARK[self.dtype].simpleString()}").toDF(POS, self.name)
        return self._kept(lambda df: df.unionByName(more))

    def clone(self) -> Series:
        return self._new(self.col)

    def to_table(self, na: Any = None) -> list[Any]:
        """All values, in order, on the driver; a datetime as epoch milliseconds."""
        x = F.unix_millis(self.col) if self.dtype == "datetime" else self.col
        return [na if r[0] is None else r[0] for r in self.frame._df.orderBy(*self.frame._order()).select(x.alias("x")).collect()]

    def to_string(self, max_rows: int = LONG) -> str:
        return self.to_frame().to_string(max_rows)

    def to_markdown(self) -> str:
        return self.to_frame().to_markdown()

    def __repr__(self) -> str:
        return f"Series({self.name}: {self.dtype})\n{self.to_string()}"

    def to_frame(self) -> Frame:
        return self._kept().frame

    # rows

    def filter(self, mask: Series | Column) -> Series:
        """The values where the mask is true; an absent mask drops."""
        cond = self._with(mask) if isinstance(mask, Series) else mask
        return self.frame.where(cond).select_expression(self)

    def take(self, positions: Sequence[int]) -> Series:
        return self.to_frame().take(positions)[self.name]

    def head(self, n: int = 5) -> Series:
        return self.to_frame().head(n)[self.name]

    def tail(self, n: int = 5) -> Series:
        return self.to_frame().tail(n)[self.name]

    def view(self, start: int, length: int) -> Series:
        return self.to_frame().iloc(start, start + length - 1)[self.name]

    def sample(self, n: int = 1, seed: int = 0) -> Series:
        return self.to_frame().sample(n, seed)[self.name]

    def dropna(self) -> Series:
        return self._kept(lambda df: df.where(F.col(self.name).isNotNull()))

    def sort(self, asc: bool = True) -> Series:
        return self.to_frame().sort_by(self.name, asc)[self.name]

    def argsort(self, asc: bool = True) -> list[int] | None:
        """Positions in sorted order; None if a value is absent."""
        df = self.frame.numbered().select(POS, self.col.alias("x"))
        if df.where(F.col("x").isNull()).limit(1).count():
            return None
        return [r[0] for r in df.orderBy(F.col("x") if asc else F.col("x").desc(), POS).select(POS).collect()]

    def rep_each(self, n: int | Series) -> Series:
        times = self._with(n).cast("int")
        df = self.frame._df.select(*self.frame.place, F.posexplode(F.array_repeat(self.col, times)).alias("__i", self.name))
        place = [(F.col(n), asc) for n, asc in self.frame._keys or [(POS, True)]]
        return self.frame._ordered(df, [*place, "__i"], {self.name: self.dtype})[self.name]

    def map(self, f: Callable, dtype: str | None = None, name: str | None = None) -> Series:
        """f of every present value, in Arrow batches: a Python function of the value, or of the value and its position.

        Without a dtype the type is that of the first result that is not None
        (of the first present values, tried in turn on the driver); where there
        is none the result is all absent text. Absent values stay absent. To
        compute with Spark expressions, use map_column.
        """
        wants = [p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty] if not isinstance(f, type) else [None]
        both = len(wants) > 1
        x = self._plain  # moments are milliseconds
        if both:
            self.frame.numbered()
        if dtype is None:
            rows = self.frame._df.where(self.col.isNotNull()).orderBy(*self.frame._order()).select(x.alias("x"), (F.col(POS) if both else F.lit(0)).alias("i")).limit(100)
            results = (f(r["x"], r["i"]) if both else f(r["x"]) for r in rows.collect())
            first = next((v for v in results if v is not None), None)
            dtype = "string" if first is None else "float64" if isinstance(first, float) else infer([first])

        made_of = {"float64": pa.float64(), "int64": pa.int64(), "datetime": pa.int64(), "bool": pa.bool_()}.get(dtype, pa.string())

        def values(xs: pa.Array, at: pa.Array) -> pa.Array:
            return pa.array([None if v is None else f(v, i) if both else f(v) for v, i in zip(xs.to_pylist(), at.to_pylist())], made_of)

        apply = F.arrow_udf(values, "bigint" if dtype == "datetime" else SPARK[dtype].simpleString())
        made = apply(x, F.col(POS) if both else F.lit(0).cast("long"))
        return self._new(F.timestamp_millis(made) if dtype == "datetime" else made, dtype, name)

    def map_column(self, f: Callable[[Column], Column], dtype: str | None = None, name: str | None = None) -> Series:
        """A Spark expression of the column: stays in the JVM."""
        return self._new(f(self.col), dtype, name)

    # conversion and absence

    def astype(self, dtype: str, dayfirst: bool = False, name: str | None = None) -> Series:
        return self._new(casts.cast(self.col, self.dtype, dtype, dayfirst), dtype, name)

    def fillna(self, value: Any) -> Series:
        return self._new(columns.fillna(self.col, F.lit(convert(value, self.dtype))))

    def isna(self) -> Series:
        return self._new(self.col.isNull(), "bool")

    def notna(self) -> Series:
        return self._new(self.col.isNotNull(), "bool")

    def combine_first(self, other: Series) -> Series:
        if other.dtype != self.dtype:
            raise TypeMismatch(f"{self.dtype} and {other.dtype}")
        return self._new(F.coalesce(self.col, self._with(other)))

    def ffill(self) -> Series:
        return self._running(ordered.run_last)

    def bfill(self) -> Series:
        return self._running(ordered.run_next, backwards=True)

    # comparison and logic

    def _compare(self, f: Callable, k: Any) -> Series:
        self._need(*ORDERED)
        value = convert(k, self.dtype) if not (self.dtype == "int64" and isinstance(k, float)) else k
        return self._new(f(self.col, value, self._float), "bool")

    def gt(self, k: Any) -> Series:
        return self._compare(columns.gt, k)

    def ge(self, k: Any) -> Series:
        return self._compare(columns.ge, k)

    def lt(self, k: Any) -> Series:
        return self._compare(columns.lt, k)

    def le(self, k: Any) -> Series:
        return self._compare(columns.le, k)

    def eq(self, k: Any) -> Series:
        return self._compare(columns.eq, k)

    def ne(self, k: Any) -> Series:
        return self._compare(columns.ne, k)

    def between(self, lo: Any, hi: Any, inclusive: str = "both") -> Series:
        self._need(*ORDERED)
        return self._new(columns.between(self.col, convert(lo, self.dtype), convert(hi, self.dtype), inclusive, self._float), "bool")

    def isin(self, values: Sequence[Any]) -> Series:
        return self._new(columns.isin(self.col, [convert(v, self.dtype) for v in values]), "bool")

    def land(self, o: Series) -> Series:
        return self._new(columns.land(self.col, self._with(o)), "bool")

    def lor(self, o: Series) -> Series:
        return self._new(columns.lor(self.col, self._with(o)), "bool")

    def lxor(self, o: Series) -> Series:
        return self._new(columns.lxor(self.col, self._with(o)), "bool")

    def lnot(self) -> Series:
        return self._new(~self.col, "bool")

    __and__, __or__, __xor__, __invert__ = land, lor, lxor, lnot

    def count_true(self) -> int:
        return self._one(F.count_if(self.col))

    def any(self) -> bool:
        return bool(self._one(F.coalesce(F.bool_or(self.col), F.lit(False))))

    def all(self) -> bool:
        return bool(self._one(F.coalesce(F.bool_and(self.col), F.lit(True))))

    def where(self, cond: Series, other: Any = None) -> Series:
        return self._new(columns.where(self.col, self._with(cond), self._with(other)))

    def mask(self, cond: Series, other: Any = None) -> Series:
        return self._new(columns.mask(self.col, self._with(cond), self._with(other)))

    @staticmethod
    def ifelse(cond: Series, a: Any, b: Any) -> Series:
        kind = next((x.dtype for x in (a, b) if isinstance(x, Series)), None) or infer([a, b])
        return cond._new(columns.ifelse(cond.col, cond._with(a), cond._with(b)), kind)

    def is_unique(self) -> bool:
        return self._one(F.count(self.col) == F.count_distinct(self.col))

    def _monotonic(self, asc: bool, strict: bool) -> bool:
        step = self._window(1, lambda w, slot: F.struct(F.lag(slot).over(w).alias("p"), F.row_number().over(w).alias("i")), "struct")
        p, x = step.col["p"], self.col
        nan = (F.isnan(x) | F.isnan(p)) if self._float else F.lit(False)
        good = ((x > p) if strict else (x >= p)) if asc else ((x < p) if strict else (x <= p))
        return bool(self._one(F.coalesce(F.bool_and(F.when(x.isNull(), False).when(F.col(POS) == 1, True).otherwise(F.coalesce(good & ~nan, F.lit(False)))), F.lit(True))))

    def is_monotonic_increasing(self, strict: bool = False) -> bool:
        return self._monotonic(True, strict)

    def is_monotonic_decreasing(self, strict: bool = False) -> bool:
        return self._monotonic(False, strict)

    def first_valid_index(self) -> int | None:
        self.frame.numbered()
        return self._one(F.min(F.when(self.col.isNotNull(), F.col(POS))))

    def last_valid_index(self) -> int | None:
        self.frame.numbered()
        return self._one(F.max(F.when(self.col.isNotNull(), F.col(POS))))

    def searchsorted(self, value: Any, side: str = "left") -> int:
        if not self.is_monotonic_increasing():
            raise ValueError("not in ascending order")
        return 1 + self._one(F.count_if(self.col < F.lit(value) if side == "left" else self.col <= F.lit(value)))

    def duplicated(self, keep: str = "first") -> Series:
        return self.to_frame().duplicated(None, keep)

    def drop_duplicates(self, keep: str = "first") -> Series:
        return self.to_frame().drop_duplicates(None, keep)[self.name]

    def equals(self, other: Series) -> bool:
        return self.to_frame().equals(Series(other.frame, other.col, other.dtype, self.name).to_frame())

    def compare(self, other: Series) -> Frame:
        return self.to_frame().compare(Series(other.frame, other.col, other.dtype, self.name).to_frame())

    # arithmetic and mathematics

    def _arith(self, f: Callable, other: Any, swap: bool = False) -> Series:
        if self.dtype == "bool":
            raise TypeMismatch("use land, lor, lxor")
        self._need(*NUMERIC)
        o = self._with(other)
        kind = other.dtype if isinstance(other, Series) else infer([other])
        if kind not in NUMERIC:
            raise TypeMismatch(f"{self.dtype} and {kind}")
        x = self.col
        out = "float64" if "float64" in (self.dtype, kind) or f is columns.div else "int64"
        if out == "float64":
            x, o = x.cast("double"), o.cast("double")
        else:
            o = o.cast("long")
            f = {columns.add: columns.add_long, columns.sub: columns.sub_long, columns.mul: columns.mul_long}[f]
        return self._new(f(o, x) if swap else f(x, o), out)

    def __add__(self, o: Any) -> Series:
        return self.lor(o) if self.dtype == "bool" else self._arith(columns.add, o)

    def __sub__(self, o: Any) -> Series:
        return self.lxor(o) if self.dtype == "bool" else self._arith(columns.sub, o)

    def __mul__(self, o: Any) -> Series:
        return self.land(o) if self.dtype == "bool" else self._arith(columns.mul, o)

    def __truediv__(self, o: Any) -> Series:
        return self._arith(columns.div, o)

    def __radd__(self, o: Any) -> Series:
        return self._arith(columns.add, o, True)

    def __rmul__(self, o: Any) -> Series:
        return self._arith(columns.mul, o, True)

    def floordiv(self, o: Any) -> Series:
        self._need("int64")
        return self._new(columns.floordiv(self.col, self._with(o)), "int64")

    def abs(self) -> Series:
        self._need(*NUMERIC)
        return self._new(F.abs(self.col))

    def round(self, digits: int = 0) -> Series:
        self._need(*NUMERIC)
        return self._new(columns.round_half_away(self.col, digits, self._float))

    def clip(self, lo: Any = None, hi: Any = None) -> Series:
        self._need(*NUMERIC)
        return self._new(columns.clip(self.col, lo, hi))

    def _math(self, f: Callable) -> Series:
        self._need(*NUMERIC)
        return self._new(f(self.col), "float64")

    def sin(self) -> Series:
        return self._math(columns.sin)

    def cos(self) -> Series:
        return self._math(columns.cos)

    def tan(self) -> Series:
        return self._math(columns.tan)

    def exp(self) -> Series:
        return self._math(columns.exp)

    def log(self) -> Series:
        return self._math(columns.log)

    def sqrt(self) -> Series:
        return self._math(columns.sqrt)

    # reductions

    def sum(self, ignore_na: bool = True, min_count: int = 0) -> Any:
        self._need(*NUMERIC)
        s, absent = self._one(stats.total(self.col, self.dtype, min_count), F.count_if(self.col.isNull()))
        return None if absent and not ignore_na else s

    def mean(self) -> float | None:
        return self._one(stats.mean(self.col))

    def var(self) -> float | None:
        return self._one(stats.var(self.col))

    def std(self) -> float | None:
        return self._one(stats.std(self.col))

    def min(self) -> Any:
        return self._one(stats.minimum(self._plain, self.dtype))

    def max(self) -> Any:
        return self._one(stats.maximum(self._plain, self.dtype))

    @property
    def _plain(self) -> Column:
        return F.unix_millis(self.col) if self.dtype == "datetime" else self.col

    def prod(self, ignore_na: bool = True, min_count: int = 0) -> Any:
        p, n, absent = self._one(stats.prod(self.col, self.dtype), F.count(self.col), F.count_if(self.col.isNull()))
        return None if (absent and not ignore_na) or n < min_count else p

    def count_nonnull(self) -> int:
        return self._one(F.count(self.col))

    def median(self) -> float | None:
        return self.quantile(0.5)

    def quantile(self, q: float) -> float | None:
        """Exact, whatever the number of rows."""
        return self.quantiles([q])[0]

    def quantiles(self, qs: Sequence[float]) -> list[float | None]:
        """Several quantiles at once."""
        if any(not 0 <= q <= 1 for q in qs):
            raise ValueError("q lies between 0 and 1")
        row = group_quantiles(self.frame._df.select(self._plain.alias("x")), [], "x", qs).first()
        return [row[f"quantile_{i}"] if row else None for i in range(len(qs))]

    def mode(self) -> Any:
        if self.dtype == "bool":
            raise TypeMismatch("not for bool")
        return stats.mode(self.frame.df.select(POS, self.col.alias("x")), "x", POS).first()[0]

    def skew(self) -> float | None:
        return self._one(stats.skew(self.col))

    def kurtosis(self) -> float | None:
        return self._one(stats.kurtosis(self.col))

    def mad(self) -> float | None:
        m = self.median()
        return None if m is None else (self._new(F.abs(self.col - F.lit(m)), "float64")).median()

    def sem(self) -> float | None:
        return self._one(stats.sem(self.col))

    def cov(self, o: Series) -> float:
        y = self._with(o)
        return self._one(stats.covariance(F.when(y.isNotNull(), self.col), F.when(self.col.isNotNull(), y)))

    def corr(self, o: Series) -> float:
        return self._one(stats.correlation(self.col, self._with(o)))

    def autocorr(self, lag: int = 1) -> float:
        return self.corr(self.shift(lag))

    def dot(self, o: Series) -> float | None:
        return self._one(stats.dot(self.col, self._with(o)))

    def argmin(self) -> int | None:
        self.frame.numbered()
        return self._one(F.min_by(F.col(POS), F.when(self.col.isNotNull(), F.struct(self.col, F.col(POS)))))

    def argmax(self) -> int | None:
        self.frame.numbered()
        x = F.when(~F.isnan(self.col), self.col) if self._float else self.col
        return self._one(F.max_by(F.col(POS), F.when(x.isNotNull(), F.struct(x, -F.col(POS)))))

    idxmin, idxmax = argmin, argmax

    def nunique(self) -> int:
        return self._one(F.count_distinct(self.col))

    def unique(self) -> list[Any]:
        """Distinct values in the order of their first appearance, on the driver; for many of them use stats.unique."""
        return [r[0] for r in stats.unique(self.frame.df.select(POS, self._plain.alias("x")), "x", POS).collect()]

    def value_counts(self) -> list[tuple[Any, int]]:
        """(value, count), most frequent first, on the driver; for many of them use stats.value_counts."""
        return [tuple(r) for r in stats.value_counts(self.frame._df.select(self._plain.alias("x")), "x").collect()]

    def describe(self) -> dict[str, Any]:
        n, absent = self._one(F.count(self.col), F.count_if(self.col.isNull()))
        out: dict[str, Any] = {"count": n, "nulls": absent}
        if self.dtype in NUMERIC:
            names = ("mean", "std", "min", "25%", "50%", "75%", "max")
            x = self.col
            mean, std, least, most = self._one(stats.mean(x), stats.std(x), stats.minimum(x, self.dtype), stats.maximum(x, self.dtype))
            out |= dict(zip(names, (mean, std, least, *self.quantiles((0.25, 0.5, 0.75)), most)))
        elif self.dtype in ("string", "categorical"):
            top = self.value_counts()[:1]
            out |= {"unique": self.nunique(), "top": top[0][0] if top else None, "freq": top[0][1] if top else 0}
            if self.dtype == "categorical":
                out["levels"] = len(self.cat.levels())
        elif self.dtype == "bool":
            out |= {"true": self.count_true(), "false": self.lnot().count_true()}
        elif self.dtype == "datetime":
            out |= dict(zip(("min", "max"), self._one(dates.iso(F.min(self.col)), dates.iso(F.max(self.col)))))
        return out

    def nlargest(self, n: int = 5) -> list[Any]:
        self._need(*NUMERIC)
        return [r[0] for r in self.frame._df.select(self.col.alias("x")).where("x is not null").orderBy(F.desc("x")).limit(n).collect()]

    def nsmallest(self, n: int = 5) -> list[Any]:
        self._need(*NUMERIC)
        return [r[0] for r in self.frame._df.select(self.col.alias("x")).where("x is not null").orderBy("x").limit(n).collect()]

    # positional

    def shift(self, p: int = 1) -> Series:
        if p >= 0:
            return self._window(p, lambda w, slot: F.lag(slot, p).over(w))
        return self._window(0, lambda w, slot: F.lead(slot, -p).over(w), ahead=-p)

    def diff(self, p: int = 1) -> Series:
        if p < 1:
            raise ValueError("p is at least 1")
        if self.dtype == "datetime":
            return self._new(F.unix_millis(self.col) - F.unix_millis(self.shift(p).col), "int64")
        self._need(*NUMERIC)
        return self._new(self.col - self.shift(p).col)

    def pct_change(self, p: int = 1) -> Series:
        before = self.shift(p).col.cast("double")
        return self._new(F.try_divide(self.col.cast("double") - before, before), "float64")

    def _poisoned(self, how: Callable) -> Series:
        """A running value that is absent from the first absent value on."""
        self._need(*NUMERIC)
        gone = self._running(ordered.run_sum, x=F.when(self.col.isNull(), 1).otherwise(0))
        return self._new(F.when(gone.col == 0, self._running(how).col), self.dtype)

    def cumsum(self) -> Series:
        return self._poisoned(ordered.run_sum)

    def cumprod(self) -> Series:
        out = self._poisoned(ordered.run_prod)
        return self._new(out.col.try_cast("long") if self.dtype == "int64" else out.col)

    def _skipping(self, how: Callable) -> Series:
        """A running extreme; absent values stay absent. NaN sticks only where it comes first."""
        self._need(*NUMERIC, "datetime")
        if not self._float:
            return self._new(F.when(self.col.isNotNull(), self._running(how).col))
        first = self._running(ordered.run_min, x=F.when(self.col.isNotNull(), F.struct(F.col(POS), F.isnan(self.col).alias("nan")))).col
        numbers = self._running(how, x=F.when(~F.isnan(self.col), self.col)).col
        return self._new(F.when(self.col.isNotNull(), F.when(first["nan"], F.lit(float("nan"))).otherwise(numbers)))

    def cummin(self) -> Series:
        return self._skipping(ordered.run_min)

    def cummax(self) -> Series:
        return self._skipping(ordered.run_max)

    def rank(self, method: str = "average") -> Series:
        if self.dtype == "categorical":
            raise TypeMismatch("not for categorical")
        return self._new(self.frame.ranked(self.col, method), "float64")

    def pct_rank(self) -> Series:
        n = self.count_nonnull()
        return self._new((self.rank().col - 1) / (n - 1) if n > 1 else F.when(self.col.isNotNull(), F.lit(0.0)), "float64")

    def rolling(self, size: int) -> Rolling:
        return Rolling(self, size)

    def expanding(self, min_periods: int = 1) -> Expanding:
        return Expanding(self, min_periods)

    # accessors

    @property
    def str(self) -> StringAccessor:
        self._need("string", "categorical")
        return StringAccessor(self)

    @property
    def dt(self) -> DateAccessor:
        self._need("datetime")
        return DateAccessor(self)

    @property
    def cat(self) -> CategoryAccessor:
        self._need("categorical")
        return CategoryAccessor(self)

    @staticmethod
    def dt_parse(text: str, dayfirst: bool = False) -> int | None:
        return Series.of([text], "string").astype("datetime", dayfirst).get(1)

    @staticmethod
    def dt_format(millis: int) -> str:
        return Series.of([millis], "int64").astype("datetime").astype("string").get(1)

    @staticmethod
    def dt_from_parts(y: int, mo: int, d: int, h: int = 0, mi: int = 0, s: int = 0, millis: int = 0) -> int | None:
        one = Series.of([0], "int64")
        return one._new(dates.from_parts(*[F.lit(v).cast("long") for v in (y, mo, d, h, mi, s, millis)]), "datetime").get(1)


class Rolling:
    """Windows of the last `size` rows. Without min_periods a result needs `size` rows and one present value; with it, that many present ones."""

    def __init__(self, series: Series, size: int, least: int | None = None) -> None:
        series._need(*NUMERIC)
        if size < 1:
            raise ValueError("a window has at least one row")
        self.series, self.size, self.least = series, size, least

    def min_periods(self, p: int) -> Rolling:
        return Rolling(self.series, self.size, p)

    def _of(self, f: Callable[[Column], Column], dtype: str) -> Series:
        def column(w: Any, slot: Column) -> Column:
            over = w.rowsBetween(1 - self.size, 0)
            n = F.count(slot).over(over)
            enough = n >= self.least if self.least is not None else (F.col(POS) >= self.size) & (n >= 1)
            return F.when(enough, f(slot).over(over))

        return self.series._window(self.size - 1, column, dtype)

    def sum(self) -> Series:
        return self._of(F.sum, self.series.dtype)

    def mean(self) -> Series:
        return self._of(F.avg, "float64")

    def min(self) -> Series:
        return self._of(F.min, self.series.dtype)

    def max(self) -> Series:
        return self._of(F.max, self.series.dtype)

    def std(self) -> Series:
        return self._of(F.stddev_samp, "float64")

    def var(self) -> Series:
        return self._of(F.var_samp, "float64")

    def count(self) -> Series:
        return self._of(F.count, "int64")

    def median(self) -> Series:
        return self.quantile(0.5)

    def quantile(self, q: float) -> Series:
        return self._of(lambda x: F.percentile(x, F.lit(float(q))), "float64")


class Expanding:
    """All rows up to each; a result needs `least` present values."""

    def __init__(self, series: Series, least: int = 1) -> None:
        series._need(*NUMERIC)
        self.series, self.least = series, least

    def _enough(self, col: Column, dtype: str) -> Series:
        return self.series._new(F.when(self._n() >= self.least, col), dtype)

    def _n(self) -> Column:
        return self.series._running(ordered.run_sum, x=F.when(self.series.col.isNotNull(), 1).otherwise(0)).col

    def _run(self, how: Callable, x: Column | None = None) -> Column:
        return self.series._running(how, x=x).col

    def sum(self) -> Series:
        return self._enough(self._run(ordered.run_sum), self.series.dtype)

    def mean(self) -> Series:
        return self._enough(self._run(ordered.run_sum, self.series.col.cast("double")) / self._n(), "float64")

    def min(self) -> Series:
        return self._enough(self._run(ordered.run_min), self.series.dtype)

    def max(self) -> Series:
        return self._enough(self._run(ordered.run_max), self.series.dtype)

    def count(self) -> Series:
        return self._enough(self._n().cast("long"), "int64")

    def var(self) -> Series:
        # sums around the first present value keep the numbers small
        x = self.series.col.cast("double")
        self.series.frame.numbered()
        start = self.series._one(F.min_by(x, F.when(x.isNotNull(), F.col(POS))))
        y = x - F.lit(start)
        s, q, n = self._run(ordered.run_sum, y), self._run(ordered.run_sum, y * y), self._n()
        v = F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
        return self._enough(F.when(n >= 2, v), "float64")

    def std(self) -> Series:
        return self.series._new(F.sqrt(self.var().col), "float64")

    def median(self) -> Series:
        """Exact, in blocks: see operators.ordered.running_median."""
        return self._enough(self.series.frame.running_median(self.series.col), "float64")


class StringAccessor:
    """Functions on texts; see functions.strings."""

    def __init__(self, series: Series) -> None:
        self.series = series

    def _of(self, col: Column, dtype: str = "string") -> Series:
        return self.series._new(col, dtype)

    def split(self, sep: str, max_splits: int = 0) -> Frame:
        """A column per part, as many as the widest text has; missing parts are absent."""
        parts = strings.split(self.series.col, sep, max_splits)
        width = self.series._one(F.coalesce(F.max(F.size(parts)), F.lit(0)))
        frame = self.series.frame
        df = frame._df.select(*frame.place, *[F.get(parts, i).alias(f"{i + 1}") for i in range(width)])
        return frame._next(df, {f"{i + 1}": "string" for i in range(width)}, frame._dense)

    def cat(self, sep: str = "") -> str:
        """All present texts in one, in row order; the result is one driver-side text."""
        frame = self.series.frame.ascending()
        return self.series._one(strings.join_rows(self.series.col, F.struct(*frame.place), sep))

    join = cat


def _add(cls: type, module: Any, names: dict[str, str], aliases: dict[str, str] | None = None) -> None:
    """Accessor methods that pass the column to a function of the module."""
    for name, dtype in names.items():
        f = getattr(module, (aliases or {}).get(name, name))

        def method(self: Any, *a: Any, _f: Callable = f, _d: str = dtype, **k: Any) -> Series:
            return self.series._new(_f(self.series.col, *a, **k), _d)

        method.__name__, method.__doc__ = name, f.__doc__
        setattr(cls, name, method)


_add(StringAccessor, strings, dict.fromkeys(("lower", "upper", "strip", "replace", "slice", "pad", "zfill", "rep", "removeprefix", "removesuffix", "capitalize", "title", "swapcase"), "string"), {"slice": "slice_bytes"})
_add(StringAccessor, strings, dict.fromkeys(("len", "find", "count"), "int64"), {"len": "length"})
_add(StringAccessor, strings, dict.fromkeys(("contains", "startswith", "endswith", "isdigit", "isalpha", "isalnum", "isspace", "islower", "isupper"), "bool"))


class DateAccessor:
    """Functions on moments; see functions.dates."""

    def __init__(self, series: Series) -> None:
        self.series = series

    def diff(self, p: int = 1) -> Series:
        return self.series.diff(p)


_add(DateAccessor, dates, dict.fromkeys(("year", "month", "day", "hour", "minute", "second", "ms", "weekday", "yearday", "quarter", "week", "days_in_month"), "int64"))
_add(DateAccessor, dates, dict.fromkeys(("truncate", "ceil", "round", "normalize", "add_ms", "add_seconds", "add_minutes", "add_hours", "add_days"), "datetime"), {"round": "round_to"})
_add(DateAccessor, dates, dict.fromkeys(("is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end", "is_leap_year"), "bool"))
_add(DateAccessor, dates, dict.fromkeys(("format", "month_name", "day_name", "strftime"), "string"), {"format": "iso"})


class CategoryAccessor:
    """Levels of a categorical column, in the order of first appearance; codes count from 1."""

    def __init__(self, series: Series) -> None:
        self.series = series

    def levels(self) -> list[str]:
        return [v for v in self.series.unique() if v is not None]

    def level_table(self) -> DataFrame:
        """level, code: one row per level."""
        df = self.series.frame.df.select(POS, self.series.col.alias("level")).where("level is not null")
        first = df.groupBy("level").agg(F.min(POS).alias("__o"))
        return ordered.number_rows(first, ["__o"]).select("level", F.col(POS).alias("code"))

    def codes(self) -> Series:
        return self.series._new(self.series.frame.looked_up(self.series.col, self.level_table(), "level", "code"), "int64")

    def rename_categories(self, names: dict[str, str]) -> Series:
        x = self.series.col
        out = F.when(F.lit(False), x)
        for old, new in names.items():
            out = out.when(x == old, F.lit(new))
        return self.series._new(out.otherwise(x))

    def set_categories(self, levels: Sequence[str]) -> Series:
        return self.series._new(F.when(columns.isin(self.series.col, levels), self.series.col))

    def add_categories(self, levels: Sequence[str]) -> Series:
        """Levels without a row have no trace in the data: the column as it is, after a check for names in use."""
        used = set(levels) & set(self.levels())
        if used:
            raise ValueError(f"levels in use: {sorted(used)}")
        return self.series.clone()

    def remove_categories(self, levels: Sequence[str]) -> Series:
        return self.series._new(F.when(~columns.isin(self.series.col, levels), self.series.col))
