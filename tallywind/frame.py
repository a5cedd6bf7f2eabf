"""An ordered table of typed columns over a Spark DataFrame."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .display import LONG, grid
from .errors import TypeMismatch, UnknownName
from .operators import groups, ordered, relational, stats
from .operators.ordered import POS
from .series import Series
from .session import materialize
from .types import NUMERIC, SPARK, convert, dtype_of, infer


class Frame:
    """Named columns of one length, in a row order that is part of the data.

    Wraps a DataFrame. Its order is a list of hidden key columns until something
    asks for positions, then the hidden position `__pos`: rows that are only
    filtered, computed, grouped or joined are never numbered, so filters and
    columns reach the scan. Row functions stay lazy Spark expressions;
    positional ones work in blocks (operators.ordered), so that no window spans
    the whole table in one task. Methods return new frames.
    """

    def __init__(self, df: DataFrame, dtypes: Mapping[str, str], dense: bool = True, keys: Sequence[tuple[str, bool]] = ()) -> None:
        self._table, self.dtypes = df, dict(dtypes)
        self._keys = list(keys)  # (hidden column, ascending) of a frame without positions
        self._pending: list[tuple] = []  # window and running columns asked for, computed together when a result is
        self._dense = dense
        self._count = 0
        self._heavy = False

    # construction

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str]) -> Frame:
        """A DataFrame in the order of its columns `order`; integers become int64, dates and timestamps datetime.

        The order should tell rows apart; equal keys follow in the order of a hash of their rows.
        """
        kinds = {f.name: dtype_of(f) for f in df.schema.fields}
        plain = df.select(*[F.col(n).cast(SPARK[k]).alias(n) if k in SPARK else F.col(n) for n, k in kinds.items()])
        return cls._ordered(plain, order, kinds)

    @classmethod
    def _ordered(cls, df: DataFrame, order: Sequence[str | Column | tuple[Column, bool]], kinds: Mapping[str, str]) -> Frame:
        """The `kinds` columns of df in an order of columns, or (column, ascending); not numbered yet."""
        keys = [o if isinstance(o, tuple) else (F.col(o) if isinstance(o, str) else o, True) for o in order]
        names = [f"__o{i}" for i in range(len(keys))]
        return cls(df.select(*[c.alias(n) for n, (c, _) in zip(names, keys)], *kinds), kinds, keys=[(n, asc) for n, (_, asc) in zip(names, keys)])

    @classmethod
    def from_columns(cls, columns: Sequence[tuple], spark: SparkSession | None = None) -> Frame:
        """[(name, values, dtype?), ...]: literal columns of one length."""
        spark = spark or SparkSession.getActiveSession()
        names = [c[0] for c in columns]
        if len(set(names)) < len(names):
            raise ValueError("two columns of one name")
        if len({len(c[1]) for c in columns}) > 1:
            raise ValueError("columns of different lengths")
        kinds = {c[0]: (c[2] if len(c) > 2 and c[2] else infer(c[1])) for c in columns}
        values = [[convert(v, kinds[c[0]]) for v in c[1]] for c in columns]
        fields = [T.StructField(POS, T.LongType(), False)] + [T.StructField(n, SPARK[k], metadata={"categorical": True} if k == "categorical" else None) for n, k in kinds.items()]
        return cls(spark.createDataFrame([(i + 1, *r) for i, r in enumerate(zip(*values))], T.StructType(fields)), kinds)

    @classmethod
    def from_dict(cls, data: Any, form: str = "columns", order: Sequence[str] | None = None) -> Frame:
        """{name: values} or a list of records; columns in the given order, else by name. Here strings win over numbers."""
        if form == "records":
            names = order or sorted({k for r in data for k in r})
            data = {n: [r.get(n) for r in data] for n in names}
        names = order or sorted(data)
        columns = []
        for n in names:
            v = list(data[n])
            if any(isinstance(x, str) for x in v):
                columns.append((n, [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in v], "string"))
            elif any(isinstance(x, bool) for x in v) and any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
                columns.append((n, [None if x is None else float(x) if isinstance(x, float) else int(x) for x in v]))
            else:
                columns.append((n, v))
        return cls.from_columns(columns)

    # plumbing for Series

    @property
    def columns(self) -> list[str]:
        return list(self.dtypes)

    @property
    def _df(self) -> DataFrame:
        """The DataFrame with all columns that were asked for; with positions only if it is numbered."""
        if self._pending:
            self._compute()
        return self._table

    @_df.setter
    def _df(self, df: DataFrame) -> None:
        self._table = df

    @property
    def df(self) -> DataFrame:
        """The DataFrame with positions; numbers the rows if that was not done yet."""
        if self._keys:
            rows = ordered.number_rows(self._df, [F.col(n) if asc else F.col(n).desc() for n, asc in self._keys])
            self._df, self._keys, self._dense = rows.drop(*[n for n, _ in self._keys]), [], True
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df = df

    @property
    def place(self) -> list[str]:
        """The hidden columns that hold the order: the position, or the keys of a frame without one."""
        return [n for n, _ in self._keys] or [POS]

    def _order(self, reverse: bool = False) -> list[Column]:
        return [F.col(n) if asc != reverse else F.col(n).desc() for n, asc in self._keys or [(POS, True)]]

    def _visible(self, df: DataFrame) -> DataFrame:
        return df.select(POS, *self.columns)

    def rows(self) -> DataFrame:
        """The visible columns and the order's, whether numbered or not."""
        return self._df.select(*self.place, *self.columns)

    def _next(self, df: DataFrame, dtypes: Mapping[str, str] | None = None, dense: bool = True) -> Frame:
        """A frame of a DataFrame that still holds this one's order."""
        out = Frame(df, dtypes or self.dtypes, dense, self._keys)
        out._heavy, out._count = self._heavy, self._count
        return out

    def numbered(self) -> DataFrame:
        """The DataFrame with dense positions."""
        df = self.df
        if not self._dense:
            rest = df.withColumnRenamed(POS, "__old")
            self._df = df = ordered.number_rows(rest, ["__old"], ties=False).drop("__old")
            self._dense = True
        return df

    def _hidden(self) -> str:
        self._count += 1
        return f"__h{self._count}"

    def _stored(self) -> DataFrame:
        """The numbered DataFrame, written out if an earlier running function is in its plan: those read their input twice, and plans would double."""
        df = self.numbered()
        if self._heavy:
            self.df = df = materialize(df, "frame")
        self._heavy = True
        return df

    def _ask(self, kind: str, x: Column, *how: Any) -> Column:
        """A hidden column that is computed later, together with the others of its kind."""
        if self._keys or not self._dense:
            self.numbered()
        if any(p[1] in str(x) for p in self._pending):
            self._compute()  # x builds on one of them
        name = self._hidden()
        self._pending.append((kind, name, x, *how))
        return F.col(name)

    def _compute(self) -> None:
        pending, self._pending = self._pending, []
        slots = {name: F.col(f"__s{name}") for _, name, *_ in pending}
        windows = [p for p in pending if p[0] == "window"]
        if windows:
            df = self._table.withColumns({f"__s{name}": x for _, name, x, *_ in windows})
            outputs = {name: (lambda w, f=f, s=slots[name]: f(w, s)) for _, name, _, f, _, _ in windows}
            self._table = ordered.reach_back(df, max(p[4] for p in windows), outputs, max(p[5] for p in windows)).drop(*[f"__s{name}" for _, name, *_ in windows])
        for backwards in (False, True):
            running = [p for p in pending if p[0] == "running" and p[4] == backwards]
            if running:
                df = self._stored().withColumns({f"__s{name}": x for _, name, x, *_ in running})
                self._table = ordered.running(df, {name: how(slots[name]) for _, name, _, how, _ in running}, backwards).drop(*[f"__s{name}" for _, name, *_ in running])

    def windowed(self, x: Column, reach: int, f: Callable[[Any, Column], Column], ahead: int = 0) -> Column:
        """A hidden column: f of a window and of x that reaches so many rows back and ahead."""
        return self._ask("window", x, f, reach, ahead)

    def running(self, x: Column, how: Callable[[Column], ordered.Running], backwards: bool = False) -> Column:
        return self._ask("running", x, how, backwards)

    def ranked(self, x: Column, method: str) -> Column:
        name = self._hidden()
        df = self._stored().withColumn("__slot", x)
        self.df = ordered.rank(df, "__slot", name, method).drop("__slot")
        return F.col(name)

    def running_median(self, x: Column) -> Column:
        name = self._hidden()
        df = materialize(self.numbered().withColumn("__slot", x), "frame")
        self.df = ordered.running_median(df, "__slot", name).drop("__slot")
        self._heavy = True
        return F.col(name)

    def looked_up(self, x: Column, table: DataFrame, key: str, value: str) -> Column:
        name = self._hidden()
        small = table.select(F.col(key).alias("__key"), F.col(value).alias(name))
        self.df = self._df.withColumn("__slot", x).join(small, F.col("__slot") == F.col("__key"), "left").drop("__slot", "__key")
        return F.col(name)

    def align(self, other: Series) -> Column:
        """A column of another frame beside this one's rows, by position; the lengths must agree."""
        if len(self) != len(other):
            raise ValueError("columns of different lengths")
        name = self._hidden()
        theirs = other.frame.numbered().select(POS, other.col.alias(name))
        self.df = self._stored().join(theirs, POS, "left")
        return F.col(name)

    def where(self, cond: Column) -> Frame:
        return self._next(self._df.where(cond), dense=False)

    def select_expression(self, s: Series) -> Series:
        return self._next(self._df.select(*self.place, s.col.alias(s.name)), {s.name: s.dtype}, self._dense)[s.name]

    def ascending(self) -> Frame:
        """This frame, numbered where its order has descending keys: what takes an order as columns needs ascending ones."""
        if not all(asc for _, asc in self._keys):
            self.df  # noqa: B018  numbers the rows
        return self

    # metadata and cells

    def __len__(self) -> int:
        return self._df.count()

    nrows = property(__len__)

    @property
    def ncols(self) -> int:
        return len(self.columns)

    def has_column(self, name: str) -> bool:
        return name in self.dtypes

    def column(self, name: str) -> Series:
        if name not in self.dtypes:
            raise UnknownName(name, self.columns)
        return Series(self, F.col(name), self.dtypes[name], name)

    col = column

    def __getitem__(self, key: str | Series) -> Series | Frame:
        return self.filter(key) if isinstance(key, Series) else self.column(key)

    def clone(self) -> Frame:
        return self._next(self._df, dense=self._dense)

    def row(self, i: int, na: Any = None) -> dict[str, Any]:
        got = self.numbered().where(F.col(POS) == i).select(*self.columns).first()
        if got is None:
            raise IndexError(i)
        return {k: na if v is None else v for k, v in got.asDict().items()}

    def at(self, i: int, name: str) -> Any:
        return self.column(name).get(i)

    def iat(self, i: int, j: int) -> Any:
        return self.column(self.columns[j - 1]).get(i)

    def to_dataframe(self, in_order: bool = True) -> DataFrame:
        """The rows as a DataFrame, sorted by the frame's order unless that does not matter."""
        return (self._df.orderBy(*self._order()) if in_order else self._df).select(*self.columns)

    def to_table(self, na: Any = None) -> list[dict[str, Any]]:
        return self.to_dict("records", na)

    def to_dict(self, form: str = "columns", na: Any = None) -> Any:
        rows = [{k: na if v is None else v for k, v in r.asDict().items()} for r in self.to_dataframe().collect()]
        return rows if form == "records" else {n: [r[n] for r in rows] for n in self.columns}

    def _shown(self, most: int) -> list[list[Any]]:
        n = len(self)
        if n <= most:
            return [list(r) for r in self.to_dataframe().collect()]
        half = most // 2
        rows = [list(r) for r in self.head(half).to_dataframe().collect()]
        return [*rows, ["..."] * self.ncols, *[list(r) for r in self.tail(most - half).to_dataframe().collect()]]

    def to_string(self, max_rows: int = LONG) -> str:
        return grid(self.columns, self._shown(max_rows), [k in NUMERIC for k in self.dtypes.values()])

    def to_markdown(self, max_rows: int = LONG) -> str:
        return grid(self.columns, self._shown(max_rows), [k in NUMERIC for k in self.dtypes.values()], True)

    def __repr__(self) -> str:
        return f"Frame({len(self)} x {self.ncols})\n{self.to_string()}"

    # columns

    def select(self, names: Sequence[str]) -> Frame:
        for n in names:
            self.column(n)
        if len(set(names)) < len(names):
            raise ValueError("a column named twice")
        return self._next(self._df.select(*self.place, *names), {n: self.dtypes[n] for n in names}, self._dense)

    def assign(self, name: str, value: Any) -> Frame:
        """With a column replaced or added: a Series, a function of the frame, or one value for all rows."""
        if callable(value) and not isinstance(value, Series):
            value = value(self)
        if isinstance(value, Series):
            x = value.col if value.frame is self else self.align(value)
            kind = value.dtype
        else:
            kind = infer([value])
            x = F.lit(value).cast(SPARK[kind])
        return self._next(self._df.withColumn(name, x), {**self.dtypes, name: kind}, self._dense)

    def with_columns(self, values: Mapping[str, Series]) -> Frame:
        """With several columns at once; window and running ones of this frame are computed in one pass of their kind."""
        columns = {n: s.col if s.frame is self else self.align(s) for n, s in values.items()}
        out = self._next(self._df.withColumns(columns), {**self.dtypes, **{n: s.dtype for n, s in values.items()}}, self._dense)
        return out._next(out.rows(), dense=out._dense)

    def add_column(self, name: str, value: Any) -> Frame:
        if name in self.dtypes:
            raise ValueError(f"column {name!r} exists")
        return self.assign(name, value)

    def update_column(self, name: str, value: Any) -> Frame:
        self.column(name)
        return self.assign(name, value)

    def insert(self, place: int, name: str, value: Any) -> Frame:
        out = self.add_column(name, value)
        names = self.columns
        names.insert(place - 1, name)
        return out.select(names)

    def drop_column(self, name: str) -> Frame:
        self.column(name)
        return self.select([c for c in self.columns if c != name])

    def rename(self, names: Mapping[str, str]) -> Frame:
        for n in names:
            self.column(n)
        after = [names.get(c, c) for c in self.columns]
        if len(set(after)) < len(after):
            raise ValueError("two columns of one name")
        return self._next(self.rows().toDF(*self.place, *after), dict(zip(after, self.dtypes.values())), self._dense)

    def rename_column(self, old: str, new: str) -> Frame:
        return self.rename({old: new})

    def astype(self, kinds: Mapping[str, str], dayfirst: bool = False) -> Frame:
        out = self
        for n, k in kinds.items():
            out = out.assign(n, out.column(n).astype(k, dayfirst))
        return out

    def map_columns(self, f: Callable[[Series], Series], kinds: Sequence[str] = NUMERIC) -> Frame:
        """Every column through f; a column of another kind is an error."""
        for n, k in self.dtypes.items():
            if kinds and k not in kinds:
                raise TypeMismatch(f"column {n!r} is {k}")
        base = self.clone()
        done = {n: f(base.column(n)) for n in base.columns}
        return base._next(base._df.select(*base.place, *[s.col.alias(n) for n, s in done.items()]), {n: s.dtype for n, s in done.items()}, base._dense)

    def abs(self) -> Frame:
        return self.map_columns(Series.abs)

    def round(self, digits: int = 0) -> Frame:
        return self.map_columns(lambda s: s.round(digits))

    def clip(self, lo: Any = None, hi: Any = None) -> Frame:
        return self.map_columns(lambda s: s.clip(lo, hi))

    def diff(self) -> Frame:
        return self.map_columns(Series.diff, (*NUMERIC, "datetime"))

    def cumsum(self) -> Frame:
        return self.map_columns(Series.cumsum)

    def cumprod(self) -> Frame:
        return self.map_columns(Series.cumprod)

    def cummin(self) -> Frame:
        return self.map_columns(Series.cummin)

    def cummax(self) -> Frame:
        return self.map_columns(Series.cummax)

    def shift(self, p: int = 1) -> Frame:
        return self.map_columns(lambda s: s.shift(p), ())

    def ffill(self) -> Frame:
        return self.map_columns(Series.ffill, ())

    def bfill(self) -> Frame:
        return self.map_columns(Series.bfill, ())

    def isna(self) -> Frame:
        return self.map_columns(Series.isna, ())

    def notna(self) -> Frame:
        return self.map_columns(Series.notna, ())

    def fillna(self, value: Any) -> Frame:
        """One value for all columns, or {column: value}."""
        values = value if isinstance(value, Mapping) else dict.fromkeys(self.columns, value)
        out = self
        for n, v in values.items():
            out = out.assign(n, out.column(n).fillna(v))
        return out

    def rolling(self, size: int, min_periods: int | None = None) -> FrameRolling:
        return FrameRolling(self, size, min_periods)

    # rows

    def filter(self, mask: Series) -> Frame:
        if mask.dtype != "bool":
            raise TypeMismatch("a mask is bool")
        return self.where(mask.col if mask.frame is self else self.align(mask))

    def take(self, positions: Sequence[int]) -> Frame:
        """Rows by position, in the order given, repeats allowed."""
        n = len(self)
        if any(not 1 <= i <= n for i in positions):
            raise IndexError("position out of range")
        index = self._df.sparkSession.createDataFrame([(k + 1, i) for k, i in enumerate(positions)], "__new long, __at long")
        df = self.numbered().select(*self.columns, F.col(POS).alias("__at")).join(index, "__at").withColumnRenamed("__new", POS)
        return self._next(df.select(POS, *self.columns))

    def head(self, n: int = 5) -> Frame:
        return self._next(self.rows().orderBy(*self._order()).limit(n), dense=self._dense)

    def tail(self, n: int = 5) -> Frame:
        return self._next(self.rows().orderBy(*self._order(True)).limit(n), dense=False)

    def iloc(self, start: int, stop: int) -> Frame:
        n = len(self)
        if start < 1 or stop > n or start > stop + 1:
            raise IndexError((start, stop))
        return self._next(self.numbered().where(F.col(POS).between(start, stop)).withColumn(POS, F.col(POS) - start + 1))

    def sample(self, n: int = 1, seed: int = 0) -> Frame:
        """n rows without replacement, in the order drawn."""
        if n > len(self):
            raise ValueError("more rows asked for than there are")
        drawn = self._visible(self.numbered()).withColumn("__r", F.xxhash64(F.lit(seed), F.col(POS))).orderBy("__r").limit(n)
        return self._ordered(drawn, ["__r"], self.dtypes)

    def dropna(self, subset: Sequence[str] | None = None) -> Frame:
        """Rows without an absent value in the subset; NaN stays."""
        cond = F.lit(True)
        for n in subset or self.columns:
            cond = cond & self.column(n).col.isNotNull()
        return self.where(cond)

    def sort_by(self, name: str, asc: bool = True) -> Frame:
        """By one column; an absent value or NaN in it is an error. Equal values keep their order."""
        x = self.column(name).col
        bad = x.isNull() | F.isnan(x) if self.dtypes[name] == "float64" else x.isNull()
        if self._df.where(bad).limit(1).count():
            raise ValueError(f"column {name!r} has absent values or NaN")
        place = [(F.col(n), up) for n, up in self._keys] or [(F.col(POS), True)]
        return self._ordered(self._df, [(x, asc), *place], self.dtypes)

    def duplicated(self, subset: Sequence[str] | None = None, keep: str = "first") -> Series:
        df = relational.duplicated(self._visible(self.df), [POS], subset, keep)
        return Frame(df, {**self.dtypes, "duplicated": "bool"}, self._dense)["duplicated"]

    def drop_duplicates(self, subset: Sequence[str] | None = None, keep: str = "first") -> Frame:
        return self._next(relational.drop_duplicates(self._visible(self.df), [POS], subset, keep), dense=False)

    # relations

    def concat(self, others: Frame | Sequence[Frame]) -> Frame:
        frames = [self, *([others] if isinstance(others, Frame) else others)]
        relational.concat([f.df.select(*f.columns) for f in frames])  # checks names and types
        parts = [f._visible(f.df).withColumn("__part", F.lit(i)) for i, f in enumerate(frames)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return self._ordered(df, ["__part", POS], self.dtypes)

    def join(self, other: Frame, on: str | Sequence[str] | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_left", "_right"), left_on: Sequence[str] | None = None, right_on: Sequence[str] | None = None) -> Frame:
        a = self.rows().withColumnsRenamed({n: f"__l{i}" for i, n in enumerate(self.place)})
        b = other.rows().withColumnsRenamed({n: f"__r{i}" for i, n in enumerate(other.place)})
        for f, names in zip((self, other), relational.key_names(on, left_on, right_on)):
            groups.require_keys(f._df, [n for n in names if n in f.dtypes])
        df = relational.join(a, b, on, how, suffixes, left_on, right_on)
        mine, theirs = [[(f"__{side}{i}", asc) for i, (_, asc) in enumerate(f._keys or [(POS, True)])] for side, f in (("l", self), ("r", other))]
        order = []
        for n, asc in [*theirs, *mine] if how == "right" else [*mine, *theirs]:
            order += [F.col(n).isNull(), (F.col(n), asc)]  # rows without a partner last
        kinds = {f.name: dtype_of(f) for f in df.schema.fields if f.name not in {n for n, _ in [*mine, *theirs]}}
        return self._ordered(df, order, kinds)

    def groupby(self, keys: str | Sequence[str]) -> GroupBy:
        names = [keys] if isinstance(keys, str) else list(keys)
        for n in names:
            self.column(n)
        groups.require_keys(self._df, names)
        return GroupBy(self, names)

    def _shaped(self, df: DataFrame, order: Sequence[str]) -> Frame:
        return self._ordered(df, order, {f.name: dtype_of(f) for f in df.schema.fields})

    def pivot(self, index: str, columns: str, values: str) -> Frame:
        groups.require_keys(self._df, [index, columns])
        return self._shaped(relational.pivot(self.rows(), index, columns, values, self.ascending().place), [index])

    def pivot_table(self, index: str, columns: str, values: str, aggfunc: str = "sum") -> Frame:
        groups.require_keys(self._df, [index, columns])
        return self._shaped(relational.pivot_table(self.rows(), index, columns, values, aggfunc, self.ascending().place), [index])

    def unstack(self, index: str, column: str, values: str) -> Frame:
        return self.pivot_table(index, column, values, "first")

    def melt(self, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, var_name: str = "variable", value_name: str = "value") -> Frame:
        """All rows of the first value column, then of the second, ..."""
        values = list(value_vars) if value_vars is not None else [c for c in self.columns if c not in id_vars]
        df = relational.melt(self.rows(), [*self.place, *id_vars], values, var_name, value_name)
        place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(var_name))
        kinds = {f.name: dtype_of(f) for f in df.schema.fields if f.name not in self.place}
        return self._ordered(df, [place, *[(F.col(n), asc) for n, asc in self._keys or [(POS, True)]]], kinds)

    def stack(self, names: Sequence[str], var_name: str = "variable", value_name: str = "value") -> Frame:
        return self.melt([c for c in self.columns if c not in names], names, var_name, value_name)

    def explode(self, name: str) -> Frame:
        df = self.rows().select("*", F.posexplode_outer(name).alias("__i", "__v")).drop(name).withColumnRenamed("__v", name)
        kinds = {n: dtype_of(df.schema[n]) for n in self.columns}
        return self._ordered(df, [*[(F.col(n), asc) for n, asc in self._keys or [(POS, True)]], "__i"], kinds)

    def equals(self, other: Frame) -> bool:
        return self.dtypes == other.dtypes and relational.equals(self._visible(self.numbered()), other._visible(other.numbered()), POS)

    def compare(self, other: Frame) -> Frame:
        df = relational.compare(self._visible(self.numbered()), other._visible(other.numbered()), POS).withColumnRenamed(POS, "row")
        place = F.array_position(F.array(*[F.lit(c) for c in self.columns]), F.col("column"))
        kinds = {"row": "int64", "column": "string", "self": "string", "other": "string"}
        return self._ordered(df, [place, "row"], kinds)

    # reductions

    def _numeric(self) -> list[str]:
        names = [n for n, k in self.dtypes.items() if k in NUMERIC]
        if not names:
            raise TypeMismatch("no numeric column")
        return names

    def _reduce(self, f: Callable[[Column, str], Column]) -> Frame:
        names = self._numeric()
        df = self._df.agg(*[f(F.col(n), self.dtypes[n]).alias(n) for n in names])
        return Frame(df.withColumn(POS, F.lit(1).cast("long")), {n: dtype_of(df.schema[n]) for n in names})

    def sum(self) -> Frame:
        return self._reduce(stats.total)

    def prod(self) -> Frame:
        return self._reduce(stats.prod)

    def min(self) -> Frame:
        return self._reduce(stats.minimum)

    def max(self) -> Frame:
        return self._reduce(stats.maximum)

    def mean(self) -> Frame:
        return self._reduce(lambda x, k: stats.mean(x))

    def std(self) -> Frame:
        return self._reduce(lambda x, k: stats.std(x))

    def var(self) -> Frame:
        return self._reduce(lambda x, k: stats.var(x))

    def median(self) -> Frame:
        return self.quantile(0.5)

    def quantile(self, q: float) -> Frame:
        """Exact, whatever the number of rows; one row."""
        values = {n: self.column(n).quantile(q) for n in self._numeric()}
        return Frame.from_columns([(n, [v], "float64") for n, v in values.items()], self._df.sparkSession)

    def skew(self) -> Frame:
        return self._reduce(lambda x, k: stats.skew(x))

    def kurtosis(self) -> Frame:
        return self._reduce(lambda x, k: stats.kurtosis(x))

    def sem(self) -> Frame:
        return self._reduce(lambda x, k: stats.sem(x))

    def mad(self) -> Frame:
        values = {n: self.column(n).mad() for n in self._numeric()}
        return Frame.from_columns([(n, [v], "float64") for n, v in values.items()], self._df.sparkSession)

    def count_nonnull(self) -> Frame:
        return self._reduce(lambda x, k: F.count(x))

    def nunique(self) -> dict[str, int]:
        return self._df.agg(*[F.count_distinct(n).alias(n) for n in self.columns]).first().asDict()

    def describe(self) -> dict[str, dict[str, Any]]:
        return {n: self.column(n).describe() for n in self.columns}

    def corr(self) -> Frame:
        return self._matrix("corr")

    def cov(self) -> Frame:
        return self._matrix("cov")

    def _matrix(self, kind: str) -> Frame:
        names = self._numeric()
        df = stats.matrix(self._df, names, kind)
        place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("__index__"))
        return Frame(df.withColumn(POS, place), {"__index__": "string", **dict.fromkeys(names, "float64")})

    # sinks

    def to_csv(self, path: str, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".") -> None:
        from .sources.csv import write_csv

        write_csv(self.to_dataframe(), path, sep, header, quote, decimal)

    def to_csv_mem(self, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".") -> str:
        from .sources.csv import csv_text

        return csv_text(self.to_dataframe(), sep, header, quote, decimal)

    def to_json(self, path: str, pretty: bool = False, lines: bool = True) -> None:
        """A folder of JSON lines; with pretty, or lines=False, one array of records in a file of the folder."""
        from .sources.json import write_json

        write_json(self.to_dataframe(), path, pretty, lines and not pretty)

    def to_json_mem(self, pretty: bool = False) -> str:
        from .sources.json import json_text

        return json_text(self.to_dataframe(), pretty)


class GroupBy:
    """Groups of a frame; results are frames sorted by the keys."""

    def __init__(self, frame: Frame, keys: list[str]) -> None:
        self.frame, self.keys = frame.ascending(), keys
        place = self.frame.place
        self.groups = groups.Groups(self.frame.rows(), keys, place)
        for n in place:
            self.groups.kinds.pop(n)

    def _sorted(self, df: DataFrame) -> Frame:
        return Frame._ordered(df, self.keys, {f.name: dtype_of(f) for f in df.schema.fields})

    def __getattr__(self, name: str) -> Callable[..., Frame]:
        if name not in groups.BUILTIN:
            raise AttributeError(name)
        return lambda *columns: self._sorted(getattr(self.groups, name)(*columns))

    def quantile(self, q: float, *columns: str) -> Frame:
        return self._sorted(self.groups.quantile(q, *columns))

    def agg(self, spec: Mapping[str, Any]) -> Frame:
        return self._sorted(self.groups.agg(spec))

    def apply(self, column: str, function: Callable, returns: str = "double") -> Frame:
        return self._sorted(self.groups.apply(column, function, returns))

    def transform(self, function: str | Callable, column: str, dtype: str = "float64") -> Series:
        """Every row with its group's aggregate of the column, or with what a function makes of the group.

        The function takes the group's values as a pandas Series, in row order,
        and returns one value for all of them or one for each. See Groups.transform.
        """
        df = self.groups.transform(function, column, "__t", SPARK[dtype].simpleString())
        return Series(self.frame._next(df, dense=self.frame._dense), F.col("__t"), dtype, column)


class FrameRolling:
    """Rolling windows of a frame's columns: frame.rolling(3).sum("x")."""

    def __init__(self, frame: Frame, size: int, least: int | None = None) -> None:
        self.frame, self.size, self.least = frame, size, least

    def min_periods(self, p: int) -> FrameRolling:
        return FrameRolling(self.frame, self.size, p)

    def __getattr__(self, name: str) -> Callable[[str], Series]:
        if name not in ("sum", "mean", "min", "max", "std", "var", "count", "median", "quantile"):
            raise AttributeError(name)

        def method(column: str, *a: Any) -> Series:
            rolling = self.frame.column(column).rolling(self.size)
            return getattr(rolling.min_periods(self.least) if self.least is not None else rolling, name)(*a)

        return method


def concat(frames: Sequence[Frame]) -> Frame:
    return frames[0].concat(frames[1:])


def join(a: Frame, b: Frame, *args: Any, **named: Any) -> Frame:
    return a.join(b, *args, **named)
