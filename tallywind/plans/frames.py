"""Queries through frames and columns, the interface a user sees, and their SQL twins."""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, concat, join
from ..operators.ordered import POS
from ..series import Series
from ..session import shared_dir
from ..sources.csv import read_csv, read_csv_mem
from ..sources.json import count_non_finite, read_json, read_json_mem
from .reference import gappy, r, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def one_row(spark: SparkSession, **values: Any) -> DataFrame:
    """A table of one row: flags, whole numbers, doubles or texts."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items()))


def customers(spark: SparkSession, d: str, *columns: str) -> Frame:
    return Frame.of(table(spark, d, "customer").select("c_custkey", *columns), ["c_custkey"])


def orders(spark: SparkSession, d: str, *columns: str) -> Frame:
    return Frame.of(table(spark, d, "orders").select("o_orderkey", *columns), ["o_orderkey"])


def events(spark: SparkSession, d: str) -> Frame:
    """event_id, user_id and v, a value with absences."""
    return Frame.of(gappy(spark, d), ["event_id"])


def odd_values(spark: SparkSession, d: str) -> Frame:
    """event_id and x: absent in every seventh row, NaN in every fifth."""
    x = F.when(c("event_id") % 7 != 0, F.when(c("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.round("value", 2)))
    return Frame.of(table(spark, d, "events").select("event_id", x.alias("x")), ["event_id"])


_GAPPY = "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS v FROM events"
_ODD = "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'nan'::DOUBLE ELSE round(value, 2) END END AS x FROM events"


def out(f: Frame, *columns: str) -> DataFrame:
    return f.to_dataframe(False).select(*columns or f.columns)


# columns of a frame


@query("SELECT TRUE AS flag, c_custkey, c_acctbal AS bal, CAST(c_nationkey AS BIGINT) + 1 AS nation, c_acctbal * 2 AS twice, CAST(7 AS BIGINT) AS seven FROM customer")
def frame_columns(spark, d):
    f = customers(spark, d, "c_name", "c_acctbal", "c_nationkey").rename({"c_acctbal": "bal"}).rename_column("c_nationkey", "nation")
    f = f.assign("twice", lambda t: t["bal"] * 2).add_column("seven", 7).insert(1, "flag", True).drop_column("c_name")
    f = f.update_column("nation", f["nation"] + 1)
    if f.columns != ["flag", "c_custkey", "bal", "nation", "twice", "seven"] or f.dtypes["bal"] != "float64" or not f.has_column("seven") or f.ncols != 6:
        raise AssertionError(f.columns)
    return out(f.clone().select(["flag", "c_custkey", "bal", "nation", "twice", "seven"]))


@query("SELECT count(*) AS nrows, CAST(5 AS BIGINT) AS ncols, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS names, 'int64,string,int64,float64,string' AS kinds FROM customer")
def frame_facts(spark, d):
    f = customers(spark, d, "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return one_row(spark, nrows=f.nrows, ncols=f.ncols, names=",".join(f.columns), kinds=",".join(f.dtypes.values()))


@query(f"SELECT event_id, v FROM ({_GAPPY}) WHERE v > 20 AND event_id >= 30")
def frame_filter_mask(spark, d):
    """An absent mask drops; the second mask belongs to another frame and is aligned by position."""
    f = events(spark, d)
    f = f[f["v"].gt(20.0)]
    other = f.select(["event_id"]).clone()
    return out(f.filter(other["event_id"].ge(30)), "event_id", "v")


@query("SELECT CAST(x.i AS BIGINT) AS place, o.o_orderkey FROM (VALUES (1, 40), (2, 3), (3, 40), (4, 1)) x(i, k) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) o ON o.n = x.k")
def frame_take(spark, d):
    return orders(spark, d).take([40, 3, 40, 1]).numbered().select(c(POS).alias("place"), "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 11 AND 30")
def series_view(spark, d):
    return out(orders(spark, d)["o_orderkey"].view(11, 20).to_frame())


@query("SELECT CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS known, TRUE AS again")
def frame_sample(spark, d):
    """As many rows as asked for, none twice, all of the table, and the same for one seed."""
    f = orders(spark, d, "o_totalprice")
    a = f.sample(50, 7)
    known = out(a).join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey", "o_totalprice"]).distinct().count()
    return one_row(spark, n=len(a), known=known, again=a.equals(orders(spark, d, "o_totalprice").sample(50, 7)))


@query(f"SELECT event_id IS NULL AS event_id, user_id IS NULL AS user_id, v IS NULL AS v, v IS NOT NULL AS w FROM ({_GAPPY})")
def frame_isna_notna(spark, d):
    f = events(spark, d)
    gone, there = f.isna(), f.notna()
    return out(gone.assign("w", there["v"]))


@query(f"SELECT event_id, user_id, coalesce(v, -1) AS v FROM ({_GAPPY})")
def frame_fillna(spark, d):
    return out(events(spark, d).fillna({"v": -1.0}))


@query(f"SELECT event_id, user_id, v FROM ({_GAPPY}) WHERE v IS NOT NULL AND user_id IS NOT NULL")
def frame_dropna(spark, d):
    return out(events(spark, d).dropna())


@query(f"SELECT event_id, round(v * 3 + 1, 4) AS y, CAST(floor(v) AS BIGINT) + n AS z, CASE WHEN v IS NOT NULL THEN 'v' || CAST(event_id AS VARCHAR) END AS t FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ({_GAPPY}))")
def series_map(spark, d):
    """Functions of the value, of the value and its position, and with a type given; types are inferred from the first result."""
    f = events(spark, d)
    gone = f["v"].isna()
    text = Series.ifelse(gone, None, f["event_id"].map(lambda k: f"v{k}", "string"))
    f = f.with_columns({"y": f["v"].map(lambda v: v * 3 + 1), "z": f["v"].map(lambda v, i: int(v // 1) + i), "t": text})
    return out(f, "event_id", "y", "z", "t").withColumn("y", r(c("y")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE CAST(o_orderkey % 1000 AS BIGINT) END AS k FROM orders")
def series_combine_first(spark, d):
    f = orders(spark, d, "o_custkey")
    keys = Frame.of(table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 == 0, c("o_custkey")).alias("k"), (c("o_orderkey") % 1000).alias("other")), ["o_orderkey"])
    return out(f.assign("k", keys["k"].combine_first(keys["other"])), "o_orderkey", "k")


@query("SELECT TRUE AS same, FALSE AS other, TRUE AS column_same, FALSE AS longer, TRUE AS nan_same")
def frame_equals(spark, d):
    f, g = customers(spark, d, "c_acctbal"), customers(spark, d, "c_acctbal")
    changed = g.assign("c_acctbal", g["c_acctbal"] + 1)
    odd = odd_values(spark, d)
    return one_row(spark, same=f.equals(g), other=f.equals(changed), column_same=f["c_custkey"].equals(changed["c_custkey"]), longer=f.equals(concat([g, g])), nan_same=odd.equals(odd_values(spark, d)))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS "row", 'c_mktsegment' AS "column", c_mktsegment AS self, 'X' AS other FROM customer WHERE c_mktsegment = 'BUILDING'""".replace("SELECT row_number() OVER (ORDER BY c_custkey)", "SELECT n").replace("FROM customer", "FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)"))
def series_compare(spark, d):
    f = customers(spark, d, "c_mktsegment")
    other = Series.ifelse(f["c_mktsegment"].eq("BUILDING"), "X", f["c_mktsegment"])
    return out(f["c_mktsegment"].compare(other))


# predicates


@query(f"""SELECT event_id, x >= 30 AND NOT isnan(x) AS ge, x < 30 AND NOT isnan(x) AS lt, x <= 30 AND NOT isnan(x) AS le, x = 30 AND NOT isnan(x) AS eq, x <> 30 OR isnan(x) AS ne, x > 30 AND NOT isnan(x) AS gt,
x BETWEEN 20 AND 40 AND NOT isnan(x) AS b, x > 20 AND x < 40 AND NOT isnan(x) AS n, NOT (x > 30 AND NOT isnan(x)) AS inv FROM ({_ODD})""")
def series_comparisons(spark, d):
    f = odd_values(spark, d)
    x = f["x"]
    f = f.with_columns({"ge": x.ge(30.0), "lt": x.lt(30.0), "le": x.le(30.0), "eq": x.eq(30.0), "ne": x.ne(30.0), "gt": x.gt(30.0), "b": x.between(20.0, 40.0), "n": x.between(20.0, 40.0, "neither"), "inv": x.gt(30.0).lnot()})
    return out(f.drop_column("x"))


@query(f"SELECT count(*) FILTER (v > 30) AS n, bool_or(v > 30) AS some, bool_and(v > 30) AS every, bool_or(v < -1) AS none, bool_and(v > -1) AS whole FROM ({_GAPPY})")
def logic_reductions(spark, d):
    v = events(spark, d)["v"]
    high = v.gt(30.0)
    return one_row(spark, n=high.count_true(), some=high.any(), every=high.all(), none=v.lt(-1.0).any(), whole=v.gt(-1.0).all())


@query(f"""SELECT FALSE AS users_unique, TRUE AS ids_unique, (SELECT min(n) FROM g WHERE v IS NOT NULL) AS first, (SELECT max(n) FROM g WHERE v IS NOT NULL) AS last, TRUE AS strict, FALSE AS falling,
(SELECT count(DISTINCT v) FROM g) AS distinct_v, (SELECT count(v) FROM g) AS present, (SELECT 1 + count(*) FROM events WHERE event_id < 500) AS l, (SELECT 1 + count(*) FROM events WHERE event_id <= 500) AS rr""".replace("SELECT FALSE", f"WITH g AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ({_GAPPY})) SELECT FALSE"))
def series_facts(spark, d):
    f = events(spark, d)
    k, v = f["event_id"], f["v"]
    return one_row(
        spark, users_unique=f["user_id"].is_unique(), ids_unique=k.is_unique(), first=v.first_valid_index(), last=v.last_valid_index(), strict=k.is_monotonic_increasing(True), falling=k.is_monotonic_decreasing(),
        distinct_v=v.nunique(), present=v.count_nonnull(), l=k.searchsorted(500), rr=k.searchsorted(500, "right"),
    )


@query(f"SELECT event_id, v, row_number() OVER (PARTITION BY v ORDER BY event_id) > 1 AS again FROM ({_GAPPY})")
def series_duplicated(spark, d):
    f = events(spark, d)
    return out(f.assign("again", f["v"].duplicated()), "event_id", "v", "again")


@query(f"SELECT DISTINCT v FROM ({_GAPPY})")
def series_drop_duplicates(spark, d):
    return out(events(spark, d)["v"].drop_duplicates().to_frame())


# joins


@query("SELECT a.k AS k, a.n AS n, b.m AS m FROM (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'nan'::DOUBLE ELSE CAST(s_suppkey AS DOUBLE) END AS k, s_name AS n FROM supplier) a JOIN (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'nan'::DOUBLE ELSE CAST(n_nationkey AS DOUBLE) END AS k, n_name AS m FROM nation) b ON a.k = b.k")
def join_nan_keys(spark, d):
    nan = F.lit(float("nan"))
    a = Frame.of(table(spark, d, "supplier").select(F.when(c("s_suppkey") % 4 == 0, nan).otherwise(c("s_suppkey").cast("double")).alias("k"), c("s_name").alias("n")), ["n"])
    b = Frame.of(table(spark, d, "nation").select(F.when(c("n_nationkey") % 5 == 0, nan).otherwise(c("n_nationkey").cast("double")).alias("k"), c("n_name").alias("m")), ["m"])
    return out(a.join(b, "k"))


@query("SELECT CAST(0 AS BIGINT) AS matched, (SELECT count(*) FROM customer) AS kept, TRUE AS refused")
def join_key_rules(spark, d):
    """Keys of different types match nothing; an absent key is an error."""
    f = customers(spark, d, "c_acctbal")
    texts = customers(spark, d).astype({"c_custkey": "string"})
    gone = Frame.of(table(spark, d, "customer").select(F.when(c("c_custkey") > 1, c("c_custkey")).alias("c_custkey"), "c_name"), ["c_name"])
    try:
        f.join(gone, "c_custkey")
        refused = False
    except Exception:
        refused = True
    return one_row(spark, matched=len(f.join(texts, "c_custkey")), kept=len(f.join(texts, "c_custkey", "left")), refused=refused)


@query("SELECT row_number() OVER (ORDER BY c_custkey, o_orderkey) AS place, c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_order(spark, d):
    """Left rows in their order, partners in theirs."""
    f = customers(spark, d).join(orders(spark, d, "o_custkey"), ("c_custkey", "o_custkey"), "left")
    return f.numbered().select(c(POS).alias("place"), "c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, other, s_name FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem) JOIN (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity) AS other FROM lineitem) USING (l_orderkey, l_linenumber) JOIN supplier ON s_suppkey = l_suppkey")
def join_several_keys(spark, d):
    rows = table(spark, d, "lineitem")
    a = Frame.of(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])
    b = Frame.of(rows.select("l_orderkey", "l_linenumber", F.round("l_quantity").alias("other")), ["l_orderkey", "l_linenumber"])
    keys = ["l_orderkey", "l_linenumber"]
    f = join(a, b, left_on=keys, right_on=keys).join(Frame.of(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"]), ("l_suppkey", "s_suppkey"))
    return out(f, "l_orderkey", "l_linenumber", "l_partkey", "other", "s_name")


# groups


@query("SELECT o_orderpriority, CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, CAST(sum(o_custkey) AS BIGINT) AS o_custkey, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def groupby_default_columns(spark, d):
    return out(orders(spark, d, "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority").groupby("o_orderpriority").sum()).withColumn("o_totalprice", r(c("o_totalprice"), 2))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS rest, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS nth, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS top FROM orders")
def groupby_transform_function(spark, d):
    """Functions that return a value per row, in row order, or one for the group."""
    f = orders(spark, d, "o_orderpriority", "o_totalprice")
    g = f.groupby("o_orderpriority")
    rest, nth = g.transform(lambda v: v - v.mean(), "o_totalprice"), g.transform(lambda v: range(1, len(v) + 1), "o_totalprice", "int64")
    top = g.transform(lambda v: v.max(), "o_totalprice")
    keyed = [s.frame.assign(n, s).select(["o_orderkey", n]) for n, s in (("rest", rest), ("nth", nth), ("top", top))]
    return out(keyed[0].join(keyed[1], "o_orderkey").join(keyed[2], "o_orderkey")).withColumn("rest", r(c("rest")))


@query("SELECT 'all' AS g, round(median(l_extendedprice), 4) AS l_extendedprice, round(quantile_cont(l_quantity, 0.5), 4) AS l_quantity FROM lineitem")
def groupby_median_of_one_group(spark, d):
    """All rows in one group: the bins of the quantiles are what is shuffled."""
    f = Frame.of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").withColumn("g", F.lit("all")), ["l_orderkey", "l_linenumber"])
    g = f.groupby("g").median("l_extendedprice", "l_quantity")
    return out(g).select("g", r(c("l_extendedprice")).alias("l_extendedprice"), r(c("l_quantity")).alias("l_quantity"))


@query("SELECT o_orderpriority, median(o_totalprice) AS o_totalprice_median, CAST(count(*) AS DOUBLE) AS o_totalprice_count, CAST(max(o_custkey) AS DOUBLE) AS o_custkey_max FROM orders GROUP BY 1")
def groupby_agg_median(spark, d):
    return out(orders(spark, d, "o_custkey", "o_totalprice", "o_orderpriority").groupby("o_orderpriority").agg({"o_totalprice": ["median", "count"], "o_custkey": "max"}))


@query("SELECT o_orderkey, median(o_totalprice) OVER (PARTITION BY o_orderstatus) AS med FROM orders")
def groupby_transform_median(spark, d):
    f = orders(spark, d, "o_orderstatus", "o_totalprice")
    m = f.groupby("o_orderstatus").transform("median", "o_totalprice")
    return out(m.frame.assign("med", m), "o_orderkey", "med")


@query("SELECT o_orderstatus, CAST(0 AS BIGINT) AS z, CASE WHEN sum(o_orderkey % 2) % 2 = 1 THEN CAST(-1 AS BIGINT) ELSE 1 END AS s FROM orders GROUP BY 1")
def groupby_prod_hot(spark, d):
    """Three groups of all orders: with zeros among large factors the product is 0, of signs it is a sign."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (c("o_orderkey") % 5 * 1000).alias("z"), F.when(c("o_orderkey") % 2 == 1, -1).otherwise(1).cast("long").alias("s"))
    return out(Frame.of(rows, ["o_orderkey"]).groupby("o_orderstatus").prod("z", "s"))


# reductions


@query(f"SELECT round(sum(v), 2) AS total, CAST(-1 AS DOUBLE) AS with_absent, CAST(-1 AS DOUBLE) AS too_few, round(sum(v), 2) AS enough, CAST(5040 AS BIGINT) AS product, CAST(-1 AS BIGINT) AS product_absent FROM ({_GAPPY})")
def reduction_options(spark, d):
    """Results that are absent show as -1."""
    v = events(spark, d)["v"]
    shown = lambda x: float(-1 if x is None else round(x, 2))
    p = Series.of([7, 6, 5, 4, 3, 2, None])
    return one_row(spark, total=shown(v.sum()), with_absent=shown(v.sum(ignore_na=False)), too_few=shown(v.sum(min_count=10**9)), enough=shown(v.sum(min_count=2)), product=p.prod(), product_absent=int(-1 if p.prod(ignore_na=False) is None else 0))


@query("SELECT round(sum(o_totalprice * o_custkey), 0) AS dot, TRUE AS absent FROM orders")
def series_dot(spark, d):
    f, e = orders(spark, d, "o_custkey", "o_totalprice"), events(spark, d)
    return one_row(spark, dot=round(f["o_totalprice"].dot(f["o_custkey"]), 0), absent=e["v"].dot(e["event_id"]) is None)


_MEASURES = ("sum", "min", "max", "mean", "std", "var", "median", "skew", "kurtosis", "sem", "mad", "count_nonnull")
_DUCK = {"std": "stddev_samp({0})", "var": "var_samp({0})", "mean": "avg({0})", "skew": "skewness({0})", "sem": "stddev_samp({0}) / sqrt(count({0}))", "count_nonnull": "count({0})"}


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, " + ", ".join(f"round(CAST({_DUCK.get(m, m + '({0})').format(x)} AS DOUBLE), 3) AS {x}" for x in ("l_quantity", "l_discount")) + " FROM lineitem" for m in _MEASURES))
def frame_reductions(spark, d):
    f = Frame.of(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_orderkey", "l_linenumber"]).select(["l_quantity", "l_discount"])
    parts = [out(getattr(f, m)()).select(F.lit(m).alias("measure"), *[r(c(x), 3).alias(x) for x in ("l_quantity", "l_discount")]) for m in _MEASURES]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


@query("SELECT count(DISTINCT o_orderstatus) AS o_orderstatus, count(DISTINCT o_custkey) AS o_custkey FROM orders")
def frame_nunique(spark, d):
    n = orders(spark, d, "o_custkey", "o_orderstatus").select(["o_custkey", "o_orderstatus"]).nunique()
    return one_row(spark, **n)


@query("""SELECT count(*) AS n, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS statuses, (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top, (SELECT count(*) FROM orders GROUP BY o_orderstatus ORDER BY 1 DESC LIMIT 1) AS freq,
count(*) FILTER (o_totalprice > 150000) AS high, count(*) FILTER (NOT o_totalprice > 150000) AS low, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') AS first, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%gZ') AS last, round(quantile_cont(o_totalprice, 0.25), 2) AS q25 FROM orders""")
def frame_describe(spark, d):
    f = orders(spark, d, "o_totalprice", "o_orderstatus", "o_orderdate")
    x = f.assign("high", f["o_totalprice"].gt(150000.0)).describe()
    text = x["o_orderstatus"]
    return one_row(spark, n=text["count"], statuses=text["unique"], top=text["top"], freq=text["freq"], high=x["high"]["true"], low=x["high"]["false"], first=x["o_orderdate"]["min"], last=x["o_orderdate"]["max"], q25=round(x["o_totalprice"]["25%"], 2))


# positional functions of frames


@query("SELECT o_orderkey, abs(w) AS a, CAST(sum(k) OVER w AS BIGINT) AS s, min(k) OVER w AS lo, max(k) OVER w AS hi, k - lag(k) OVER w AS df, lag(k) OVER w AS sh FROM (SELECT o_orderkey, o_orderkey % 9 - 4 AS k, o_orderkey % 5 - 2 AS w FROM orders) WINDOW w AS (ORDER BY o_orderkey)")
def frame_positional(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (c("o_orderkey") % 9 - 4).alias("k"), (c("o_orderkey") % 5 - 2).alias("w"))
    f = Frame.of(rows, ["o_orderkey"])
    k = f.select(["k"])
    whole = f.select(["w"]).abs().rename({"w": "a"}).assign("o_orderkey", f["o_orderkey"])
    return out(whole.with_columns({"s": k.cumsum()["k"], "lo": k.cummin()["k"], "hi": k.cummax()["k"], "df": k.diff()["k"], "sh": k.shift()["k"]}), "o_orderkey", "a", "s", "lo", "hi", "df", "sh")


@query(f"SELECT event_id, least(greatest(v, 10), 40) AS cl, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ff, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf, CASE WHEN v < 0 THEN ceil(v - 0.5) ELSE floor(v + 0.5) END AS rd FROM ({_GAPPY})".replace("least(greatest(v, 10), 40)", "CASE WHEN v IS NOT NULL THEN least(greatest(v, 10), 40) END"))
def frame_fill_clip_round(spark, d):
    f = events(spark, d)
    v = f.select(["v"])
    return out(f.with_columns({"cl": v.clip(10.0, 40.0)["v"], "ff": v.ffill()["v"], "bf": v.bfill()["v"], "rd": v.round()["v"]}), "event_id", "cl", "ff", "bf", "rd")


@query("SELECT c_custkey, CAST(product(f) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS p FROM (SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN 2 WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS f FROM customer WHERE c_custkey <= 1500)".replace(" WHERE c_custkey <= 1500", ""))
def series_cumprod(spark, d):
    f = Frame.of(table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 31 == 0, 2).when(c("c_custkey") % 2 == 0, -1).otherwise(1).cast("long").alias("f")), ["c_custkey"])
    return out(f.assign("p", f["f"].cumprod()), "c_custkey", "p")


_WIN = "(ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query(f"""SELECT event_id, CASE WHEN n >= 4 AND count(v) OVER w >= 1 THEN round(sum(v) OVER w, 2) END AS s, CASE WHEN count(v) OVER w >= 2 THEN round(avg(v) OVER w, 4) END AS m, CASE WHEN n >= 4 AND count(v) OVER w >= 1 THEN round(var_samp(v) OVER w, 6) END AS vr,
CASE WHEN n >= 4 AND count(v) OVER w >= 1 THEN round(quantile_cont(v, 0.9) OVER w, 6) END AS q FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n FROM ({_GAPPY})) WINDOW w AS {_WIN}""")
def frame_rolling(spark, d):
    f = events(spark, d)
    roll = f.rolling(4)
    f = f.with_columns({"s": roll.sum("v"), "m": roll.min_periods(2).mean("v"), "vr": roll.var("v"), "q": roll.quantile("v", 0.9)})
    return out(f).select("event_id", r(c("s"), 2).alias("s"), r(c("m")).alias("m"), r(c("vr"), 6).alias("vr"), r(c("q"), 6).alias("q"))


@query(f"SELECT event_id, min(v) OVER w AS lo, CASE WHEN count(v) OVER w >= 2 THEN round(var_samp(v) OVER w, 4) END AS vr, CASE WHEN count(v) OVER w >= 2 THEN round(stddev_samp(v) OVER w, 4) END AS sd FROM ({_GAPPY}) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def series_expanding_spread(spark, d):
    f = events(spark, d)
    x = f["v"].expanding(0)
    return out(f.with_columns({"lo": x.min(), "vr": x.var(), "sd": x.std()})).select("event_id", "lo", r(c("vr")).alias("vr"), r(c("sd")).alias("sd"))


@query("SELECT c_custkey, median(c_acctbal) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS med FROM customer")
def series_expanding_median(spark, d):
    f = customers(spark, d, "c_acctbal")
    return out(f.assign("med", f["c_acctbal"].expanding().median()), "c_custkey", "med")


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place, c_acctbal, (SELECT count(*) FROM customer) - row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS behind FROM customer")
def series_sort(spark, d):
    f = customers(spark, d, "c_acctbal")["c_acctbal"].sort(asc=False).to_frame()
    n = len(f)
    return f.numbered().select(c(POS).alias("place"), "c_acctbal", (F.lit(n).cast("long") - c(POS)).alias("behind"))


@query("SELECT n AS position, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS place FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)")
def series_argsort(spark, d):
    order = customers(spark, d, "c_mktsegment")["c_mktsegment"].argsort()
    return spark.createDataFrame([(p, i + 1) for i, p in enumerate(order)], "position long, place long")


# arithmetic and conversions


@query("SELECT o_orderkey, o_orderkey + o_custkey AS s, o_orderkey - 7 AS df, o_custkey * 3 AS p, round(o_totalprice + o_custkey, 2) AS fs, round(2.5 * o_totalprice, 4) AS fp, 10 + o_custkey AS l, o_custkey % 2 = 0 OR o_orderkey % 3 = 0 AS either, o_custkey % 2 = 0 AND o_orderkey % 3 = 0 AS both, abs(o_custkey - 500) AS a FROM orders".replace("2.5 * o_totalprice", "o_totalprice * CAST(2.5 AS DOUBLE)"))
def series_arithmetic(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (c("o_custkey") % 2 == 0).alias("even"), (c("o_orderkey") % 3 == 0).alias("third"))
    f = Frame.of(rows, ["o_orderkey"])
    o, k, t = f["o_orderkey"], f["o_custkey"], f["o_totalprice"]
    f = f.with_columns({"s": o + k, "df": o - 7, "p": k * 3, "fs": t + k, "fp": 2.5 * t, "l": 10 + k, "either": f["even"] + f["third"], "both": f["even"] * f["third"], "a": (k - 500).abs()})
    return out(f).select("o_orderkey", "s", "df", "p", r(c("fs"), 2).alias("fs"), r(c("fp")).alias("fp"), "l", "either", "both", "a")


def _wrap_sql(x: str) -> str:
    return f"CAST(((({x}) + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808 AS BIGINT)"


@query(f"SELECT o_orderkey, {_wrap_sql('k + h')} AS s, {_wrap_sql('-k - h')} AS d, {_wrap_sql('k * 4611686018427387905')} AS p FROM (SELECT o_orderkey, CAST(o_custkey AS HUGEINT) * 4294967291 AS k, 9223372036854775000::HUGEINT AS h FROM orders)".replace("k * 4611686018427387905", "o_orderkey::HUGEINT * 4611686018427387905"))
def series_overflow(spark, d):
    """Whole numbers wrap around beyond 64 bits."""
    f = Frame.of(table(spark, d, "orders").select("o_orderkey", (c("o_custkey") * 4294967291).alias("k")), ["o_orderkey"])
    k = f["k"]
    return out(f.with_columns({"s": k + 9223372036854775000, "d": k * -1 - 9223372036854775000, "p": f["o_orderkey"] * 4611686018427387905}), "o_orderkey", "s", "d", "p")


@query("SELECT k, x FROM (VALUES (1, 26.0::DOUBLE), (2, 12.0), (3, -0.5), (4, NULL), (5, 255.9375), (6, NULL), (7, 1e3)) t(k, x)".replace("SELECT k,", "SELECT CAST(k AS BIGINT) AS k,"))
def csv_hexadecimal(spark, d):
    return read_csv_mem(spark, "k,x\n1,0x1A\n2,0x1.8p3\n3,-0X.8\n4,\n5,0xFF.F\n6,NA\n7,1e3\n", hexadecimal=True)


@query("SELECT event_id, round(cos(v), 8) AS cos, round(tan(v), 6) AS tan, isnan(x) AS bad FROM (SELECT event_id, abs(round(value, 2)) % 1.5 AS v, CASE WHEN event_id % 2 = 0 THEN 'nan'::DOUBLE ELSE 1 END AS x FROM events)")
def series_mathematics(spark, d):
    """The logarithm and root of a negative number are NaN."""
    rows = table(spark, d, "events").select("event_id", (F.abs(F.round("value", 2)) % 1.5).alias("v"), F.when(c("event_id") % 2 == 0, -1.0).otherwise(1.0).alias("s"))
    f = Frame.of(rows, ["event_id"])
    f = f.with_columns({"cos": f["v"].cos(), "tan": f["v"].tan(), "lg": f["s"].log(), "rt": f["s"].sqrt()})
    return out(f).select("event_id", r(c("cos"), 8).alias("cos"), r(c("tan"), 6).alias("tan"), (F.isnan("lg") & F.isnan("rt")).alias("bad"))


@query("""SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS fl, epoch_ms(o_orderdate) AS back, epoch_ms(o_orderdate) AS fback, CAST(b AS BIGINT) AS bi, CAST(b AS DOUBLE) AS bf, CAST(b AS VARCHAR) AS bs, b AS sb, CAST(NULL AS BOOLEAN) AS nb, b AS ib, b AS fb, o_orderkey AS same
FROM (SELECT *, o_custkey % 2 = 1 AS b FROM orders)""")
def astype_moments_and_flags(spark, d):
    f = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", c("o_orderdate").alias("t"), (c("o_custkey") % 2 == 1).alias("b")), ["o_orderkey"])
    t, b = f["t"], f["b"]
    ms, fl, bi, bf, bs = t.astype("int64"), t.astype("float64"), b.astype("int64"), b.astype("float64"), b.astype("string")
    f = f.with_columns({"ms": ms, "fl": fl, "back": ms.astype("datetime").astype("int64"), "fback": fl.astype("datetime").astype("int64"), "bi": bi, "bf": bf, "bs": bs, "sb": bs.astype("bool"), "nb": f["o_orderstatus"].astype("bool"), "ib": bi.astype("bool"), "fb": bf.astype("bool"), "same": f["o_orderkey"].astype("int64")})
    return out(f, "o_orderkey", "ms", "fl", "back", "fback", "bi", "bf", "bs", "sb", "nb", "ib", "fb", "same")


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS i, CAST(c_nationkey AS DOUBLE) AS fl, CAST(c_nationkey AS VARCHAR) AS s, code FROM (SELECT *, dense_rank() OVER (ORDER BY f) AS code FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f FROM customer))")
def astype_categorical(spark, d):
    f = customers(spark, d, "c_nationkey")
    k = f["c_nationkey"].astype("categorical")
    f = f.with_columns({"i": k.astype("int64"), "fl": k.astype("float64"), "s": k.astype("string"), "code": k.cat.codes()})
    return out(f, "c_custkey", "i", "fl", "s", "code")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer")
def astype_frame(spark, d):
    return out(customers(spark, d, "c_acctbal").astype({"c_custkey": "string", "c_acctbal": "int64"}))


@query("SELECT TRUE AS moment_to_flag, TRUE AS flag_to_moment, TRUE AS two_to_flag")
def astype_refusals(spark, d):
    """Conversions that are errors."""

    def refused(f: Callable) -> bool:
        try:
            f()
        except Exception:
            return True
        return False

    return one_row(spark, moment_to_flag=refused(lambda: Series.of([0], "datetime").astype("bool")), flag_to_moment=refused(lambda: Series.of([True]).astype("datetime")), two_to_flag=refused(lambda: Series.of([2]).astype("bool").to_table()))


# texts and moments


@query("""SELECT p_partkey, list_aggregate(list_transform(string_split(lower(t), ' '), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS title, translate(t, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS sw,
rpad(t, greatest(len(t), 40)::INT, '*') AS pr, repeat('-', (greatest(60 - len(t), 0) // 2)::INT) || t || repeat('-', (greatest(60 - len(t), 0) - greatest(60 - len(t), 0) // 2)::INT) AS pb, FALSE AS sp, TRUE AS bl, regexp_matches(t, '[a-z]') AND NOT regexp_matches(t, '[A-Z]') AS lo
FROM (SELECT p_partkey, p_type || ' x y' AS t FROM part)""")
def str_more(spark, d):
    f = Frame.of(table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" x y")).alias("t"), F.lit(" \t ").alias("blank")), ["p_partkey"])
    s = f["t"].str
    f = f.with_columns({"title": s.title(), "sw": s.swapcase(), "pr": s.pad(40, "right", "*"), "pb": s.pad(60, "both", "-"), "sp": s.isspace(), "bl": f["blank"].str.isspace(), "lo": s.islower()})
    return out(f, "p_partkey", "title", "sw", "pr", "pb", "sp", "bl", "lo")


@query("SELECT c_custkey, c_name || c_mktsegment AS both, split_part(c_name, '#', 1) AS \"1\", nullif(split_part(c_name, '#', 2), '') AS \"2\" FROM customer")
def str_split_frame(spark, d):
    f = customers(spark, d, "c_name", "c_mktsegment")
    parts = f["c_name"].str.split("#")
    joined = Frame.of(table(spark, d, "customer").select("c_custkey", F.concat("c_name", "c_mktsegment").alias("both")), ["c_custkey"])
    return out(joined.with_columns({"1": parts["1"], "2": parts["2"]}))


@query("SELECT string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation")
def str_cat(spark, d):
    return one_row(spark, names=Frame.of(table(spark, d, "nation"), ["n_nationkey"])["n_name"].str.cat("; "))


@query("""SELECT event_id, epoch_ms(date_trunc('day', t)::TIMESTAMP) AS nm, epoch_ms(t) + 5 AS a, epoch_ms(t) + 5000 AS b, epoch_ms(t) + 300000 AS cc, epoch_ms(t) - 7200000 AS e, epoch_ms(t) - epoch_ms(lag(t) OVER (ORDER BY event_id)) AS df, day(t) = 1 AS ms, t::DATE = last_day(t::DATE) AS me,
day(t) = 1 AND month(t) % 3 = 1 AS qs, t::DATE = last_day(t::DATE) AND month(t) % 3 = 0 AS qe, dayofyear(t) = 1 AS ys, month(t) = 12 AND day(t) = 31 AS ye FROM (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events)""")
def dt_more(spark, d):
    f = Frame.of(table(spark, d, "events").select("event_id", F.date_trunc("MILLISECOND", c("ts").cast("timestamp")).alias("t")), ["event_id"])
    t = f["t"].dt
    moments = {"nm": t.normalize(), "a": t.add_ms(5), "b": t.add_seconds(5), "cc": t.add_minutes(5), "e": t.add_hours(-2)}
    f = f.with_columns({n: s.astype("int64") for n, s in moments.items()} | {"df": t.diff(), "ms": t.is_month_start(), "me": t.is_month_end(), "qs": t.is_quarter_start(), "qe": t.is_quarter_end(), "ys": t.is_year_start(), "ye": t.is_year_end()})
    return out(f.drop_column("t"))


@query("SELECT epoch_ms(TIMESTAMP '2026-02-01 10:00:00') AS day_first, epoch_ms(TIMESTAMP '2026-01-02 10:00:00') AS month_first, '2026-02-01T10:00:00.000Z' AS text, epoch_ms(TIMESTAMP '2024-02-29 01:02:03.004') AS parts, TRUE AS none")
def dt_scalars(spark, d):
    first = Series.dt_parse("01/02/2026 10:00:00", True)
    return one_row(spark, day_first=first, month_first=Series.dt_parse("01/02/2026 10:00:00"), text=Series.dt_format(first), parts=Series.dt_from_parts(2024, 2, 29, 1, 2, 3, 4), none=Series.dt_from_parts(2023, 2, 29) is None)


# categorical columns


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS renamed, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS kept, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS without, c_mktsegment AS added,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'none' ELSE c_mktsegment END AS filled FROM customer""")
def categorical_levels(spark, d):
    f = customers(spark, d, "c_mktsegment").astype({"c_mktsegment": "categorical"})
    s = f["c_mktsegment"].cat
    f = f.with_columns({"renamed": s.rename_categories({"BUILDING": "HOUSES"}), "kept": s.set_categories(["BUILDING", "MACHINERY"]), "without": s.remove_categories(["BUILDING"]), "added": s.add_categories(["BOATS"]), "filled": s.remove_categories(["BUILDING"]).fillna("none")})
    return out(f.drop_column("c_mktsegment"))


@query("SELECT row_number() OVER (ORDER BY f) AS code, c_mktsegment AS level FROM (SELECT c_mktsegment, min(c_custkey) AS f FROM customer GROUP BY 1)")
def categorical_level_list(spark, d):
    levels = customers(spark, d, "c_mktsegment").astype({"c_mktsegment": "categorical"})["c_mktsegment"].cat.levels()
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(levels)], "code long, level string")


@query("SELECT CAST(i AS BIGINT) AS i, v FROM (VALUES (1, 'y'), (2, NULL), (3, 'x'), (4, 'y'), (5, 'z')) t(i, v)")
def categorical_from_codes(spark, d):
    s = Series.from_codes([2, None, 1, 2], ["x", "y"]).append("z")
    f = Frame.from_columns([("i", [1, 2, 3, 4, 5])], spark)
    return out(f.assign("v", s))


# small frames, cells and texts


@query("SELECT CAST(a AS BIGINT) AS a, b, CAST(d AS DOUBLE) AS d, e FROM (VALUES (1, 'x', 1.5, TRUE), (2, NULL, 2.0, NULL), (3, 'z', NULL, FALSE)) t(a, b, d, e)")
def frame_from_columns(spark, d):
    return out(Frame.from_columns([("a", [1, 2, 3]), ("b", ["x", None, "z"]), ("d", [1.5, 2, None]), ("e", [True, None, False])], spark))


@query("SELECT CAST(x AS BIGINT) AS x, y FROM (VALUES (1, NULL), (NULL, 'q'), (3, '4')) t(x, y)")
def frame_from_records(spark, d):
    return out(Frame.from_dict([{"x": 1}, {"y": "q"}, {"x": 3, "y": 4}], "records"))


@query("SELECT n_nationkey, n_name, r_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation) JOIN region ON n_regionkey = r_regionkey")
def frame_round_trips(spark, d):
    """A joined frame through rows, and through columns, of Python values."""
    f = Frame.of(table(spark, d, "nation"), ["n_nationkey"]).join(Frame.of(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]), ("n_regionkey", "r_regionkey"))
    rows = Frame.from_dict(f.to_table(), "records", f.columns)
    return out(Frame.from_dict(rows.to_dict(), "columns", f.columns), "n_nationkey", "n_name", "r_name")


@query("SELECT c_name AS name, CAST(c_acctbal AS DOUBLE) AS bal, c_mktsegment AS seg, TRUE AS gone, FALSE AS there, CAST(-5 AS DOUBLE) AS changed, TRUE AS emptied, CAST(9 AS DOUBLE) AS more, CAST(3 AS BIGINT) AS filled, (SELECT count(*) FROM customer) + 1 AS longer FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n = 7")
def frame_cells(spark, d):
    f = customers(spark, d, "c_name", "c_acctbal", "c_mktsegment")
    bal = f["c_acctbal"]
    longer = bal.append(9.0)
    n = len(f)
    return one_row(
        spark, name=f.at(7, "c_name"), bal=f.iat(7, 3), seg=f.row(7)["c_mktsegment"], gone=bal.set_null(7).is_null(7), there=bal.is_null(7), changed=bal.set(7, -5.0).get(7), emptied=Series.new(2, "int64").get_raw(1) is None, more=longer[n + 1],
        filled=Series.full(4, 3).at(4), longer=len(longer),
    )


_GRID = ["a  b", "1  x", "2  NA"]


@query("SELECT '" + "|".join(_GRID) + "' AS grid, '| a | b |' AS head")
def frame_texts(spark, d):
    f = Frame.from_columns([("a", [1, 2]), ("b", ["x", None])], spark)
    lines = [" ".join(line.split()) for line in f.to_string().split("\n")]
    return one_row(spark, grid="|".join(line.replace(" ", "  ") for line in lines), head=" ".join(f.to_markdown().split("\n")[0].split()))


# files


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_decimal_comma(spark, d):
    path = _folder(spark, "csv")
    customers(spark, d, "c_name", "c_acctbal").to_csv(path, sep=";", decimal=",")
    return read_csv(spark, path, sep=";", decimal=",")


@query("SELECT CAST(i AS BIGINT) AS i, b, CAST(x AS DOUBLE) AS x, s FROM (VALUES (1, TRUE, NULL, 'p,q'), (2, FALSE, 2.5, NULL), (NULL, TRUE, 300, 'two\nlines'), (4, NULL, -1, 'say \"x\"')) t(i, b, x, s)")
def csv_memory_vocabulary(spark, d):
    return read_csv_mem(spark, 'i,b,x,s\n1,true,NA,"p,q"\n2,FALSE,2.5,\nN/A,True,3e2,"two\nlines"\n4,null,-1,"say ""x"""\n')


@query("SELECT CAST(k AS BIGINT) AS k, v FROM (VALUES (1, 'NA'), (2, NULL)) t(k, v)")
def csv_own_vocabulary(spark, d):
    return read_csv_mem(spark, "k,v\n1,NA\n2,?\n", na_values=["?"])


@query("SELECT CAST(a AS BIGINT) AS a, b, d FROM (VALUES (1, 'x', NULL), (2, NULL, NULL), (3, 'y', 'z')) t(a, b, d)")
def csv_ragged_rows(spark, d):
    """Blank lines are skipped, short rows filled, further fields dropped."""
    path = _folder(spark, "ragged")
    spark.createDataFrame([("a,b,d\n1,x\n\n2\n3,y,z,w",)], "value string").coalesce(1).write.text(path)
    return read_csv(spark, path)


@query("SELECT TRUE AS warned, FALSE AS warned_in_vain, TRUE AS empty_refused, TRUE AS equal_refused")
def csv_warnings(spark, d):
    def warned(text: str) -> bool:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            read_csv_mem(spark, text)
        return any("separator" in str(w.message) for w in seen)

    def refused(*a: Any, **k: Any) -> bool:
        try:
            read_csv_mem(spark, *a, **k)
        except ValueError:
            return True
        return False

    return one_row(spark, warned=warned("a;b\n1;2\n"), warned_in_vain=warned("a\n1\n"), empty_refused=refused(""), equal_refused=refused("a\n1\n", sep=",", decimal=","))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_array_roundtrip(spark, d):
    """One file with a pretty-printed array, read as such."""
    path = _folder(spark, "json")
    customers(spark, d, "c_name", "c_acctbal").to_json(path, pretty=True)
    return read_json(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_nationkey, n_name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation)")
def json_memory_roundtrip(spark, d):
    return read_json_mem(spark, Frame.of(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).to_json_mem(pretty=True))


@query(f"SELECT count(*) FILTER (isnan(x)) AS n FROM ({_ODD})")
def json_non_finite(spark, d):
    return one_row(spark, n=count_non_finite(odd_values(spark, d).to_dataframe(False)))


def _csv_text(f: Frame) -> Sequence[str]:
    return f.to_csv_mem().strip("\n").split("\n")


@query("SELECT 'n_nationkey,n_name' AS head, (SELECT count(*) FROM nation) AS n, (SELECT CAST(n_nationkey AS VARCHAR) || ',' || n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS first")
def csv_memory_text(spark, d):
    lines = _csv_text(Frame.of(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]))
    return one_row(spark, head=lines[0], n=len(lines) - 1, first=lines[1])


# an operator added by a user


@query("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1")
def frame_extension(spark, d):
    """A frame class with a method of the user's, built from the library's own."""

    class Mine(Frame):
        def spread(self, key: str, name: str) -> Frame:
            return self.groupby(key).agg({name: ["max", "min"]}).assign("spread", lambda t: t[f"{name}_max"] - t[f"{name}_min"]).select([key, "spread"])

    return out(Mine.of(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"]).spread("o_custkey", "o_totalprice")).withColumn("spread", r(c("spread"), 2))
