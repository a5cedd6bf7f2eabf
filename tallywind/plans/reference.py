"""Queries over the star schema, one or more per operator family, and their SQL twins."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import casts, columns, dates, strings
from ..operators import ordered, relational, stats
from ..operators.groups import Groups
from ..operators.ordered import POS
from ..operators.quantiles import group_quantiles
from ..session import shared_dir
from ..sources.csv import infer_columns, read_csv, write_csv
from ..sources.json import read_json, write_json
from . import data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(x: Column, digits: int = 4) -> Column:
    return F.round(x.cast("double"), digits)


c = F.col

# events with absences, as the tables have none
_GAPPY = "SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS v FROM events"


def gappy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.when(c("event_id") % 7 != 0, F.round("value", 2)).alias("v"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    return ordered.number_rows(df, order)


# grouping


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, round(min(l_discount), 4) AS min_disc,
round(max(l_tax), 4) AS max_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def groupby_agg_pricing(spark, d):
    g = Groups(table(spark, d, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")), ["l_returnflag", "l_linestatus"])
    out = g.df.groupBy(*g.keys).agg(r(stats.total(c("l_quantity")), 2).alias("sum_qty"), r(stats.mean(c("l_extendedprice")), 2).alias("avg_price"), r(stats.minimum(c("l_discount"))).alias("min_disc"), r(stats.maximum(c("l_tax"))).alias("max_tax"), F.count("*").alias("n"))
    return out


@query("SELECT o_orderpriority, round(median(o_totalprice), 2) AS med, round(quantile_cont(o_totalprice, 0.9), 2) AS q90, round(stddev_samp(o_totalprice), 2) AS sd, round(sqrt(var_samp(o_totalprice)), 2) AS sv FROM orders GROUP BY 1")
def groupby_quantile_median(spark, d):
    g = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderkey"]).groupby("o_orderpriority")
    out = g.median("o_totalprice").rename({"o_totalprice": "med"})
    for name, other in (("q90", g.quantile(0.9, "o_totalprice")), ("sd", g.std("o_totalprice")), ("var", g.var("o_totalprice"))):
        out = out.join(other.rename({"o_totalprice": name}), "o_orderpriority")
    return out.to_dataframe(False).select("o_orderpriority", r(c("med"), 2).alias("med"), r(c("q90"), 2).alias("q90"), r(c("sd"), 2).alias("sd"), r(F.sqrt("var"), 2).alias("sv"))


@query("SELECT l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS quantile FROM lineitem GROUP BY 1")
def group_quantiles_exact(spark, d):
    return group_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5)


@query("""SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price, count(DISTINCT o_orderstatus) AS statuses,
CAST(product(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS p FROM orders GROUP BY 1""")
def groupby_first_last_nunique_prod_whole(spark, d):
    """All orders and all groups; the factors are 1 and -1, so that no group overflows."""
    o = table(spark, d, "orders").withColumn("f", F.when(c("o_orderkey") % 2 == 0, 1).otherwise(-1).cast("long"))
    g = Groups(o, "o_custkey", ["o_orderkey"])
    return g.df.groupBy("o_custkey").agg(stats.first(c("o_totalprice"), g.order).alias("first_price"), stats.last(c("o_totalprice"), g.order).alias("last_price"), stats.nunique(c("o_orderstatus")).alias("statuses"), stats.prod(c("f"), "int64").alias("p"))


@query("SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS mean_price FROM orders")
def groupby_transform_mean(spark, d):
    out = Groups(table(spark, d, "orders"), "o_orderpriority").transform("mean", "o_totalprice", "mean_price")
    return out.select("o_orderkey", r(c("mean_price"), 2).alias("mean_price"))


@query("SELECT c_mktsegment, round(CAST(sum(c_acctbal) AS DOUBLE), 2) AS c_acctbal_sum, CAST(count(DISTINCT c_nationkey) AS DOUBLE) AS c_nationkey_nunique, round(max(c_acctbal), 2) AS c_acctbal_max FROM customer GROUP BY 1")
def groupby_agg_spec(spark, d):
    out = Groups(table(spark, d, "customer"), "c_mktsegment").agg({"c_acctbal": ["sum", "max"], "c_nationkey": "nunique"})
    return out.withColumns({n: r(c(n), 2) for n in ("c_acctbal_sum", "c_acctbal_max")})


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def groupby_count(spark, d):
    return Groups(table(spark, d, "events"), "event_type").count()


@query("SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1")
def groupby_custom_aggregate(spark, d):
    out = Groups(table(spark, d, "customer"), "c_mktsegment").apply("c_acctbal", lambda v: float(v.max() - v.min()))
    return out.withColumn("c_acctbal", r(c("c_acctbal"), 2))


# joins


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner(spark, d):
    o = table(spark, d, "orders").where(columns.gt(c("o_totalprice"), 200000.0, True))
    out = relational.join(o, table(spark, d, "customer"), ("o_custkey", "c_custkey"))
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_whole(spark, d):
    out = relational.join(table(spark, d, "customer"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), "left")
    return out.select("c_custkey", "c_name", "o_orderkey")


@query("SELECT k, s.v AS v_right, n.v AS v_left FROM (SELECT CAST(s_nationkey AS BIGINT) AS k, s_name AS v FROM supplier) s LEFT JOIN (SELECT CAST(n_nationkey AS BIGINT) * 2 AS k, n_name AS v FROM nation) n USING (k)")
def join_right_suffixes(spark, d):
    n = table(spark, d, "nation").select((c("n_nationkey").cast("long") * 2).alias("k"), c("n_name").alias("v"))
    s = table(spark, d, "supplier").select(c("s_nationkey").cast("long").alias("k"), c("s_name").alias("v"))
    return relational.join(n, s, "k", "right")


@query("SELECT coalesce(a.k, b.k) AS k, a.x AS x, b.y AS y FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer) a FULL JOIN (SELECT s_suppkey * 40 AS k, s_name AS y FROM supplier) b ON a.k = b.k")
def join_outer(spark, d):
    """Some suppliers' keys lie within the customers', some beyond."""
    a = table(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_acctbal").alias("x"))
    b = table(spark, d, "supplier").select((c("s_suppkey") * 40).alias("k"), c("s_name").alias("y"))
    return relational.join(a, b, "k", "outer")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_star(spark, d):
    x = relational.join(table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), ("o_custkey", "c_custkey"))
    x = relational.join(x, table(spark, d, "nation"), ("c_nationkey", "n_nationkey"))
    x = relational.join(x, table(spark, d, "region"), ("n_regionkey", "r_regionkey"))
    return x.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), r(F.sum("o_totalprice"), 2).alias("total"))


# set operations and duplicates


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def concat_union_all(spark, d):
    a = table(spark, d, "supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("name"))
    b = table(spark, d, "customer").select(c("c_name").alias("name"), c("c_custkey").alias("k"))
    return relational.concat([a, b])


def _dups(keep: str) -> str:
    rank = "ASC" if keep == "first" else "DESC"
    return f"SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {rank}) AS n FROM events) WHERE n = 1"


@query(_dups("first"))
def drop_duplicates_first(spark, d):
    return relational.drop_duplicates(table(spark, d, "events"), ["event_id"], ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(_dups("last"))
def drop_duplicates_last(spark, d):
    return relational.drop_duplicates(table(spark, d, "events"), ["event_id"], ["user_id", "event_type"], "last").select("event_id", "user_id", "event_type")


@query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n = 1")
def drop_duplicates_none(spark, d):
    return relational.drop_duplicates(table(spark, d, "events"), ["event_id"], ["user_id", "event_type"], "none").select("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS duplicated FROM events")
def duplicated_mask(spark, d):
    return relational.duplicated(table(spark, d, "events"), ["event_id"], ["user_id"]).select("event_id", "duplicated")


# reshaping

_STATUS = ("F", "O", "P")


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O", round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P" FROM orders GROUP BY 1""")
def pivot_sum(spark, d):
    out = relational.pivot_table(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum", ["o_orderkey"], _STATUS)
    return out.select("o_orderpriority", *[r(c(s), 2).alias(s) for s in _STATUS])


@query("""SELECT o_custkey, arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS "F", arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS "O", arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_last(spark, d):
    return relational.pivot(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["o_orderkey"], _STATUS)


@query("""SELECT o_custkey, arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F') AS "F", arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'O') AS "O", arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def unstack_first(spark, d):
    return relational.unstack(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["o_orderkey"], _STATUS)


@query("SELECT p_partkey, 'p_name' AS variable, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part")
def melt_parts(spark, d):
    return relational.melt(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"])


@query("SELECT c_custkey, c_mktsegment, 'c_acctbal' AS variable, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'twice', c_acctbal * 2 FROM customer")
def stack_balances(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", (c("c_acctbal") * 2).alias("twice"))
    return relational.stack(t, ["c_acctbal", "twice"])


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def explode_embedding(spark, d):
    return relational.explode(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")


@query("""SELECT a.c_custkey, 'c_mktsegment' AS "column", a.c_mktsegment AS self, b.m AS other FROM customer a JOIN (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'X' ELSE c_mktsegment END AS m FROM customer) b USING (c_custkey) WHERE a.c_mktsegment IS DISTINCT FROM b.m""")
def compare_frames(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    b = a.withColumn("c_mktsegment", F.when(c("c_custkey") % 10 == 0, "X").otherwise(c("c_mktsegment")))
    return relational.compare(a, b, "c_custkey")


# positional functions over the whole table, in blocks


@query("SELECT event_id, lag(v) OVER w AS prev, lead(v, 2) OVER w AS after, round(v - lag(v) OVER w, 2) AS diff, CASE WHEN lag(v) OVER w <> 0 THEN round((v - lag(v) OVER w) / lag(v) OVER w, 6) END AS pct FROM (" + _GAPPY + ") WINDOW w AS (ORDER BY event_id)")
def shift_diff_pct(spark, d):
    f = Frame.of(gappy(spark, d), ["event_id"])
    v = f["v"]
    out = f.with_columns({"prev": v.shift(1), "after": v.shift(-2), "diff": v.diff(), "pct": v.pct_change()}).to_dataframe(False)
    return out.select("event_id", "prev", "after", r(c("diff"), 2).alias("diff"), r(c("pct"), 6).alias("pct"))


@query("SELECT event_id, CASE WHEN count(*) OVER w = count(v) OVER w THEN round(sum(v) OVER w, 2) END AS cumsum, min(v) OVER w AS lowest FROM (SELECT event_id, CASE WHEN event_id > (SELECT max(event_id) * 3 // 4 FROM events) AND event_id % 7 = 0 THEN NULL ELSE round(value, 2) END AS v FROM events) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cumsum_null_poison(spark, d):
    e = table(spark, d, "events")
    far = e.agg(F.max("event_id")).first()[0] * 3 // 4
    f = Frame.of(e.select("event_id", F.when(~((c("event_id") > far) & (c("event_id") % 7 == 0)), F.round("value", 2)).alias("v")), ["event_id"])
    out = f.with_columns({"cumsum": f["v"].cumsum(), "lowest": f["v"].expanding(0).min()}).to_dataframe(False)
    return out.select("event_id", r(c("cumsum"), 2).alias("cumsum"), "lowest")


@query("SELECT event_id, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS cummin, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS cummax FROM (" + _GAPPY + ") WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def cummin_cummax(spark, d):
    f = Frame.of(gappy(spark, d), ["event_id"])
    return f.with_columns({"cummin": f["v"].cummin(), "cummax": f["v"].cummax()}).to_dataframe(False).select("event_id", "cummin", "cummax")


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS f, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (" + _GAPPY + ")")
def ffill_bfill(spark, d):
    f = Frame.of(gappy(spark, d), ["event_id"])
    return f.with_columns({"f": f["v"].ffill(), "b": f["v"].bfill()}).to_dataframe(False).select("event_id", "f", "b")


_ROLL = "WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"""SELECT event_id, CASE WHEN rn >= 5 AND count(v) OVER w >= 1 THEN round(sum(v) OVER w, 2) END AS s, CASE WHEN rn >= 5 AND count(v) OVER w >= 1 THEN round(avg(v) OVER w, 4) END AS m, CASE WHEN count(v) OVER w >= 2 THEN min(v) OVER w END AS lo,
CASE WHEN count(v) OVER w >= 2 THEN max(v) OVER w END AS hi, CASE WHEN rn >= 5 AND count(v) OVER w >= 1 THEN count(v) OVER w END AS n, CASE WHEN rn >= 5 AND count(v) OVER w >= 1 THEN round(stddev_samp(v) OVER w, 3) END AS sd,
CASE WHEN rn >= 5 AND count(v) OVER w >= 1 THEN round(quantile_cont(v, 0.5) OVER w, 3) END AS med FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM ({_GAPPY})) {_ROLL}""")
def rolling_suite(spark, d):
    f = Frame.of(gappy(spark, d), ["event_id"])
    roll, two = f["v"].rolling(5), f["v"].rolling(5).min_periods(2)
    out = f.with_columns({"s": roll.sum(), "m": roll.mean(), "lo": two.min(), "hi": two.max(), "n": roll.count(), "sd": roll.std(), "med": roll.median()}).to_dataframe(False)
    return out.select("event_id", r(c("s"), 2).alias("s"), r(c("m")).alias("m"), "lo", "hi", "n", r(c("sd"), 3).alias("sd"), r(c("med"), 3).alias("med"))


@query("SELECT event_id, CAST(sum(k) OVER w AS BIGINT) AS s, CAST(sum(k) OVER w AS DOUBLE) / nullif(count(k) OVER w, 0) AS m, count(k) OVER w AS n, max(k) OVER w AS hi FROM (SELECT event_id, CAST(round(v * 100) AS BIGINT) AS k FROM (" + _GAPPY + ")) WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def expanding_suite(spark, d):
    f = Frame.of(gappy(spark, d).select("event_id", F.round(c("v") * 100).cast("long").alias("k")), ["event_id"])
    x = f["k"].expanding(0)
    return f.with_columns({"s": x.sum(), "m": x.mean(), "n": x.count(), "hi": x.max()}).to_dataframe(False).select("event_id", "s", "m", "n", "hi")


@query("SELECT event_id, user_id, lag(v) OVER w AS prev, round(sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS f FROM (" + _GAPPY + ") WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def windows_per_user(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return gappy(spark, d).select("event_id", "user_id", F.lag("v").over(w).alias("prev"), r(F.sum("v").over(w.rowsBetween(-2, 0)), 2).alias("s3"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"))


@query("""SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(rank() OVER (ORDER BY v) AS DOUBLE) END AS lo, CASE WHEN v IS NOT NULL THEN CAST(rank() OVER (ORDER BY v) + count(*) OVER (PARTITION BY v) - 1 AS DOUBLE) END AS hi,
CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 END AS average FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 0) END AS v FROM events)""".replace("ORDER BY v)", "ORDER BY v NULLS LAST)"))
def rank_methods(spark, d):
    f = Frame.of(table(spark, d, "events").select("event_id", F.when(c("event_id") % 7 != 0, F.round("value", 0)).alias("v")), ["event_id"])
    return f.with_columns({"lo": f["v"].rank("min"), "hi": f["v"].rank("max"), "average": f["v"].rank()}).to_dataframe(False).select("event_id", "lo", "hi", "average")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY round(value, 0), event_id) AS DOUBLE) AS rank FROM events")
def rank_first(spark, d):
    f = Frame.of(table(spark, d, "events").select("event_id", F.round("value", 0).alias("v")), ["event_id"])
    return f.assign("rank", f["v"].rank("first")).to_dataframe(False).select("event_id", "rank")


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 - 1) / ((SELECT count(*) FROM orders) - 1), 8) AS pct FROM (SELECT o_orderkey, round(o_totalprice, -3) AS p FROM orders)")
def pct_rank(spark, d):
    f = Frame.of(table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", -3).alias("p")), ["o_orderkey"])
    return f.assign("pct", f["p"].pct_rank()).to_dataframe(False).select("o_orderkey", r(c("pct"), 8).alias("pct"))


@query("SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 10")
def nlargest(spark, d):
    top = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])["o_totalprice"].nlargest(10)
    return spark.createDataFrame([(v,) for v in top], "o_totalprice double")


@query("SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 10")
def nsmallest(spark, d):
    low = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])["o_totalprice"].nsmallest(10)
    return spark.createDataFrame([(v,) for v in low], "o_totalprice double")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sort_by_price(spark, d):
    f = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"]).sort_by("o_totalprice")
    return f.numbered().select("o_orderkey", c(POS).alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS k FROM orders) WHERE n <= 5 OR n > k - 5 OR n BETWEEN 100 AND 110")
def head_tail_iloc(spark, d):
    f = Frame.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return f.head(5).concat([f.iloc(100, 110), f.tail(5)]).to_dataframe()


@query("SELECT s_suppkey, unnest(range(1, 1 + s_suppkey % 3)) AS copy FROM supplier")
def rep_each(spark, d):
    f = Frame.of(table(spark, d, "supplier").select("s_suppkey", (c("s_suppkey") % 3).alias("times")), ["s_suppkey"])
    place = f["s_suppkey"].rep_each(f["times"]).to_frame().groupby("s_suppkey").transform(lambda v: range(1, len(v) + 1), "s_suppkey", "int64")
    return place.frame.assign("copy", place).to_dataframe(False).select("s_suppkey", "copy")


# statistics


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@query("SELECT m AS mode FROM (SELECT round(value, 0) AS m, count(*) AS n, min(event_id) AS e FROM events GROUP BY 1 ORDER BY n DESC, e LIMIT 1)")
def mode_first(spark, d):
    return stats.mode(table(spark, d, "events").select("event_id", F.round("value", 0).alias("m")), "m", "event_id")


@query("SELECT DISTINCT event_type FROM events")
def unique_values(spark, d):
    return stats.unique(table(spark, d, "events"), "event_type", "event_id")


_STATS = """SELECT count(v) AS n, count(*) - count(v) AS nulls, round(sum(v), 2) AS total, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 4) AS lo, round(quantile_cont(v, 0.25), 4) AS q25, round(median(v), 4) AS q50, round(quantile_cont(v, 0.75), 4) AS q75, round(max(v), 4) AS hi,
round(skewness(v), 6) AS skew, round(kurtosis(v), 6) AS kurt, round(stddev_samp(v) / sqrt(count(v)), 8) AS sem, round(mad(v), 4) AS mad FROM (""" + _GAPPY + ")"


@query(_STATS)
def describe_numeric(spark, d):
    v = Frame.of(gappy(spark, d), ["event_id"])["v"]
    x = v.describe()
    row = {"n": x["count"], "nulls": x["nulls"], "total": round(v.sum(), 2), "mean": round(x["mean"], 6), "std": round(x["std"], 6), "lo": round(x["min"], 4), "q25": round(x["25%"], 4), "q50": round(x["50%"], 4), "q75": round(x["75%"], 4), "hi": round(x["max"], 4)}
    row |= {"skew": round(v.skew(), 6), "kurt": round(v.kurtosis(), 6), "sem": round(v.sem(), 8), "mad": round(v.mad(), 4)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'long' if n in ('n', 'nulls') else 'double'}" for n in row))


def _matrix_sql(f: str) -> str:
    names = ("l_quantity", "l_extendedprice", "l_discount")
    rows = [f"SELECT '{a}' AS __index__, " + ", ".join(f"round({f}({a}, {b}), 4) AS {b}" for b in names) + " FROM lineitem" for a in names]
    return " UNION ALL ".join(rows)


def _matrix(spark: SparkSession, d: str, kind: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return stats.matrix(table(spark, d, "lineitem"), names, kind).select("__index__", *[r(c(n)).alias(n) for n in names])


@query(_matrix_sql("corr"))
def corr_matrix(spark, d):
    return _matrix(spark, d, "corr")


@query(_matrix_sql("covar_samp"))
def cov_matrix(spark, d):
    return _matrix(spark, d, "cov")


@query("SELECT round(corr(v, p), 6) AS autocorr FROM (SELECT value AS v, lag(value) OVER (ORDER BY event_id) AS p FROM events)")
def autocorr(spark, d):
    value = Frame.of(table(spark, d, "events").select("event_id", "value"), ["event_id"])["value"]
    return spark.createDataFrame([(round(value.autocorr(), 6),)], "autocorr double")


@query("SELECT (SELECT n FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, value FROM events) ORDER BY value, n LIMIT 1) AS argmin, (SELECT n FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, value FROM events) ORDER BY value DESC, n LIMIT 1) AS argmax")
def argmin_argmax(spark, d):
    v = Frame.of(table(spark, d, "events").select("event_id", "value"), ["event_id"])["value"]
    return spark.createDataFrame([(v.argmin(), v.argmax())], "argmin long, argmax long")


# predicates and choice


@query("""SELECT event_id, value BETWEEN 10 AND 50 AS b, event_type IN ('click', 'view') AS i, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END) AND value > 20 AS a,
(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END) OR value > 20 AS o, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 2 = 0 END) <> (value > 20) AS x FROM events""")
def between_isin_kleene(spark, d):
    p = F.when(c("event_id") % 3 != 0, c("event_id") % 2 == 0)
    q = columns.gt(c("value"), 20.0, True)
    return table(spark, d, "events").select("event_id", columns.between(c("value"), 10.0, 50.0, "both", True).alias("b"), columns.isin(c("event_type"), ["click", "view", None]).alias("i"), columns.land(p, q).alias("a"), columns.lor(p, q).alias("o"), columns.lxor(p, q).alias("x"))


@query("SELECT event_id, CASE WHEN v > 30 THEN v ELSE -1 END AS w, CASE WHEN v > 30 THEN -1 ELSE v END AS m, CASE WHEN v > 30 THEN 'high' ELSE 'low' END AS i, coalesce(v, 0) AS f FROM (" + _GAPPY + ")")
def where_mask_ifelse_fillna(spark, d):
    cond = columns.gt(c("v"), 30.0, True)
    return gappy(spark, d).select("event_id", columns.where(c("v"), cond, -1.0).alias("w"), columns.mask(c("v"), cond, -1.0).alias("m"), columns.ifelse(cond, "high", "low").alias("i"), columns.fillna(c("v"), 0.0).alias("f"))


@query("SELECT event_id, v FROM (" + _GAPPY + ") WHERE v IS NOT NULL")
def dropna(spark, d):
    return Frame.of(gappy(spark, d), ["event_id"]).dropna(["v"]).to_dataframe(False).select("event_id", "v")


@query("SELECT bool_and(coalesce(o_orderkey >= p, TRUE)) AS increasing, 1 + count(*) FILTER (o_orderkey < 777) AS place FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def monotonic_searchsorted(spark, d):
    k = Frame.of(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])["o_orderkey"]
    return spark.createDataFrame([(k.is_monotonic_increasing(), k.searchsorted(777))], "increasing boolean, place long")


# arithmetic and mathematics


@query("SELECT event_id, round(sin(v), 8) AS sin, round(exp(v / 100), 6) AS exp, round(CASE WHEN v > 0 THEN ln(v) END, 8) AS ln, round(sqrt(v), 8) AS sqrt FROM (SELECT event_id, abs(round(value, 2)) + 1 AS v FROM events)")
def math_suite(spark, d):
    v = F.abs(F.round(c("value"), 2)) + 1
    return table(spark, d, "events").select("event_id", r(columns.sin(v), 8).alias("sin"), r(columns.exp(v / 100), 6).alias("exp"), r(columns.log(v), 8).alias("ln"), r(columns.sqrt(v), 8).alias("sqrt"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice < 0 THEN ceil(l_extendedprice * 10 - 0.5) / 10 ELSE floor(l_extendedprice * 10 + 0.5) / 10 END AS rounded, least(greatest(l_extendedprice, 1000), 50000) AS clipped FROM lineitem")
def round_clip(spark, d):
    x = c("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", columns.round_half_away(x, 1).alias("rounded"), columns.clip(x, 1000.0, 50000.0).alias("clipped"))


@query("SELECT o_orderkey, o_orderkey // nullif(o_custkey % 5, 0) AS f, round(o_orderkey / nullif(o_custkey % 5, 0), 8) AS t FROM orders")
def floordiv_truediv(spark, d):
    k = c("o_custkey") % 5
    return table(spark, d, "orders").select("o_orderkey", columns.floordiv(c("o_orderkey"), k).alias("f"), r(columns.div(c("o_orderkey"), k), 8).alias("t"))


# texts


@query("SELECT p_partkey, CAST(strlen(p_name) AS BIGINT) AS n, upper(p_name) AS u, lower(p_name) AS l, upper(p_name[1]) || lower(p_name[2:]) AS cap FROM part")
def str_case(spark, d):
    s = c("p_name")
    return table(spark, d, "part").select("p_partkey", strings.length(s).alias("n"), strings.upper(s).alias("u"), strings.lower(s).alias("l"), strings.capitalize(s).alias("cap"))


@query("SELECT p_partkey, contains(p_name, 'a') AS has, starts_with(p_name, 'P') AS starts, suffix(p_name, '1') AS ends, CAST(instr(p_name, 'a') AS BIGINT) AS at, replace(p_name, 'a', 'oo') AS rep, CAST(len(p_name) - len(replace(p_name, 'a', '')) AS BIGINT) AS n FROM part")
def str_search(spark, d):
    s = c("p_name")
    return table(spark, d, "part").select("p_partkey", strings.contains(s, "a").alias("has"), strings.startswith(s, "P").alias("starts"), strings.endswith(s, "1").alias("ends"), strings.find(s, "a").alias("at"), strings.replace(s, "a", "oo").alias("rep"), strings.count(s, "a").alias("n"))


@query("SELECT c_custkey, substr(c_name, 2, 4) AS s, right(c_name, 3) AS e, repeat(' ', greatest(0, 30 - len(c_name))) || c_name AS p, repeat('0', greatest(0, 10 - len(CAST(c_custkey AS VARCHAR)))) || CAST(c_custkey AS VARCHAR) AS z, c_name || '-' || c_name AS r FROM customer")
def str_slice_pad(spark, d):
    s = c("c_name")
    return table(spark, d, "customer").select("c_custkey", strings.slice_bytes(s, 2, 5).alias("s"), strings.slice_bytes(s, -3).alias("e"), strings.pad(s, 30).alias("p"), strings.zfill(c("c_custkey").cast("string"), 10).alias("z"), strings.rep(s, 2, "-").alias("r"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS a, nullif(split_part(c_name, '#', 2), '') AS b FROM customer")
def str_split(spark, d):
    parts = strings.split(c("c_name"), "#", 1)
    return table(spark, d, "customer").select("c_custkey", F.get(parts, 0).alias("a"), F.get(parts, 1).alias("b"))


@query("SELECT p_partkey, regexp_full_match(p_brand, '[0-9]+') AS d, regexp_full_match(p_brand, '[A-Za-z]+') AS a, regexp_full_match(p_brand, '[A-Za-z0-9]+') AS an, regexp_matches(p_type, '[A-Z]') AND NOT regexp_matches(p_type, '[a-z]') AS up FROM part")
def str_predicates(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.isdigit(c("p_brand")).alias("d"), strings.isalpha(c("p_brand")).alias("a"), strings.isalnum(c("p_brand")).alias("an"), strings.isupper(c("p_type")).alias("up"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand') THEN p_brand[6:] ELSE p_brand END AS nop, CASE WHEN suffix(p_brand, '1') THEN p_brand[:-2] ELSE p_brand END AS nos, trim('  ' || p_name || ' ') AS st FROM part")
def str_affix(spark, d):
    s = c("p_brand")
    return table(spark, d, "part").select("p_partkey", strings.removeprefix(s, "Brand").alias("nop"), strings.removesuffix(s, "1").alias("nos"), strings.strip(F.concat(F.lit("  "), c("p_name"), F.lit(" "))).alias("st"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def str_join(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(strings.join_rows(c("n_name"), c("n_nationkey"), ",").alias("names"))


# moments


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", c("o_orderdate").cast("timestamp").alias("t"))


def _event_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_trunc("MILLISECOND", c("ts").cast("timestamp")).alias("t"))


@query("SELECT event_id, year(t) AS y, month(t) AS mo, day(t) AS d, hour(t) AS h, minute(t) AS mi, CAST(second(t) AS BIGINT) AS s, CAST(epoch_ms(t) % 1000 AS BIGINT) AS ms, isodow(t) - 1 AS wd, dayofyear(t) AS yd, quarter(t) AS q, week(t) AS w FROM (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events)")
def dt_components(spark, d):
    t = c("t")
    names = {"y": dates.year, "mo": dates.month, "d": dates.day, "h": dates.hour, "mi": dates.minute, "s": dates.second, "ms": dates.ms, "wd": dates.weekday, "yd": dates.yearday, "q": dates.quarter, "w": dates.week}
    return _event_times(spark, d).select("event_id", *[f(t).alias(n) for n, f in names.items()])


@query("SELECT event_id, " + ", ".join(f"epoch_ms(CAST(date_trunc('{u}', ts) AS TIMESTAMP)) AS {n}" for n, u in (("hh", "hour"), ("dd", "day"), ("ww", "week"), ("mm", "month"), ("qq", "quarter"), ("yy", "year"))) + " FROM events")
def dt_truncate(spark, d):
    return _event_times(spark, d).select("event_id", *[F.unix_millis(dates.truncate(c("t"), u)).alias(n) for n, u in (("hh", "h"), ("dd", "D"), ("ww", "W"), ("mm", "M"), ("qq", "Q"), ("yy", "Y"))])


@query("""SELECT event_id, CASE WHEN hs = t THEN epoch_ms(t) ELSE epoch_ms(hs) + 3600000 END AS up, CASE WHEN ms = t THEN epoch_ms(t) ELSE epoch_ms(CAST(ms + INTERVAL 1 MONTH AS TIMESTAMP)) END AS up_month,
CASE WHEN epoch_ms(t) - epoch_ms(ds) < 43200000 THEN epoch_ms(ds) ELSE epoch_ms(ds) + 86400000 END AS near FROM
(SELECT event_id, t, date_trunc('hour', t) AS hs, CAST(date_trunc('month', t) AS TIMESTAMP) AS ms, CAST(date_trunc('day', t) AS TIMESTAMP) AS ds FROM (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events))""")
def dt_ceil_round(spark, d):
    t = c("t")
    return _event_times(spark, d).select("event_id", F.unix_millis(dates.ceil(t, "h")).alias("up"), F.unix_millis(dates.ceil(t, "M")).alias("up_month"), F.unix_millis(dates.round_to(t, "D")).alias("near"))


@query("""SELECT o_orderkey, epoch_ms(t) + 86400000 * 3 AS later, day(t) = 1 AS ms, t::DATE = last_day(t::DATE) AS me, day(t) = 1 AND month(t) % 3 = 1 AS qs, month(t) = 12 AND day(t) = 31 AS ye, (year(t) % 4 = 0 AND year(t) % 100 <> 0) OR year(t) % 400 = 0 AS leap,
day(last_day(t::DATE)) AS dim, monthname(t) AS mn, dayname(t) AS dn FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)""")
def dt_shift_flags(spark, d):
    t = c("t")
    return _orders(spark, d).select("o_orderkey", F.unix_millis(dates.add_days(t, 3)).alias("later"), dates.is_month_start(t).alias("ms"), dates.is_month_end(t).alias("me"), dates.is_quarter_start(t).alias("qs"), dates.is_year_end(t).alias("ye"), dates.is_leap_year(t).alias("leap"), dates.days_in_month(t).alias("dim"), dates.month_name(t).alias("mn"), dates.day_name(t).alias("dn"))


@query("SELECT event_id, strftime(t, '%d/%m/%Y %H:%M:%S 100%%') AS a, strftime(t, '%j %I %p %b %a %y') AS b, strftime(t, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events)")
def dt_strftime(spark, d):
    t = c("t")
    return _event_times(spark, d).select("event_id", dates.strftime(t, "%d/%m/%Y %H:%M:%S 100%%").alias("a"), dates.strftime(t, "%j %I %p %b %a %y").alias("b"), dates.iso(t).alias("iso"))


# conversions and files


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(trunc(l_extendedprice) AS BIGINT) AS i, CAST(l_orderkey AS DOUBLE) AS f, CAST(l_orderkey AS VARCHAR) AS s, TRY_CAST('00' || CAST(l_partkey AS VARCHAR) AS BIGINT) AS back,
TRY_CAST(CAST(l_suppkey AS VARCHAR) || '.5' AS DOUBLE) AS half, CAST(l_linenumber % 2 AS BOOLEAN) AS b, NULL::BIGINT AS none FROM lineitem""")
def astype_matrix(spark, d):
    k = c("l_orderkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", casts.cast(c("l_extendedprice"), "float64", "int64").alias("i"), casts.cast(k, "int64", "float64").alias("f"), casts.cast(k, "int64", "string").alias("s"),
        casts.cast(F.concat(F.lit("00"), c("l_partkey").cast("string")), "string", "int64").alias("back"), casts.cast(F.concat(c("l_suppkey").cast("string"), F.lit(".5")), "string", "float64").alias("half"),
        casts.cast((c("l_linenumber") % 2).cast("long"), "int64", "bool").alias("b"), casts.cast(c("l_returnflag"), "string", "int64").alias("none"),
    )


@query(data.moment_sql("cotacoes", "quote_id"))
def dt_parse_whole(spark, d):
    """Every row, whatever the spelling; null where the text is no moment."""
    return table(spark, d, "cotacoes").select("quote_id", dates.parse_moment_ms(c("timestamp")).alias("ms"))


@query("SELECT event_id, dense_rank() OVER (ORDER BY f) AS code FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def categorical_codes(spark, d):
    f = Frame.of(table(spark, d, "events").select("event_id", "event_type"), ["event_id"]).astype({"event_type": "categorical"})
    return f.assign("code", f["event_type"].cat.codes()).to_dataframe(False).select("event_id", "code")


@query("SELECT mes_comp, n_pedido, qtd_un, TRY_CAST(replace(CASE WHEN valor_rs IN ('', 'NA', 'null', 'N/A', 'NULL') OR contains(valor_rs, '.') THEN NULL ELSE valor_rs END, ',', '.') AS DOUBLE) AS valor FROM pedidos")
def decimal_comma(spark, d):
    s = F.when(~c("valor_rs").isin("", "NA", "null", "N/A", "NULL") & ~c("valor_rs").contains("."), F.replace(c("valor_rs"), F.lit(","), F.lit(".")))
    return table(spark, d, "pedidos").select("mes_comp", "n_pedido", "qtd_un", casts.to_float(s).alias("valor"))


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, d):
    path = _folder(spark, "csv")
    write_csv(table(spark, d, "customer"), path)
    return read_csv(spark, path)


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_roundtrip(spark, d):
    path = _folder(spark, "json")
    write_json(table(spark, d, "customer"), path)
    return read_json(spark, path, lines=True)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def infer_types(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").cast("string"), c("o_totalprice").cast("string"), "o_orderstatus")
    return infer_columns(o)
