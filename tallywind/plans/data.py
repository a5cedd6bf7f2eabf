"""Queries on the quote tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import DAY_MS, parse_moment_ms
from ..operators.anomalies import flag_implausible
from ..operators.grid import regular_grid
from ..operators.profile import changed_loads, differing_loads, profile_loads
from ..operators.rowparse import Field, parse_rows
from ..operators.trailing import trailing_totals
from ..session import evaluated, materialize

QUOTE_FIELDS = (Field("timestamp", "moment"), Field("asset", "string"), Field("price", "double"), Field("volume", "bigint"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moments(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns of quote rows and their moment `ms`; rows without a moment are left out."""
    return evaluated(rows, keep, [parse_moment_ms(F.col("timestamp")).alias("ms")]).where(F.col("ms").isNotNull())


def known_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The rows of cotacoes with a known asset and a moment."""
    rows = moments(table(spark, d, "cotacoes"), ["quote_id", "asset", "price", "volume"])
    return rows.join(table(spark, d, "ativos").select("asset"), "asset")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    quotes = known_quotes(spark, d).select(F.concat(F.lit("cotacoes/"), "asset").alias("source"), "quote_id", "ms", "price", "volume")
    feed = moments(table(spark, d, "cotacoes_shib_brl"), ["quote_id", "price", "volume"]).withColumn("source", F.lit("cotacoes_shib_brl/SHIB_BRL"))
    return flag_implausible(quotes.unionByName(feed))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).select("quote_id", "field")


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The flags that SQL can express: all but spikes of prices."""
    flags = p2_flags(spark, d).select("quote_id", "field", F.explode(F.split("reasons", ",")).alias("reason"))
    return flags.where(~((F.col("field") == "price") & (F.col("reason") == "spike")))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    assets = table(spark, d, "ativos")
    steps = assets.select(F.lit("cotacoes").alias("tbl"), "asset", F.col("grid_min").alias("step_min"))
    steps = steps.unionByName(assets.where(F.col("asset") == "SHIB_BRL").select(F.lit("cotacoes_shib_brl").alias("tbl"), "asset", F.col("feed_grid_min").alias("step_min")))
    quotes = moments(table(spark, d, "cotacoes"), ["asset", "price"]).withColumn("tbl", F.lit("cotacoes"))
    feed = moments(table(spark, d, "cotacoes_shib_brl"), ["price"]).withColumns({"tbl": F.lit("cotacoes_shib_brl"), "asset": F.lit("SHIB_BRL")})
    return regular_grid(quotes.unionByName(feed).join(steps, ["tbl", "asset"]), ["tbl", "asset"], "ms", "price", "step_min")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where(F.col("status") != "observed").select("tbl", "asset", "slot_epoch")


def p3_observed(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).where(F.col("status") == "observed").select("tbl", "asset", "slot_epoch", "readings")


_OFF_TIES = 3.3e-10


def leading_digits(x: Column, digits: int = 8) -> Column:
    """x scaled to one digit before the point and rounded: sums in another order give the same number, also where it would be a tie."""
    return F.when(x == 0, F.lit(0.0)).when(F.abs(x) < float("inf"), F.round(x / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x)))) + _OFF_TIES, digits)).otherwise(x)


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    """The interpolated values."""
    return p3_grid(spark, d).where(F.col("status") == "filled").select("tbl", "asset", "slot_epoch", leading_digits(F.col("value")).alias("value"))


def p3_means(spark: SparkSession, d: str) -> DataFrame:
    """The means of the periods with readings."""
    return p3_grid(spark, d).where(F.col("status") == "observed").select("tbl", "asset", "slot_epoch", leading_digits(F.col("value")).alias("value"))


def p4_trailing(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_from_unix_date(F.floor(F.col("ms") / DAY_MS).cast("int"))
    rows = known_quotes(spark, d).withColumn("day", day)
    out = trailing_totals(rows, ["asset"], "day", ["volume", "price"], F.col("volume") > 0)
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumns({c: F.round(c, 6) for c in ("volume_avg",)})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_trailing(spark, d).where(F.col("active_rows") == 0).select("asset", "day", "span_days")


def p4_volume(spark: SparkSession, d: str) -> DataFrame:
    return p4_trailing(spark, d).select("asset", "day", "span_days", "active_rows", "active_days", "volume_total")


def p4_averages(spark: SparkSession, d: str) -> DataFrame:
    found = p4_trailing(spark, d)
    return found.select("asset", "day", "span_days", *[leading_digits(F.col(c)).alias(c) for c in ("price_total", "price_avg", "volume_avg")])


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "cotacoes_raw").where(F.col("line_no") != 1)
    return parse_rows(lines, "raw_line", QUOTE_FIELDS, ["line_id"])


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    good = p5_records(spark, d).where(F.col("reason").isNull())
    return good.select("line_id", F.unix_millis("timestamp").alias("ms"), "asset", "price", "volume")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_records(spark, d).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p6_profile(spark: SparkSession, d: str, two_sample: bool = True) -> DataFrame:
    return profile_loads(table(spark, d, "cotacoes"), table(spark, d, "ativos"), key=["quote_id"], two_sample=two_sample)


def p6_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """The exact aggregates of the profile, without the two-sample test."""
    shares = ("price_absent", "volume_absent", "asset_absent", "unknown_share", "volume_ratio")
    return p6_profile(spark, d, two_sample=False).select("load_id", "n", *[F.round(c, 9).alias(c) for c in shares], "asset_distinct", "volume_min", "volume_max")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return differing_loads(materialize(p6_profile(spark, d, two_sample=False), "profile"))


def p6_changed(spark: SparkSession, d: str) -> DataFrame:
    """The loads that the two-sample test tells apart: not a list of TESTDATA, whose cases (p6_found) are all exact aggregates."""
    return changed_loads(materialize(p6_profile(spark, d), "profile"))


QUERIES = {f.__name__: f for f in (p2_found, p2_flags, p2_exact, p3_found, p3_grid, p3_observed, p3_filled, p3_means, p4_found, p4_trailing, p4_volume, p4_averages, p5_found, p5_rows, p6_found, p6_profile, p6_aggregates, p6_changed)}

_CLOCK = r"([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]*)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?)?"
_DATES = "|".join(rf"[0-9]{{4}}{x}[0-9]{{2}}{x}[0-9]{{2}}|[0-9]{{1,2}}{x}[0-9]{{1,2}}{x}[0-9]{{4}}" for x in "-/")


def moment_sql(source: str, keep: str) -> str:
    """SELECT of the keep columns and ms, the epoch milliseconds of "timestamp" (NULL where it is no moment)."""
    offset = r"[+-][0-9]{2}:?[0-9]{2}$"
    minutes = rf"(CAST(substr(regexp_extract(t, '{offset}'), 2, 2) AS BIGINT) * 60 + CAST(right(t, 2) AS BIGINT)) * CASE WHEN regexp_extract(t, '{offset}')[1] = '-' THEN -1 ELSE 1 END"
    return rf"""SELECT {keep}, CASE WHEN good AND day IS NOT NULL THEN epoch_ms(CAST(day AS TIMESTAMP)) + CASE WHEN t = '' THEN 0 ELSE
(CAST(substr(t, 1, 2) AS BIGINT) * 3600 + CAST(substr(t, 4, 2) AS BIGINT) * 60 + CAST(substr(t, 7, 2) AS BIGINT)) * 1000 + CAST(rpad(substr(regexp_extract(t, '\.([0-9]*)', 1), 1, 3), 3, '0') AS BIGINT)
- CASE WHEN regexp_matches(t, '{offset}') THEN {minutes} ELSE 0 END * 60000 END END AS ms
FROM (SELECT *, regexp_full_match("timestamp", '({_DATES}){_CLOCK}') AS good, regexp_extract("timestamp", '[T ](.*)$', 1) AS t,
TRY_CAST(regexp_replace(regexp_replace(regexp_extract("timestamp", '^[0-9/-]+'), '^([0-9]+)[-/]([0-9]+)[-/]([0-9]{{4}})$', '\3-\2-\1'), '/', '-', 'g') AS DATE) AS day FROM {source})"""


_F = r'(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_ROW = f"^({_F}),({_F}),({_F}),({_F})$"
_B = r"[ \t\n\x0b\f\r]*"
_MISSING = "('', 'NA', 'null', 'N/A', 'NULL')"
_VALUE = "CASE WHEN starts_with({0}, '\"') THEN replace({0}[2:-2], '\"\"', '\"') ELSE {0} END"

_RECORDS = rf"""WITH l AS (SELECT line_id, regexp_replace(raw_line, '\r$', '') AS l FROM cotacoes_raw WHERE line_no <> 1 AND NOT regexp_full_match(raw_line, '[\r\n]*')),
s AS (SELECT *, regexp_full_match(l, '{_F}(?:,{_F})*') AS quoted, regexp_full_match(l, '{_F}(?:,{_F}){{3}}') AS four, regexp_extract(l, '{_ROW}', ['a', 'b', 'c', 'd']) AS x FROM l),
v AS (SELECT line_id, quoted, four, {_VALUE.format("x.a")} AS "timestamp", {_VALUE.format("x.b")} AS a, {_VALUE.format("x.c")} AS p, {_VALUE.format("x.d")} AS q FROM s),
m AS ({moment_sql("v", 'line_id, quoted, four, "timestamp", a, p, q')}),
k AS (SELECT line_id, "timestamp", ms, a, p, q, CASE WHEN NOT quoted THEN 'bad_quoting' WHEN NOT four THEN 'column_count' WHEN "timestamp" NOT IN {_MISSING} AND ms IS NULL THEN 'bad_timestamp'
WHEN p NOT IN {_MISSING} AND NOT (regexp_full_match(p, '{_B}[+-]?(?i:nan|inf)') OR (regexp_full_match(p, '{_B}[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') AND coalesce(abs(TRY_CAST(trim(p) AS DOUBLE)) < 'inf'::DOUBLE, FALSE))) THEN 'bad_price'
WHEN q NOT IN {_MISSING} AND NOT (regexp_full_match(q, '{_B}[+-]?[0-9]+') AND TRY_CAST(trim(q) AS BIGINT) IS NOT NULL) THEN 'bad_volume' END AS reason FROM m)"""

_READINGS = rf"""r AS (SELECT 'q' || asset AS src, quote_id, ms, price, volume FROM ({moment_sql("cotacoes", "quote_id, asset, price, volume")}) WHERE ms IS NOT NULL AND asset IN (SELECT asset FROM ativos)
UNION ALL SELECT 'f', quote_id, ms, price, volume FROM ({moment_sql("cotacoes_shib_brl", "quote_id, price, volume")}) WHERE ms IS NOT NULL)"""


def _stuck_sql(field: str, present: str) -> str:
    """Values of a field in runs of 20 or more equal ones."""
    runs = f"SELECT *, sum(CAST({field} IS DISTINCT FROM last AS INTEGER)) OVER (PARTITION BY src ORDER BY ms, quote_id) AS run FROM (SELECT *, lag({field}) OVER (PARTITION BY src ORDER BY ms, quote_id) AS last FROM r WHERE {present})"
    return f"SELECT quote_id, '{field}' AS field, 'stuck' AS reason FROM (SELECT quote_id, {field}, count(*) OVER (PARTITION BY src, run) AS n FROM ({runs})) WHERE n >= 20"


def _digits_sql(x: str) -> str:
    """The twin of leading_digits."""
    return f"CASE WHEN ({x}) = 0 THEN 0 WHEN isfinite({x}) THEN round(({x}) / pow(10, floor(log10(abs({x})))) + {_OFF_TIES}, 8) ELSE {x} END"


def _inner_sql(h0: str, h1: str, d0: str, d1: str) -> str:
    w0, w1 = f"(2 * {h1} + {h0})", f"({h1} + 2 * {h0})"
    return f"CASE WHEN {d0} * {d1} <= 0 THEN 0 ELSE ({w0} + {w1}) / ({w0} / {d0} + {w1} / {d1}) END"


def _end_sql(h0: str, h1: str, d0: str, d1: str) -> str:
    m = f"(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"
    return f"CASE WHEN {m} * {d0} <= 0 THEN 0 WHEN {d0} * {d1} <= 0 AND abs({m}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {m} END"


_KNOTS = rf"""WITH r AS ({moment_sql("cotacoes", "'cotacoes' AS tbl, asset, price")} UNION ALL {moment_sql("cotacoes_shib_brl", "'cotacoes_shib_brl', 'SHIB_BRL', price")}),
g AS (SELECT 'cotacoes' AS tbl, asset, grid_min AS w FROM ativos UNION ALL SELECT 'cotacoes_shib_brl', asset, feed_grid_min FROM ativos WHERE asset = 'SHIB_BRL'),
k AS (SELECT tbl, asset, w, CAST(floor(ms / (w * 60000)) AS BIGINT) AS slot, avg(price) AS v FROM r JOIN g USING (tbl, asset) WHERE ms IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) GROUP BY ALL)"""
_LINE = "OVER (PARTITION BY tbl, asset ORDER BY slot)"

SQL: dict[str, str] = {
    "p3_means": f"{_KNOTS} SELECT tbl, asset, slot * w * 60 AS slot_epoch, {_digits_sql('v')} AS value FROM k",
    "p3_filled": f"""{_KNOTS}, a AS (SELECT *, lag(slot) {_LINE} AS ps, lag(v) {_LINE} AS pv, lead(slot) {_LINE} AS ns, lead(v) {_LINE} AS nv, lead(slot, 2) {_LINE} AS n2s, lead(v, 2) {_LINE} AS n2v FROM k),
b AS (SELECT *, CAST(ns - slot AS DOUBLE) AS h, (nv - v) / (ns - slot) AS d, CASE WHEN slot - ps <= 13 THEN CAST(slot - ps AS DOUBLE) END AS hp, (v - pv) / (slot - ps) AS dp, CASE WHEN n2s - ns <= 13 THEN CAST(n2s - ns AS DOUBLE) END AS hn, (n2v - nv) / (n2s - ns) AS dn FROM a WHERE ns - slot BETWEEN 2 AND 13),
m AS (SELECT *, CASE WHEN hp IS NOT NULL THEN {_inner_sql("hp", "h", "dp", "d")} WHEN hn IS NOT NULL THEN {_end_sql("h", "hn", "d", "dn")} ELSE d END AS m0, CASE WHEN hn IS NOT NULL THEN {_inner_sql("h", "hn", "d", "dn")} WHEN hp IS NOT NULL THEN {_end_sql("h", "hp", "d", "dp")} ELSE d END AS m1 FROM b),
u AS (SELECT *, i / h AS u FROM (SELECT *, unnest(range(1, ns - slot)) AS i FROM m)),
f AS (SELECT tbl, asset, (slot + i) * w * 60 AS slot_epoch, (2 * u * u * u - 3 * u * u + 1) * v + (u * u * u - 2 * u * u + u) * h * m0 + (3 * u * u - 2 * u * u * u) * nv + (u * u * u - u * u) * h * m1 AS y FROM u)
SELECT tbl, asset, slot_epoch, {_digits_sql("y")} AS value FROM f WHERE isfinite(y)""",
    "p4_averages": rf"""WITH r AS (SELECT asset, CAST(floor(ms / 86400000) AS BIGINT) AS d, volume, CASE WHEN NOT isnan(price) THEN price END AS price FROM ({moment_sql("cotacoes", "asset, volume, price")}) WHERE ms IS NOT NULL AND asset IN (SELECT asset FROM ativos)),
a AS (SELECT asset, d, count(*) FILTER (volume > 0) AS n, CAST(sum(volume) AS DOUBLE) AS v, count(volume) AS nv, sum(price) AS p, count(price) AS np FROM r GROUP BY ALL),
c AS (SELECT asset, unnest(range(lo, hi + 1)) AS d FROM (SELECT asset, min(d) AS lo, max(d) AS hi FROM a WHERE n > 0 GROUP BY 1)), x AS (SELECT * FROM c LEFT JOIN a USING (asset, d)),
s AS ({" UNION ALL ".join(f"SELECT asset, d, CAST({k} AS BIGINT) AS span_days, coalesce(sum(p) OVER w, 0) AS pt, sum(p) OVER w / nullif(sum(np) OVER w, 0) AS pa, round(sum(v) OVER w / nullif(sum(nv) OVER w, 0), 6) AS va FROM x WINDOW w AS (PARTITION BY asset ORDER BY d ROWS {k - 1} PRECEDING)" for k in (7, 30))})
SELECT asset, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, span_days, {_digits_sql("pt")} AS price_total, {_digits_sql("pa")} AS price_avg, {_digits_sql("va")} AS volume_avg FROM s""",
    "p2_exact": f"""WITH {_READINGS}, m AS (SELECT src, median(volume) AS usual FROM r WHERE volume > 0 GROUP BY 1)
SELECT quote_id, 'price' AS field, 'impossible' AS reason FROM r WHERE NOT isnan(price) AND (price <= 0 OR isinf(price)) UNION ALL SELECT quote_id, 'volume', 'impossible' FROM r WHERE volume < 0
UNION ALL SELECT quote_id, 'volume', 'spike' FROM r JOIN m USING (src) WHERE volume > 1000 * usual UNION ALL {_stuck_sql("price", "price IS NOT NULL AND NOT isnan(price)")}
UNION ALL {_stuck_sql("volume", "volume IS NOT NULL").replace("WHERE n >= 20", "WHERE n >= 20 AND volume <> 0")}""",
    "p3_observed": rf"""WITH r AS ({moment_sql("cotacoes", "'cotacoes' AS tbl, asset, price")} UNION ALL {moment_sql("cotacoes_shib_brl", "'cotacoes_shib_brl', 'SHIB_BRL', price")}),
g AS (SELECT 'cotacoes' AS tbl, asset, grid_min AS w FROM ativos UNION ALL SELECT 'cotacoes_shib_brl', asset, feed_grid_min FROM ativos WHERE asset = 'SHIB_BRL')
SELECT tbl, asset, CAST(floor(ms / (w * 60000)) AS BIGINT) * w * 60 AS slot_epoch, count(*) AS readings FROM r JOIN g USING (tbl, asset) WHERE ms IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) GROUP BY ALL""",
    "p6_aggregates": """WITH q AS (SELECT *, coalesce(asset IN (SELECT asset FROM ativos), FALSE) AS k FROM cotacoes), m AS (SELECT asset, median(volume) AS mv FROM q WHERE k AND volume > 0 GROUP BY 1),
r AS (SELECT load_id, round(median(volume / mv), 9) AS volume_ratio FROM q JOIN m USING (asset) WHERE k AND volume > 0 GROUP BY 1)
SELECT s.*, r.volume_ratio FROM (SELECT load_id, count(*) AS n, round(avg(CAST(price IS NULL OR isnan(price) AS INTEGER)), 9) AS price_absent, round(avg(CAST(volume IS NULL AS INTEGER)), 9) AS volume_absent, round(avg(CAST(asset IS NULL AS INTEGER)), 9) AS asset_absent,
round(count(*) FILTER (asset IS NOT NULL AND NOT k) / count(asset), 9) AS unknown_share, count(DISTINCT asset) AS asset_distinct, min(volume) AS volume_min, max(volume) AS volume_max FROM q GROUP BY 1) s LEFT JOIN r USING (load_id)""",
    "p3_found": rf"""WITH r AS ({moment_sql("cotacoes", "'cotacoes' AS tbl, asset, price")} UNION ALL {moment_sql("cotacoes_shib_brl", "'cotacoes_shib_brl', 'SHIB_BRL', price")}),
g AS (SELECT 'cotacoes' AS tbl, asset, grid_min AS w FROM ativos UNION ALL SELECT 'cotacoes_shib_brl', asset, feed_grid_min FROM ativos WHERE asset = 'SHIB_BRL'),
s AS (SELECT DISTINCT tbl, asset, w, CAST(floor(ms / (w * 60000)) AS BIGINT) AS slot FROM r JOIN g USING (tbl, asset) WHERE ms IS NOT NULL AND price IS NOT NULL AND NOT isnan(price)),
n AS (SELECT *, lead(slot) OVER (PARTITION BY tbl, asset ORDER BY slot) AS nxt FROM s)
SELECT tbl, asset, x * w * 60 AS slot_epoch FROM (SELECT tbl, asset, w, unnest(range(slot + 1, nxt)) AS x FROM n WHERE nxt > slot + 1)""",
    "p4_found": rf"""WITH a AS (SELECT DISTINCT asset, CAST(floor(ms / 86400000) AS BIGINT) AS d FROM ({moment_sql("cotacoes", "asset, volume")}) WHERE ms IS NOT NULL AND volume > 0 AND asset IN (SELECT asset FROM ativos)),
c AS (SELECT asset, unnest(range(lo, hi + 1)) AS d FROM (SELECT asset, min(d) AS lo, max(d) AS hi FROM a GROUP BY 1)),
f AS (SELECT c.asset, c.d, count(a.d) OVER (PARTITION BY c.asset ORDER BY c.d ROWS 6 PRECEDING) AS n7, count(a.d) OVER (PARTITION BY c.asset ORDER BY c.d ROWS 29 PRECEDING) AS n30 FROM c LEFT JOIN a USING (asset, d))
SELECT asset, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, CAST(7 AS BIGINT) AS span_days FROM f WHERE n7 = 0 UNION ALL SELECT asset, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d'), 30 FROM f WHERE n30 = 0""",
    "p4_volume": rf"""WITH r AS (SELECT asset, CAST(floor(ms / 86400000) AS BIGINT) AS d, volume FROM ({moment_sql("cotacoes", "asset, volume")}) WHERE ms IS NOT NULL AND asset IN (SELECT asset FROM ativos)),
a AS (SELECT asset, d, count(*) FILTER (volume > 0) AS n, CAST(sum(volume) AS BIGINT) AS v FROM r GROUP BY ALL),
c AS (SELECT asset, unnest(range(lo, hi + 1)) AS d FROM (SELECT asset, min(d) AS lo, max(d) AS hi FROM a WHERE n > 0 GROUP BY 1)), x AS (SELECT asset, d, n, v FROM c LEFT JOIN a USING (asset, d))
{" UNION ALL ".join(f"SELECT asset, strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d') AS day, CAST({k} AS BIGINT) AS span_days, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS active_rows, count(*) FILTER (n > 0) OVER w AS active_days, CAST(coalesce(sum(v) OVER w, 0) AS BIGINT) AS volume_total FROM x WINDOW w AS (PARTITION BY asset ORDER BY d ROWS {k - 1} PRECEDING)" for k in (7, 30))}""",
    "p5_found": _RECORDS + " SELECT line_id, reason FROM k WHERE reason IS NOT NULL",
    "p5_rows": _RECORDS + f" SELECT line_id, CASE WHEN \"timestamp\" NOT IN {_MISSING} THEN ms END AS ms, CASE WHEN a NOT IN {_MISSING} THEN a END AS asset, CASE WHEN p NOT IN {_MISSING} THEN CAST(trim(p) AS DOUBLE) END AS price, CASE WHEN q NOT IN {_MISSING} THEN CAST(trim(q) AS BIGINT) END AS volume FROM k WHERE reason IS NULL",
    "p6_found": """WITH q AS (SELECT *, coalesce(asset IN (SELECT asset FROM ativos), FALSE) AS k FROM cotacoes),
s AS (SELECT load_id, avg(CAST(price IS NULL OR isnan(price) AS INTEGER)) AS pa, avg(CAST(volume IS NULL AS INTEGER)) AS va, avg(CAST(asset IS NULL AS INTEGER)) AS aa, count(*) FILTER (asset IS NOT NULL AND NOT k) / count(asset) AS u, count(DISTINCT asset) AS dn FROM q GROUP BY 1),
m AS (SELECT asset, median(volume) AS mv FROM q WHERE k AND volume > 0 GROUP BY 1), r AS (SELECT load_id, median(volume / mv) AS r FROM q JOIN m USING (asset) WHERE k AND volume > 0 GROUP BY 1),
t AS (SELECT median(pa) AS pa, median(va) AS va, median(aa) AS aa, median(u) AS u, median(dn) AS dn FROM s)
SELECT load_id, 'price' AS column_name, 'absent' AS check_name FROM s, t WHERE s.pa - t.pa >= 0.1 - 1e-12 UNION ALL SELECT load_id, 'volume', 'absent' FROM s, t WHERE s.va - t.va >= 0.1 - 1e-12
UNION ALL SELECT load_id, 'asset', 'absent' FROM s, t WHERE s.aa - t.aa >= 0.1 - 1e-12 UNION ALL SELECT load_id, 'asset', 'unknown' FROM s, t WHERE s.u - t.u >= 0.1 - 1e-12
UNION ALL SELECT load_id, 'asset', 'distinct' FROM s, t WHERE s.dn < 0.6 * t.dn OR s.dn > 1.6 * t.dn UNION ALL SELECT load_id, 'volume', 'shift' FROM r WHERE r < 1 / 3.0 OR r > 3""",
}
