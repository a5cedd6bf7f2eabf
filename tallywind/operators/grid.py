"""Irregular readings onto a regular grid, by shape-preserving monotone cubic interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grid periods in a time shard. A shard is one task's window at most, however hot its source.
SHARD_SLOTS = 8192
#: Periods of a gap that are written out at once: a gap is never one array in memory, however long.
GAP_BLOCK = 4096


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at a knot between two intervals: weighted harmonic mean, 0 at a turning point."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when((d0 * d1) <= 0, F.lit(0.0)).otherwise(F.try_divide(w0 + w1, F.try_divide(w0, d0) + F.try_divide(w1, d1)))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Slope at a segment's end: three-point formula, limited so that the curve stays monotone."""
    m = F.try_divide((2 * h0 + h1) * d0 - h0 * d1, h0 + h1)
    return F.when(m * d0 <= 0, F.lit(0.0)).when((d0 * d1 <= 0) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m)


def regular_grid(
    df: DataFrame,
    source: Sequence[str],
    ts_ms: str,
    value: str,
    step_min: str,
    max_fill: int = 12,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """One row per source and grid period, from the source's first to its last reading.

    A period starts at a multiple of `step_min` (a BIGINT column, minutes, one
    value per source) since 1970-01-01 UTC. Its value is the mean of its
    readings. Periods without a reading lie between two knots (periods with
    one): a gap of at most `max_fill` periods is filled by monotone cubic
    interpolation (Fritsch-Carlson slopes), a longer one stays NULL and ends a
    segment: values on its far side do not enter the curve on this side.

    Result: the source columns, `slot_epoch` (BIGINT seconds), `value`,
    `readings`, `status` (`observed`, `filled`, `gap`). Rows with a null source,
    moment, step or value, or a NaN value, are no readings; infinite values are
    readings, next to which nothing is filled with a number. Readings of one
    moment and repeated rows all enter the mean. Extra columns are ignored.

    Readings are averaged per period first (map-side combined). Periods are cut
    into time shards of `shard_slots`; each shard is a window of its own, and
    the two outermost knots of every shard are exchanged as halo with its
    neighbours, so that results do not depend on the shards.
    """
    source = list(source)
    keys = [f"__k{i}" for i in range(len(source))]
    good = F.col(ts_ms).isNotNull() & (F.col(step_min) > 0) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    for s in source:
        good = good & F.col(s).isNotNull()
    slot = F.floor(F.col(ts_ms) / (F.col(step_min) * 60_000)).cast("long")  # doubles are exact here: |ts| < 2^53
    knots = (
        df.where(good)
        .select(*[F.col(s).alias(k) for s, k in zip(source, keys)], F.col(step_min).alias("step"), slot.alias("slot"), F.col(value).cast("double").alias("v"))
        .groupBy(*keys, "step", F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), "slot")
        .agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    )
    knot = F.struct("slot", "v")
    w = Window.partitionBy(*keys, "shard").orderBy("slot")
    whole = Window.partitionBy(*keys, "shard")
    inner = knots.select(
        "*",
        F.row_number().over(w).alias("rn"),
        F.count("*").over(whole).alias("cnt"),
        F.lag(knot, 1).over(w).alias("p1"),
        F.lead(knot, 1).over(w).alias("n1"),
        F.lead(knot, 2).over(w).alias("n2"),
    )
    # the halo: a shard's outermost knots, seen by its neighbours
    line = Window.partitionBy(*keys).orderBy("slot")
    ends = (
        inner.where((F.col("rn") <= 2) | (F.col("rn") > F.col("cnt") - 2))
        .select(*keys, "shard", "slot", "rn", "cnt", F.lag(knot, 1).over(line).alias("p"), F.lead(knot, 1).over(line).alias("n"), F.lead(knot, 2).over(line).alias("nn"))
        .groupBy(*keys, "shard")
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("p"))).alias("hp"),
            F.max(F.when(F.col("rn") == F.col("cnt"), F.col("n"))).alias("hn"),
            F.max(F.when(F.col("rn") == F.col("cnt"), F.col("nn"))).alias("hnn"),
        )
    )
    last = F.col("cnt") - F.col("rn")
    joined = inner.join(ends, [*keys, "shard"], "left").select(
        *keys,
        "step",
        "slot",
        "v",
        "n",
        F.coalesce("p1", "hp").alias("p1"),
        F.coalesce("n1", "hn").alias("n1"),
        F.when(last >= 2, F.col("n2")).when(last == 1, F.col("hn")).otherwise(F.col("hnn")).alias("n2"),
    )
    x = lambda c: F.col(f"{c}.slot").cast("double")
    t = F.col("slot").cast("double")
    span = joined.select(
        *keys,
        "step",
        "slot",
        "v",
        "n",
        (F.col("n1.slot") - F.col("slot") - 1).alias("missing"),
        F.col("n1.v").alias("v1"),
        (x("n1") - t).alias("h"),
        F.try_divide(F.col("n1.v") - F.col("v"), x("n1") - t).alias("d"),
        F.when(t - x("p1") <= max_fill + 1, t - x("p1")).alias("hp"),
        F.try_divide(F.col("v") - F.col("p1.v"), t - x("p1")).alias("dp"),
        F.when(x("n2") - x("n1") <= max_fill + 1, x("n2") - x("n1")).alias("hn"),
        F.try_divide(F.col("n2.v") - F.col("n1.v"), x("n2") - x("n1")).alias("dn"),
    )
    c = F.col
    m0 = F.when(c("hp").isNotNull(), _inner_slope(c("hp"), c("h"), c("dp"), c("d"))).when(c("hn").isNotNull(), _end_slope(c("h"), c("hn"), c("d"), c("dn"))).otherwise(c("d"))
    m1 = F.when(c("hn").isNotNull(), _inner_slope(c("h"), c("hn"), c("d"), c("dn"))).when(c("hp").isNotNull(), _end_slope(c("h"), c("hp"), c("d"), c("dp"))).otherwise(c("d"))
    need = c("missing").between(1, max_fill)
    span = span.select(*keys, "step", "slot", "v", "v1", "n", "missing", "h", F.when(need, m0).alias("m0"), F.when(need, m1).alias("m1"))
    zero = F.lit(0).cast("long")
    blocks = span.select("*", F.explode(F.sequence(zero, F.coalesce("missing", zero), F.lit(GAP_BLOCK).cast("long"))).alias("__b"))
    rows = blocks.select("*", F.explode(F.sequence(c("__b"), F.least(c("__b") + (GAP_BLOCK - 1), F.coalesce("missing", zero)))).alias("i"))
    u = c("i") / c("h")
    cubic = (
        (2 * u * u * u - 3 * u * u + 1) * c("v")
        + (u * u * u - 2 * u * u + u) * c("h") * c("m0")
        + (3 * u * u - 2 * u * u * u) * c("v1")
        + (u * u * u - u * u) * c("h") * c("m1")
    )
    filled = F.when(F.abs(cubic) < float("inf"), cubic)  # NULL beside an infinite reading
    status = F.when(c("i") == 0, "observed").when((c("missing") <= max_fill) & filled.isNotNull(), "filled").otherwise("gap")
    return rows.select(
        *[c(k).alias(s) for s, k in zip(source, keys)],
        ((c("slot") + c("i")) * c("step") * 60).alias("slot_epoch"),
        F.when(c("i") == 0, c("v")).when(c("missing") <= max_fill, filled).alias("value"),
        F.when(c("i") == 0, c("n")).otherwise(F.lit(0).cast("long")).alias("readings"),
        status.alias("status"),
    )
