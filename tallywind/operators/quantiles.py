"""Exact order statistics of groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 65_536  # second-level bins within a first-level bin


def group_quantiles(df: DataFrame, group: Sequence[str], value: str, q: float | Sequence[float] = 0.5) -> DataFrame:
    """The q-quantile (linear interpolation) of each group's values: the group columns, `n`, `quantile`; for a list of q `quantile_0`, ...

    Three counting passes narrow down to the wanted ranks: bins of 1/64 octave,
    65,536 equal parts of the bin that holds the rank, then the distinct values
    of that part. Each pass is a map-side combined count, so a hot group costs
    bins, not rows, after the shuffle; nothing is sampled and the result is exact.

    NULL and NaN values are left out, a group without values has no row, null
    group keys form a group. Values are compared as doubles; infinities are
    values. Works on an empty table. `df` is read three times: pass a stored one.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*[F.col(g).alias(k) for g, k in zip(group, keys)], x.alias("x"))
    octave = F.floor(F.log2(F.abs("x")) * 64).cast("long") + 100_000
    bins = F.when(F.col("x") == 0, F.lit(0).cast("long")).when(F.abs("x") == float("inf"), F.signum("x").cast("long") * 1_000_000).when(F.col("x") > 0, octave).otherwise(-octave)
    rows = rows.withColumn("bin", bins)

    def narrow(counts: DataFrame, bin_name: str) -> DataFrame:
        """Of each target rank, the bin that holds it and the ranks before that bin."""
        w = Window.partitionBy(*keys, "target").orderBy(bin_name)
        counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
        return counts.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))

    first = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    qs = [float(q)] if isinstance(q, (int, float)) else [float(x) for x in q]
    ranks = []
    for i, p in enumerate(qs):
        place = (total - 1) * F.lit(p)
        ranks += [F.struct(F.lit(2 * i + t).alias("target"), f(place).cast("long").alias("rank"), (place - F.floor(place)).alias("share")) for t, f in ((0, F.floor), (1, F.ceil))]
    w = Window.partitionBy(*keys).orderBy("bin")
    first = first.select(*keys, "bin", "n", "lo", "hi", total.alias("total"), F.sum("n").over(w).alias("upto"), F.array(*ranks).alias("ranks"))
    first = first.select("*", F.inline("ranks")).where((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto")))
    first = first.select(*keys, "bin", "lo", "hi", "total", "share", "target", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))

    def within(targets: DataFrame, extra: list) -> DataFrame:
        a, b = rows.alias("a"), targets.alias("b")
        on = (F.col("a.bin") == F.col("b.bin"))
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return a.join(b, on).select(*[F.col(f"b.{k}").alias(k) for k in keys], "b.target", "b.bin", "b.total", "b.share", "b.rank", "a.x", *extra)

    part = F.when(F.col("b.hi") > F.col("b.lo"), F.floor((F.col("a.x") - F.col("b.lo")) / (F.col("b.hi") - F.col("b.lo")) * _PARTS).cast("long")).otherwise(F.lit(0).cast("long")).alias("part")
    bounds = [F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), part]
    head = [*keys, "target", "bin", "total", "share", "rank"]
    second = narrow(within(first, bounds).groupBy(*head, "lo", "hi", "part").agg(F.count("*").alias("n")), "part")
    second = second.select(*keys, "target", "bin", "total", "share", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", F.col("part").alias("wanted"))
    exact = within(second, [*bounds, F.col("b.wanted").alias("wanted")]).where(F.col("part") == F.col("wanted"))
    exact = narrow(exact.groupBy(*head, "x").agg(F.count("*").alias("n")), "x")
    at = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    found = [a for i in range(len(qs)) for a in (at(2 * i, "x").alias(f"low_{i}"), at(2 * i + 1, "x").alias(f"high_{i}"), at(2 * i, "share").alias(f"share_{i}"))]
    out = exact.groupBy(*keys).agg(F.max("total").alias("n"), *found)
    blend = lambda i: F.when(F.col(f"low_{i}") == F.col(f"high_{i}"), F.col(f"low_{i}")).otherwise(F.col(f"low_{i}") + (F.col(f"high_{i}") - F.col(f"low_{i}")) * F.col(f"share_{i}"))
    names = ["quantile"] if isinstance(q, (int, float)) else [f"quantile_{i}" for i in range(len(qs))]
    return out.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], "n", *[blend(i).alias(n) for i, n in enumerate(names)])
