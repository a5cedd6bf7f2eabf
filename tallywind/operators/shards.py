"""Ordered series cut into time shards with halos, so that no series is one task's burden."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FAR = 2**62


def time_shards(
    df: DataFrame,
    series: Sequence[str],
    ms: str,
    present: Mapping[str, Column],
    rows: int = 200_000,
    halo: int = 32,
    bucket_ms: int = 3_600_000,
) -> DataFrame:
    """df with `shard` and `core`: each row once as core of its shard, and again as halo of neighbouring shards.

    A series (one value of the `series` columns, which must not be null) is
    counted per bucket of `bucket_ms`; about `rows` rows form a shard, cut at a
    bucket's start. Of every kind in `present`, a shard's halo holds at least
    `halo` rows on either side, or all there are, even where neighbouring shards
    are small. Ordering within (series, shard) then gives the same neighbours as
    ordering the whole series. The shard table has one row per series, an array
    of its ranges; Spark broadcasts it only below its size threshold. `df` is
    read twice: pass a stored one. Columns `shard`, `core` must not exist.
    """
    series = list(series)
    bucket = F.floor(F.col(ms) / bucket_ms).cast("long")
    counted = df.select(*series, bucket.alias("b"), *[c.alias(f"__{k}") for k, c in present.items()])
    counts = counted.groupBy(*series, "b").agg(F.count("*").alias("__all"), *[F.count_if(F.col(f"__{k}")).alias(f"__n_{k}") for k in present])
    order = Window.partitionBy(*series).orderBy("b")
    upto = counts.select(*series, "b", F.sum("__all").over(order).alias("__end"), "__all", *[f"__n_{k}" for k in present], *[F.sum(f"__n_{k}").over(order).alias(f"__end_{k}") for k in present])
    upto = upto.withColumn("shard", F.floor((F.col("__end") - F.col("__all")) / rows).cast("long"))
    lo, hi = F.lit(_FAR).cast("long"), F.lit(-_FAR).cast("long")
    for k in present:
        start = F.col(f"__end_{k}") - F.col(f"__n_{k}")
        before = Window.partitionBy(*series).orderBy(start).rangeBetween(Window.unboundedPreceding, -halo)
        after = Window.partitionBy(*series).orderBy(F.col(f"__end_{k}")).rangeBetween(halo, Window.unboundedFollowing)
        lo = F.least(lo, F.coalesce(F.max("b").over(before), F.lit(-_FAR)))
        hi = F.greatest(hi, F.coalesce(F.min("b").over(after), F.lit(_FAR)))
    reach = upto.select(*series, "b", "shard", lo.alias("lo"), hi.alias("hi"))
    ranges = (
        reach.groupBy(*series, "shard")
        .agg(F.min("b").alias("start"), F.max("b").alias("stop"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy(*series)
        .agg(F.collect_list(F.struct("shard", "start", "stop", "lo", "hi")).alias("__ranges"))
    )
    mine = F.filter("__ranges", lambda r: (r.lo <= F.col("__b")) & (F.col("__b") <= r.hi))
    copies = df.join(ranges, series).withColumn("__b", bucket).withColumn("__r", F.explode(mine))
    core = (F.col("__r.start") <= F.col("__b")) & (F.col("__b") <= F.col("__r.stop"))
    return copies.select(*df.columns, F.col("__r.shard").alias("shard"), core.alias("core"))
