"""Mixtures of sources with target shares, small sources repeated up to a cap."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_BITS = 12


def fill_shares(available: Mapping[str, int], share: Mapping[str, float], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source: its share of the total, at most `repeats` times what it has.

    Sources that would exceed their cap are clamped at it and the rest of the
    total goes to the others in proportion to their shares, until all fit.
    """
    cap = {s: max(0, available.get(s, 0)) * max(0, repeats[s]) for s in share}
    quota: dict[str, float] = {}
    open_ = {s for s in share if share[s] > 0}
    quota.update({s: 0.0 for s in share if s not in open_})
    rest = min(float(total), float(sum(cap[s] for s in open_)))
    while open_:
        weight = sum(share[s] for s in open_)
        over = {s for s in open_ if rest * share[s] / weight > cap[s]}
        if not over:
            quota.update({s: rest * share[s] / weight for s in open_})
            break
        quota.update({s: float(cap[s]) for s in over})
        rest = max(0.0, rest - sum(cap[s] for s in over))
        open_ -= over
    return quota


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of the records in `sized` (id, source, tokens; stored, it is read several times).

    targets: source, target_share, max_repeats, a table of settings that is read
    to the driver. The mixture has a row per copy: id, source, tokens, copy
    (1, 2, ...). Every record of a source is taken the whole number of times its
    quota allows; for the fraction left, records are drawn in the order of a
    seeded hash, as far as their tokens fit. The draw cuts a table of 4,096 hash
    buckets per source and sorts one bucket only, so a hot source is no task's
    burden. `total` defaults to the tokens of all sources with a target.

    shares has a row per source of either table (null for records without one):
    target_share, max_repeats, available, taken, epochs, actual_share. Sources
    without a target have share 0 and do not enter the mixture; a named source
    without records stays at 0 and its share goes to the others. Records
    without tokens take part in whole repetitions. Null shares count as 0, null
    caps as 1; of a source named twice, the shares add up and the smallest cap
    holds. Empty tables give empty results.
    """
    sized = sized.select("id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    settings = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("m")).collect()
    share = {r.source: max(0.0, float(r.w)) for r in settings}
    repeats = {r.source: max(0, int(r.m)) for r in settings}
    named = sized.join(targets.select("source").distinct(), "source", "left_semi")
    available = {r.source: int(r.n or 0) for r in named.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row per named source
    quota = fill_shares(available, share, repeats, sum(available.values()) if total is None else total)
    plan = []
    for s, q in quota.items():
        have = available.get(s, 0)
        whole = min(int(q // have), repeats[s]) if have else 0
        plan.append((s, share[s], repeats[s], whole, q - whole * have))
    spark = sized.sparkSession
    planned = spark.createDataFrame(plan, "source string, target_share double, max_repeats long, whole long, part double")

    h = F.xxhash64(F.lit(seed), F.col("id"))
    drawn = sized.join(planned.select("source", "whole", "part"), "source").withColumn("h", h).withColumn("b", F.shiftright("h", 64 - _BUCKET_BITS))
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = drawn.groupBy("source", "part", "b").agg(F.sum("tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # buckets wholly inside the part are drawn; the one that crosses its end is sorted
    state = F.when(F.col("before") + F.col("n") <= F.col("part"), "in").when(F.col("before") < F.col("part"), "cut").otherwise("out")
    state = buckets.select("source", "b", (F.col("part") - F.col("before")).alias("left"), state.alias("state"))
    rows = drawn.join(state, ["source", "b"])
    inside = Window.partitionBy("source", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.where(F.col("state") == "cut").withColumn("extra", (F.sum("tokens").over(inside) <= F.col("left")).cast("long")).select("id", "source", "tokens", "whole", "extra")
    rest = rows.where(F.col("state") != "cut").select("id", "source", "tokens", "whole", (F.col("state") == "in").cast("long").alias("extra"))
    copies = cut.unionByName(rest).withColumn("copies", F.when(F.col("extra") > 0, F.col("whole") + 1).otherwise(F.col("whole")))
    mixture = copies.where(F.col("copies") > 0).select("id", "source", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))

    taken = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    table = have.join(planned, have["source"].eqNullSafe(planned["source"]), "full").select(F.coalesce(planned["source"], have["source"]).alias("source"), "target_share", "max_repeats", "available")
    table = table.join(taken.withColumnRenamed("source", "__s"), F.col("source") == F.col("__s"), "left").drop("__s")
    all_taken = F.sum("taken").over(Window.partitionBy())  # one row per source
    zero = F.lit(0).cast("long")
    shares = table.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        "max_repeats",
        F.coalesce("available", zero).alias("available"),
        F.coalesce("taken", zero).alias("taken"),
        F.try_divide(F.coalesce("taken", zero).cast("double"), F.col("available").cast("double")).alias("epochs"),
        F.coalesce(F.try_divide(F.coalesce("taken", zero).cast("double"), all_taken.cast("double")), F.lit(0.0)).alias("actual_share"),
    )
    return mixture, shares
