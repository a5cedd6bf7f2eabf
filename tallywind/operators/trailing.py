"""Totals and averages over trailing periods of days, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def trailing_totals(
    df: DataFrame,
    entity: Sequence[str],
    day: str,
    measures: Sequence[str],
    active: Column,
    spans: Sequence[int] = (7, 30),
) -> DataFrame:
    """For each entity and calendar day, and each span, totals and averages over the span's days that end with the day.

    Rows are first aggregated per entity and day (map-side combined, so that a
    hot entity costs one row a day after the shuffle). The days are then made
    dense, from the entity's first to its last active day, by generating each
    entity's own calendar, and window sums run over a fixed number of rows.

    Result: the entity columns, `day` (DATE), `span_days`, `active_rows`,
    `active_days` and for each measure m `m_total`, `m_avg` (mean over the rows
    that have it). Rows without an entity or a day are left out; an entity
    without an active day has no rows. Null and NaN measures count as absent;
    a total without any value is 0, its average NULL. Extra columns are
    ignored, repeated rows count each.
    """
    entity, measures = list(entity), list(measures)
    kinds = dict(df.dtypes)
    present = {m: F.when(~F.isnan(m), F.col(m)) if kinds[m] in ("double", "float") else F.col(m) for m in measures}
    known = F.col(day).isNotNull()
    for e in entity:
        known = known & F.col(e).isNotNull()
    daily = (
        df.where(known)
        .groupBy(*[F.col(e).alias(f"__e{i}") for i, e in enumerate(entity)], F.col(day).alias("__day"))
        .agg(
            F.count_if(active).alias("__active"),
            *[F.sum(present[m]).alias(f"__s{i}") for i, m in enumerate(measures)],
            *[F.count(present[m]).alias(f"__n{i}") for i, m in enumerate(measures)],
        )
    )
    daily = materialize(daily, "daily")  # a row per entity and day, used twice
    keys = [f"__e{i}" for i in range(len(entity))]
    calendar = (
        daily.where(F.col("__active") > 0)
        .groupBy(*keys)
        .agg(F.min("__day").alias("__lo"), F.max("__day").alias("__hi"))
        .select(*keys, F.explode(F.sequence("__lo", "__hi")).alias("__day"))
    )
    dense = calendar.join(daily, [*keys, "__day"], "left")
    columns = []
    for span in spans:
        w = Window.partitionBy(*keys).orderBy("__day").rowsBetween(1 - span, 0)
        total = lambda c, w=w: F.coalesce(F.sum(c).over(w), F.lit(0))
        fields = [
            F.lit(span).cast("long").alias("span_days"),
            total("__active").cast("long").alias("active_rows"),
            F.count_if(F.col("__active") > 0).over(w).alias("active_days"),
        ]
        for i, m in enumerate(measures):
            kind = "double" if kinds[m] in ("double", "float") else "long"
            fields += [
                total(f"__s{i}").cast(kind).alias(f"{m}_total"),
                F.try_divide(total(f"__s{i}").cast("double"), total(f"__n{i}").cast("double")).alias(f"{m}_avg"),
            ]
        columns.append(F.struct(*fields))
    named = [F.col(k).alias(e) for k, e in zip(keys, entity)]
    return dense.select(*named, F.col("__day").alias("day"), F.array(*columns).alias("__spans")).select(*entity, "day", F.inline("__spans"))
