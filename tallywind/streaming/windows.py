"""Windowed aggregates over streams: an extension, no operator of batch frames depends on it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(df: DataFrame, ts: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Totals per key and time window (tumbling, or sliding with `slide`): key, start, end, n, total.

    Rows later than `late` behind the newest are dropped once the watermark has
    passed their window; state is bounded by the windows still open. NULL and NaN
    values count as rows but add nothing. Works on batch tables as well.
    """
    x = F.col(value).cast("double")
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    frame = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(frame.alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(~F.isnan(x), x)), F.lit(0.0)).alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions per key, closed after `gap` without a row: key, start, end, n."""
    rows = df.withWatermark(ts, late) if df.isStreaming else df
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_values(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The running last present value per key over a stream (key, value): one small state per key, updated batch by batch."""

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        for b in batches:
            b = b[b[value].notna() & b[order].notna()]
            if len(b):
                top = b.loc[b[order].idxmax()]
                if at is None or top[order] >= at:
                    at, last = int(top[order]), float(top[value])
        if at is not None:
            state.update((at, last))
            yield pd.DataFrame({key: [k[0]], value: [last]})

    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {value} double", "at long, last double", "update", "NoTimeout")
