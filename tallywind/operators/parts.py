"""Ordered series cut by rank into parts that one task holds, and the edges where a series goes on in the next part.

A table is stored in parts of about equal size, in the order of (series, time), however its rows are spread over series and
hours. A pass reads each part once, whole, in Arrow batches. What depends on neighbours beyond a part's end is settled in
a second, small step over the edges: the outermost elements of each part, put together with those of the part beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: A part is one row group of one file, so that a task that reads any of it reads it whole.
_ROW_GROUP = 256 << 20
#: Rows of a per-series table up to which it is broadcast (some 50 bytes each); beyond, rows are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows below which a table is not cut further for the sake of idle cores.
_LEAST = 10_000


def store_parts(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The stored rows of df and their `part`: ranges of the keys, about `rows` rows each. Rows with equal keys share a part. Pass a stored df."""
    n = df.count()
    spread = df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, ceil(n / rows), min(spread, ceil(n / _LEAST)))
    cut = df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())
    return materialize(cut, "parts", **{"parquet.block.size": str(_ROW_GROUP)})


def with_facts(parts: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Stored parts with the columns of a table of one row per key. Broadcast up to BROADCAST_ROWS; beyond, joined by shuffle and put together again."""
    if facts.count() <= BROADCAST_ROWS:
        return parts.join(F.broadcast(facts), key, "left")
    return parts.join(facts, key, "left").repartition("part").sortWithinPartitions("part")


def each_part(process: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that calls process with every whole part; the first column is the part's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if held and held[-1].column(0)[0].as_py() != number[lo]:
                    yield from process(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from process(pa.Table.from_batches(held))

    return run


@dataclass
class Edges:
    """Of a part's elements, in order: which are settled inside the part, and the pieces to settle with the neighbours, as
    (from, to, settled from, settled to); through if the part is one short piece of a series, without an inside."""

    inside: np.ndarray
    pieces: list[tuple[int, int, int, int]]
    through: bool


def cut_edges(series: np.ndarray, need: int) -> Edges:
    """The edges of a part, an element depending on at most `need` others on either side. `series` numbers the elements' series in order."""
    n = len(series)
    inside = np.ones(n, bool)
    if not n:
        return Edges(inside, [], False)
    first_end, last_start = int(np.searchsorted(series, series[0], "right")), int(np.searchsorted(series, series[-1], "left"))
    if first_end == n and n < 2 * need:
        return Edges(~inside, [(0, n, 0, n)], True)
    head, tail = min(first_end, need), max(last_start, n - need)
    inside[:head] = inside[tail:] = False
    return Edges(inside, [(0, min(first_end, 2 * need), 0, head), (max(last_start, n - 2 * need), n, tail, n)], False)


def joined_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Edge rows (stream, part, side, ...) with the `meeting` at which they are settled.

    `notes` has one row per part and stream with elements (`through`). The head
    (side 0) of a part meets the tail (side 1) of the one before; a part that is
    passed through joins both its meetings. A meeting holds few elements per
    part. The window has one row per part.
    """
    twice = notes.groupBy("stream", "part").count().where("count > 1")
    if twice.limit(1).count():
        raise RuntimeError("a part was read in pieces: its file has more than one row group")
    line = Window.partitionBy("stream").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum(F.when(F.col("through"), 0).otherwise(1)).over(line)
    meetings = notes.select("stream", "part", after.alias("__after"), F.when(F.col("through"), 0).otherwise(1).alias("__own"))
    joined = edges.join(meetings, ["stream", "part"])
    return joined.withColumn("meeting", F.when(F.col("side") == 0, F.col("__after") - F.col("__own")).otherwise(F.col("__after"))).drop("__after", "__own")
