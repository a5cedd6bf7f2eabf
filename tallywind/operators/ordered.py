"""Positional functions over a whole ordered table, in blocks: no window over all rows in one task.

A table is numbered once (`number_rows`): sorted by range, the rows of each
partition counted, offsets added. Positions are then cut into blocks of BLOCK
rows. Functions of bounded reach (shift, rolling) give each block the rows before
it as halo; running ones (cumulative, fill) carry one row of totals from block
to block. The only table windowed as a whole has one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

POS = "__pos"
BLOCK = 500_000


def number_rows(df: DataFrame, order: Sequence[str | Column], ties: bool = True) -> DataFrame:
    """df with its dense position `__pos`, from 1, in the given order.

    Ties follow in the order of a hash of their rows, which also spreads a
    frequent key over ranges; `ties=False` says that there are none.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    if ties:
        keys.append(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]))
    id_ = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", id_)
    stored = materialize(rows, "numbered")
    part = F.shiftright("__id", 33)
    counts = stored.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = stored.withColumn("__part", part).join(offsets, "__part")
    return out.select(*df.columns, (F.col("__off") + within + 1).cast("long").alias(POS))


def _block(block: int) -> Column:
    return F.floor((F.col(POS) - 1) / block).cast("long")


def reach_back(df: DataFrame, reach: int, outputs: Mapping[str, Callable], ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """df with window columns that look at most `reach` rows back and `ahead` rows on: outputs maps a name to a function of the WindowSpec (ordered by position)."""
    block = max(block, reach, ahead, 1)
    own = _block(block)
    blocks = F.sequence(F.floor((F.col(POS) - 1 - ahead) / block).cast("long"), F.floor((F.col(POS) - 1 + reach) / block).cast("long"))
    rows = df.withColumn("__own", own).withColumn("__blk", F.explode(blocks))
    w = Window.partitionBy("__blk").orderBy(POS)
    return rows.select("*", *[f(w).alias(n) for n, f in outputs.items()]).where(F.col("__blk") == F.col("__own")).drop("__blk", "__own")


class Running:
    """How a running function works on blocks: `inside` over a window up to the row, `total` of a block, `carry` over the totals before, `join` of carry and inside."""

    def __init__(self, inside: Callable, total: Column, carry: Callable, join: Callable) -> None:
        self.inside, self.total, self.carry, self.join = inside, total, carry, join


def run_sum(x: Column) -> Running:
    return Running(lambda w: F.sum(x).over(w), F.sum(x), lambda t, w: F.sum(t).over(w), lambda c, v: F.when(c.isNull(), v).when(v.isNull(), c).otherwise(c + v))


def run_prod(x: Column) -> Running:
    return Running(lambda w: F.product(x).over(w), F.product(x), lambda t, w: F.product(t).over(w), lambda c, v: F.when(c.isNull(), v).when(v.isNull(), c).otherwise(c * v))


def run_min(x: Column) -> Running:
    return Running(lambda w: F.min(x).over(w), F.min(x), lambda t, w: F.min(t).over(w), lambda c, v: F.least(c, v))


def run_max(x: Column) -> Running:
    return Running(lambda w: F.max(x).over(w), F.max(x), lambda t, w: F.max(t).over(w), lambda c, v: F.greatest(c, v))


def run_last(x: Column) -> Running:
    """The last present value up to the row."""
    last = F.max_by(x, F.when(x.isNotNull(), F.col(POS)))
    return Running(lambda w: F.last(x, True).over(w), last, lambda t, w: F.last(t, True).over(w), lambda c, v: F.coalesce(v, c))


def run_next(x: Column) -> Running:
    """The next present value from the row on; use with backwards=True."""
    first = F.min_by(x, F.when(x.isNotNull(), F.col(POS)))
    return Running(lambda w: F.last(x, True).over(w), first, lambda t, w: F.last(t, True).over(w), lambda c, v: F.coalesce(v, c))


def running(df: DataFrame, outputs: Mapping[str, Running], backwards: bool = False, block: int = BLOCK) -> DataFrame:
    """df with running columns over all rows up to each (or, backwards, from each on)."""
    key = F.col(POS).desc() if backwards else F.col(POS)
    over = Window.partitionBy("__blk").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__blk", _block(block))
    totals = rows.groupBy("__blk").agg(*[r.total.alias(f"__t{i}") for i, r in enumerate(outputs.values())])
    blocks = Window.orderBy(F.col("__blk").desc() if backwards else F.col("__blk")).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select("__blk", *[r.carry(F.col(f"__t{i}"), blocks).alias(f"__c{i}") for i, r in enumerate(outputs.values())])
    inside = rows.select("*", *[r.inside(over).alias(f"__i{i}") for i, r in enumerate(outputs.values())])
    joined = inside.join(carries, "__blk")
    return joined.select(*df.columns, *[r.join(F.col(f"__c{i}"), F.col(f"__i{i}")).alias(n) for i, (n, r) in enumerate(outputs.items())])


def ranks(df: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """df with `__min`, `__max` (first and last rank of the value's ties) and `__n`; NULL for absent values. Rank of the order of appearance: see rank_first.

    Values are counted first, so that ties cost one row; the distinct values are
    numbered and their counts summed in blocks.
    """
    kept = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__k"))
    upto = running(number_rows(kept, ["__v"], ties=False), {"__max": run_sum(F.col("__k"))}, block=block)
    upto = upto.select("__v", F.col("__max"), (F.col("__max") - F.col("__k") + 1).alias("__min"))
    out = df.join(upto, F.col(value) == F.col("__v"), "left").drop("__v")
    return out


def rank(df: DataFrame, value: str, out: str, method: str = "average", block: int = BLOCK) -> DataFrame:
    """df with the rank of `value` among the present values, from 1, a double: average, min, max or first among ties (first: by position).

    Absent values have no rank; NaN ranks behind all numbers.
    """
    if method == "first":
        kept = number_rows(df.where(F.col(value).isNotNull()).withColumnRenamed(POS, "__old"), [value, "__old"], ties=False)
        placed = kept.select(*[F.col("__old").alias(POS)], F.col(POS).cast("double").alias(out))
        return df.join(placed, POS, "left")
    rows = ranks(df, value, block)
    rule = {"min": F.col("__min"), "max": F.col("__max"), "average": (F.col("__min") + F.col("__max")) / 2}
    if method not in rule:
        raise ValueError(f"method: {method!r}")
    return rows.select(*df.columns, rule[method].cast("double").alias(out))


# running medians

#: Bins of values by which earlier blocks are searched: two per block, within these bounds.
_FEWEST_BINS, _MOST_BINS = 256, 65_536


def _medians_of_block(values: np.ndarray, present: np.ndarray, earlier: np.ndarray, times: np.ndarray, below: int, before: int) -> np.ndarray:
    """The medians up to each row of a block; NaN without any value.

    `earlier` are the distinct earlier values near the median and `times` how
    often they occur, `below` how many earlier values lie under them, `before`
    how many there are in all. All values are put in one sorted chain and taken
    out again from the last row on, so that the middle moves by a link or two.
    """
    own = values[present]
    x, at = np.unique(np.r_[earlier, own], return_inverse=True)
    place, own_at = at[: len(earlier)], at[len(earlier) :]
    count = np.bincount(place, times, len(x)).astype(np.int64) + np.bincount(own_at, minlength=len(x))
    n, levels, out = before + len(own), x.tolist(), np.full(len(values), np.nan)
    if not n or not len(x):
        return out
    target = (n - 1) // 2
    upto = below + np.cumsum(count)
    i = min(int(np.searchsorted(upto, target, "right")), len(x) - 1)
    less = int(upto[i] - count[i])
    counts, after, ahead = count.tolist(), list(range(1, len(x) + 1)), list(range(-1, len(x) - 1))
    taken = own_at.tolist()
    for row in range(len(values) - 1, -1, -1):
        if n:
            middle = levels[i]
            if n % 2 == 0 and less + counts[i] <= target + 1:
                middle = (middle + levels[after[i]]) / 2
            out[row] = middle
        if not present[row]:
            continue
        j = taken.pop()
        n -= 1
        counts[j] -= 1
        less -= j < i
        if not counts[j]:
            p, q = ahead[j], after[j]
            if p >= 0:
                after[p] = q
            if q < len(levels):
                ahead[q] = p
            if j == i:
                if q < len(levels):
                    i = q
                elif p >= 0:
                    i = p
                    less -= counts[p]
        if not n:
            continue
        target = (n - 1) // 2
        while less > target and ahead[i] >= 0:
            i = ahead[i]
            less -= counts[i]
        while less + counts[i] <= target and after[i] < len(levels):
            less += counts[i]
            i = after[i]
    return out


def running_median(df: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """df (numbered, stored) with the exact median of all present values up to each row; NULL before the first, NaN behind all numbers.

    A block's rows can move the middle by half their number only. Earlier values
    are counted in bins of about equal content; a block gets the distinct values
    of the bins around its middle, with counts, and how many lie below. So a
    block costs its own rows and about as many earlier ones, ties counting once.
    The table of bins passes through one task, a row per block at a time.
    """
    x = F.col(value).cast("double")
    rows = df.select(POS, x.alias("x"), _block(block).alias("b"))
    n = rows.count()
    bins = min(_MOST_BINS, max(_FEWEST_BINS, 2 * -(-n // block)))
    edges = rows.where(~F.isnan("x")).agg(F.percentile_approx("x", [k / bins for k in range(1, bins)], 10_000)).first()[0] or []
    edges = np.unique(np.array(edges, float))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(edges, batch.column(1).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), batch.column(2)], names=["b", "x", "bin", "n"])

    counted = rows.where(F.col("x").isNotNull()).groupBy("b", "x").agg(F.count("*").alias("n"))
    counted = materialize(counted.mapInArrow(binned, "b long, x double, bin int, n long"), "binned")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            made: list[tuple] = []
            for b, size, cells in zip(*(batch.column(i).to_pylist() for i in range(3))):
                before = int(total.sum())
                upto = np.cumsum(total)
                reach = size // 2 + 2
                lo = int(np.searchsorted(upto, max(0, (before - 1) // 2 - reach), "right"))
                hi = int(np.searchsorted(upto, min(max(before - 1, 0), before // 2 + reach), "right"))
                lo, hi = min(lo, len(edges)), min(hi, len(edges))
                made.append((b, before, int(upto[lo] - total[lo]), lo, hi))
                for c in cells:
                    total[c["bin"]] += c["n"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["b", "before", "below", "lo", "hi"])

    cells = counted.groupBy("b", "bin").agg(F.sum("n").alias("n")).groupBy("b").agg(F.sum("n").alias("size"), F.collect_list(F.struct("bin", "n")).alias("cells"))
    every = rows.select("b").distinct().join(cells, "b", "left").select("b", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("cells", F.array()).alias("cells"))
    span = materialize(every.repartition(1).sortWithinPartitions("b").mapInArrow(spans, "b long, before long, below long, lo int, hi int"), "spans")
    wanted = span.where("before > 0").select(F.col("b").alias("to"), F.explode(F.sequence("lo", "hi")).alias("bin"))
    near = counted.join(wanted, "bin").where(F.col("b") < F.col("to")).groupBy(F.col("to").alias("b"), "x").agg(F.sum("n").alias("n"))
    nothing = F.lit(None).cast("long")
    own = rows.join(span, "b").select("b", POS, "x", nothing.alias("n"), "before", "below")
    both = own.unionByName(near.select("b", nothing.alias(POS), "x", "n", nothing.alias("before"), nothing.alias("below")))

    def work(group: pa.Table) -> pa.Table:
        earlier = group.filter(pc.is_valid(group.column("n")))
        mine = group.filter(pc.is_null(group.column("n"))).sort_by(POS)
        present = pc.is_valid(mine.column("x")).to_numpy()
        medians = _medians_of_block(mine.column("x").to_numpy(), present, earlier.column("x").to_numpy(), earlier.column("n").to_numpy(), mine.column("below")[0].as_py(), mine.column("before")[0].as_py())
        known = (np.cumsum(present) > 0) | (mine.column("before")[0].as_py() > 0)
        return pa.table({"__at": mine.column(POS), out: pa.array(medians, mask=~known)})

    found = both.groupBy("b").applyInArrow(work, f"__at long, `{out}` double")
    return df.join(found, F.col(POS) == F.col("__at"), "left").drop("__at")
