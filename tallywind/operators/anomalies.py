"""Implausible values in measurements, judged against their own source: spikes, stuck runs, impossible readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .parts import Edges, cut_edges, each_part, joined_edges, store_parts, with_facts

#: Readings of context on either side that the outlier tests look at.
_CONTEXT = 3
#: A residual this many robust scales wide makes a reading a candidate; far below any limit in use.
_CANDIDATE = 5.0
#: Coefficients of the autoregressions lie within this.
_PHI = 0.5
#: Valid prices, rows sent again not counted, on either side that a price's test may depend on: a test looks at _CONTEXT,
#: and each repetition of it, without the outliers found so far, at _CONTEXT more.
REACH = 64
#: Bits of a double that a histogram bin leaves out at first (bins of 1/4096 octave) and, where a bin holds more values than _MANY, next.
_COARSE, _FINE, _MANY = 40, 20, 5_000_000


def _around(x: np.ndarray, start: np.ndarray, series: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The _CONTEXT readings from each start on; NaN beyond the ends of the own series."""
    at = start[:, None] + np.arange(_CONTEXT)
    near = np.clip(at, 0, len(x) - 1)
    return np.where((at >= 0) & (at < len(x)) & (series[near] == own[:, None]), x[near], np.nan)


def _middle(a: np.ndarray) -> np.ndarray:
    """Median of each row, NaN passed over."""
    a = np.sort(a, axis=1)
    n = np.maximum(np.count_nonzero(~np.isnan(a), axis=1), 1)
    row = np.arange(len(a))
    return (a[row, (n - 1) // 2] + a[row, n // 2]) / 2


def additive_outliers(x: np.ndarray, scale: float | np.ndarray, phi: float | np.ndarray, limit: float, longest: int = 3, series: np.ndarray | None = None) -> np.ndarray:
    """Mask of the spikes of a positive series: blocks of one to `longest` readings that leave the level and return.

    Residuals of an autoregression of the log steps (coefficient phi, previous
    step clipped) give the candidates. For each block that starts at one, the
    additive-outlier hypothesis wants every reading of the block further than
    `limit` scales from the level around it, and the readings just before and
    after it, and the levels before and after, in agreement; else the change is
    a level shift and stays. Found outliers are taken out and the test repeats
    until nothing new is found. With a scale of 0 any departure that returns is
    one; without a scale nothing is flagged. Several series may follow each
    other in x: `series` numbers them, scale and phi have a value per reading.
    """
    flagged = np.zeros(len(x), bool)
    scale, phi = np.broadcast_to(np.asarray(scale, float), x.shape), np.broadcast_to(np.asarray(phi, float), x.shape)
    series = np.zeros(len(x), np.int64) if series is None else series
    alive = np.flatnonzero(np.isfinite(scale) & (scale >= 0))
    log = np.log(x)
    while len(alive) > 2:
        v, s, g = x[alive], scale[alive], series[alive]
        joined = g[1:] == g[:-1]
        step = np.where(joined, np.diff(log[alive]), 0.0)
        wide = _CANDIDATE * s[1:]
        residual = step.copy()
        residual[1:] -= phi[alive][2:] * np.clip(step[:-1], -wide[1:], wide[1:])
        starts = np.flatnonzero((np.abs(residual) > wide) & joined) + 1
        found = np.zeros(len(v), bool)
        for length in range(1, longest + 1):
            i = starts[starts + length < len(v)]
            i = i[g[i + length] == g[i]]
            if not len(i):
                continue
            before, after = _around(v, i - _CONTEXT, g, g[i]), _around(v, i + length, g, g[i])
            level = _middle(np.hstack([before, after]))
            block = np.min([np.abs(v[i + k] / level - 1) for k in range(length)], axis=0)
            near = np.max([np.abs(v[i - 1] / level - 1), np.abs(v[i + length] / level - 1), np.abs(_middle(after) / _middle(before) - 1)], axis=0)
            for k in i[(block > limit * s[i]) & (near < block / 2)]:
                if not found[k : k + length].any():
                    found[k : k + length] = True
        if not found.any():
            break
        flagged[alive[found]] = True
        alive = alive[~found]
    return flagged


def stuck_runs(x: np.ndarray, shortest: int, series: np.ndarray | None = None) -> np.ndarray:
    """Mask of the values that belong to a run of `shortest` or more equal successive values of one series."""
    if not len(x):
        return np.zeros(0, bool)
    change = x[1:] != x[:-1]
    if series is not None:
        change |= series[1:] != series[:-1]
    cut = np.flatnonzero(np.r_[True, change])
    length = np.diff(np.r_[cut, len(x)])
    return np.repeat(length >= shortest, length)


def high_volumes(v: np.ndarray, usual: np.ndarray, phi: np.ndarray, times: float, series: np.ndarray) -> np.ndarray:
    """Mask of the volumes above `times` their source's usual one.

    An autoregression of the log volumes around the usual one, the previous
    deviation clipped, gives the candidates: with coefficients within 1/2 every
    volume above the limit has a residual of half the limit's logarithm at
    least, whatever came before. The limit itself is the exact check.
    """
    limit = np.log(times)
    y = np.log(np.where(v > 0, v, np.nan)) - np.log(usual)
    before = np.r_[np.nan, y[:-1]]
    before[np.r_[True, series[1:] != series[:-1]]] = np.nan
    residual = y - phi * np.clip(np.nan_to_num(before), -limit, limit)
    return (residual >= limit / 2 - 1e-9) & (v > times * usual)


# what a part is read as

#: Sequences of elements that are judged by their neighbours: valid prices without rows sent again, present prices, present volumes.
_PRICES, _STILL_PRICE, _STILL_VOLUME = 0, 1, 2
_READ = ("part", "sid", "quote_id", "ms", "price", "volume")


class _Part:
    """The readings of a part in order, as arrays, and its sequences of elements."""

    def __init__(self, table: pa.Table) -> None:
        sid, ids, ms, price = (table.column(c).to_numpy() for c in ("sid", "quote_id", "ms", "price"))
        present, volume = pc.is_valid(table.column("volume")).to_numpy(), pc.fill_null(table.column("volume"), 0).to_numpy()
        order = np.lexsort((ids, ms, sid))
        i, j = order[1:], order[:-1]
        if ((sid[i] == sid[j]) & (ms[i] == ms[j]) & (ids[i] == ids[j])).any():  # repeated rows: in one fixed order
            order = np.lexsort((volume, price, ids, ms, sid))
        self.order = order
        self.sid, self.ids, self.ms, self.price, self.volume, self.has_volume = (a[order] for a in (sid, ids, ms, price, volume, present))
        self.series = np.r_[0, np.cumsum(self.sid[1:] != self.sid[:-1])]
        valid = np.flatnonzero((self.price > 0) & np.isfinite(self.price))
        # the first of the valid rows of one source, moment and price; of each other one the place of its first
        shared = np.r_[False, (np.diff(self.ms[valid]) == 0) & (np.diff(self.series[valid]) == 0)]
        shared |= np.r_[shared[1:], False]
        again, first = [], []
        if shared.any():
            at = valid[shared]
            at = at[np.lexsort((at, self.price[at], self.ms[at], self.series[at]))]
            new = np.r_[True, (np.diff(self.series[at]) != 0) | (np.diff(self.ms[at]) != 0) | (np.diff(self.price[at]) != 0)]
            group = np.cumsum(new) - 1
            again, first = at[~new], at[new][group[~new]]
        self.again, self.first = np.asarray(again, np.int64), np.asarray(first, np.int64)
        sent = np.zeros(len(self.sid), bool)
        sent[self.again] = True
        self.elements = {_PRICES: valid[~sent[valid]], _STILL_PRICE: np.flatnonzero(~np.isnan(self.price)), _STILL_VOLUME: np.flatnonzero(self.has_volume)}

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the valid prices whose predecessor is in this part, and their relative steps."""
        u = self.elements[_PRICES]
        joined = self.series[u][1:] == self.series[u][:-1]
        return u[1:][joined], _steps(self.price[u])[joined]

    def edges(self, stream: int, need: int) -> Edges:
        return cut_edges(self.series[self.elements[stream]], need)


def _steps(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.abs(x[1:] / x[:-1] - 1)


def _bins(x: np.ndarray, shift: int) -> np.ndarray:
    """Bins of doubles that are not negative, in their order: the leading bits. Shift 0 keeps each value apart."""
    return np.ascontiguousarray(x + 0.0, np.float64).view(np.int64) >> shift


def _counted(series: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct pair of series and bin, and how often it occurs."""
    order = np.lexsort((bins, series))
    s, b = series[order], bins[order]
    cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1])]) if len(s) else np.zeros(0, np.int64)
    return s[cut], b[cut], np.diff(np.r_[cut, len(s)])


_STEP, _VOLUME = 0, 1  # what medians are taken of
_IMPOSSIBLE, _SPIKE, _STUCK = 1, 2, 4


_COUNTS = "tag int, sid long, kind int, coarse long, bin long, low double, n long, xy double, xx double, vxy double, vxx double"
_SURVEY = "tag int, stream int, part int, side int, place int, twin boolean, sid long, quote_id long, ms long, price double, volume long, settled boolean, through boolean, kind int, bin long, low double, n long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(schema: str, **columns: np.ndarray | int | str) -> pa.RecordBatch:
    """A batch of a schema; single values are repeated, columns not named are NULL."""
    fields = [f.split(" ") for f in schema.split(", ")]
    n = max(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    arrays = []
    for name, kind in fields:
        c = columns.get(name)
        arrays.append(pa.array(c, _ARROW[kind]) if isinstance(c, np.ndarray) else pa.repeat(pa.scalar(c, _ARROW[kind]), n))
    return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])


def _low(bins: np.ndarray, shift: int) -> np.ndarray:
    return (bins << shift).view(np.float64)


def _survey(needs: dict[int, int]) -> object:
    """First pass: histograms of steps and positive volumes per source, and the edges of each sequence."""

    def process(table: pa.Table) -> Iterator[pa.RecordBatch]:
        p, part = _Part(table), table.column("part")[0].as_py()
        at, steps = p.steps()
        traded = np.flatnonzero(p.has_volume & (p.volume > 0))
        for kind, places, values in ((_STEP, at, steps), (_VOLUME, traded, p.volume[traded].astype(float))):
            series, bins, n = _counted(p.series[places], _bins(values, _COARSE))
            if len(n):
                first = np.searchsorted(p.series, series)
                yield _batch(_SURVEY, tag=0, kind=kind, sid=p.sid[first], bin=bins, low=_low(bins, _COARSE), n=n)
        for stream, need in needs.items():
            e, edges = p.elements[stream], p.edges(stream, need)
            if not len(e):
                continue
            yield _batch(_SURVEY, tag=2, stream=stream, part=np.array([part]), through=edges.through)
            for k, (lo, hi, settled_from, settled_to) in enumerate(edges.pieces):
                place = np.arange(lo, hi)
                rows, twin = e[lo:hi], np.zeros(hi - lo, bool)
                if stream == _PRICES and len(p.again):
                    of = np.searchsorted(e, p.first)
                    mine = (of >= lo) & (of < hi)
                    rows, place, twin = np.r_[rows, p.again[mine]], np.r_[place, of[mine]], np.r_[twin, np.ones(mine.sum(), bool)]
                settled = (place >= settled_from) & (place < settled_to)
                side = 1 if edges.through else k
                yield _batch(_SURVEY, tag=1, stream=stream, part=part, side=side, place=place, twin=twin, sid=p.sid[rows], quote_id=p.ids[rows], ms=p.ms[rows], price=p.price[rows], volume=p.volume[rows], settled=settled)

    return each_part(process)


def _within(shift: int, finer: int, volume_times: float) -> object:
    """Later passes: finer counts within the bins that hold the medians; with the coarse bins also the sums of the autoregressions."""

    def process(table: pa.Table) -> Iterator[pa.RecordBatch]:
        p = _Part(table)
        fact = lambda c: pc.fill_null(table.column(c), -1).to_numpy()[p.order]
        at, steps = p.steps()
        traded = np.flatnonzero(p.has_volume & (p.volume > 0))
        for kind, places, values, names in ((_STEP, at, steps, ("s0", "s1")), (_VOLUME, traded, p.volume[traded].astype(float), ("v0", "v1"))):
            bins = _bins(values, shift)
            take = (bins == fact(names[0])[places]) | (bins == fact(names[1])[places])
            series, inner, n = _counted(p.series[places[take]], _bins(values[take], finer))
            if len(n):
                yield _batch(_COUNTS, tag=0, kind=kind, sid=p.sid[np.searchsorted(p.series, series)], coarse=inner >> (shift - finer), bin=inner, low=_low(inner, finer), n=n)
        if shift != _COARSE:
            return
        groups = int(p.series[-1]) + 1
        width, usual = (table.column(c).to_numpy()[p.order] for c in ("w", "u"))
        u = p.elements[_PRICES]
        r = np.diff(np.log(p.price[u]))
        joined = (p.series[u][2:] == p.series[u][:-2]) & ~np.isnan(width[u][2:])
        s, w = p.series[u][2:][joined], width[u][2:][joined]
        y, x = np.clip(r[1:][joined], -w, w), np.clip(r[:-1][joined], -w, w)
        e = np.flatnonzero(p.has_volume & (p.volume > 0) & ~np.isnan(usual))
        limit, z = np.log(volume_times), np.log(p.volume[e].astype(float) / usual[e])
        z = np.clip(z, -limit, limit)
        sv, zy, zx = p.series[e][1:], z[1:], z[:-1]
        near = p.series[e][1:] == p.series[e][:-1]
        sums = [np.bincount(a, b, groups) for a, b in ((s, x * y), (s, x * x), (sv[near], (zy * zx)[near]), (sv[near], (zx * zx)[near]))]
        yield _batch(_COUNTS, tag=1, sid=p.sid[np.searchsorted(p.series, np.arange(groups))], **dict(zip(("xy", "xx", "vxy", "vxx"), sums)))

    return each_part(process)


_CASES = "sid long, quote_id long, field string, code int"


def _judge(spike_steps: float, volume_times: float, stuck: int, needs: dict[int, int]) -> object:
    """Last pass: what can be told within a part."""

    def process(table: pa.Table) -> Iterator[pa.RecordBatch]:
        p = _Part(table)
        scale, phi, usual, vphi = (table.column(c).to_numpy()[p.order] for c in ("scale", "phi", "usual", "vphi"))
        price, volume = np.zeros(len(p.sid), np.int32), np.zeros(len(p.sid), np.int32)
        e = p.elements[_STILL_PRICE]
        x = p.price[e]
        price[e[(x <= 0) | np.isinf(x)]] |= _IMPOSSIBLE
        price[e[stuck_runs(x, stuck, p.series[e]) & p.edges(_STILL_PRICE, needs[_STILL_PRICE]).inside]] |= _STUCK
        u = p.elements[_PRICES]
        hit = additive_outliers(p.price[u], scale[u], phi[u], spike_steps, series=p.series[u]) & p.edges(_PRICES, needs[_PRICES]).inside
        price[u[hit]] |= _SPIKE
        price[p.again[price[p.first] & _SPIKE > 0]] |= _SPIKE
        e = p.elements[_STILL_VOLUME]
        v = p.volume[e]
        volume[e[v < 0]] |= _IMPOSSIBLE
        volume[e[high_volumes(v, usual[e], vphi[e], volume_times, p.series[e])]] |= _SPIKE
        volume[e[stuck_runs(v, stuck, p.series[e]) & (v != 0) & p.edges(_STILL_VOLUME, needs[_STILL_VOLUME]).inside]] |= _STUCK
        for field, code in (("price", price), ("volume", volume)):
            at = np.flatnonzero(code)
            if len(at):
                yield _batch(_CASES, sid=p.sid[at], quote_id=p.ids[at], field=field, code=code[at])

    return each_part(process)


def _judge_meeting(spike_steps: float, stuck: int) -> object:
    """The edges of neighbouring parts put together: what cannot be told within a part."""

    def process(batch: pd.DataFrame) -> pd.DataFrame:
        b = batch.sort_values(["part", "place", "twin"], kind="stable")
        stream, sid, twin, settled = b["stream"].iloc[0], b["sid"].to_numpy(), b["twin"].to_numpy(bool), b["settled"].to_numpy(bool)
        own = ~twin
        series = np.r_[0, np.cumsum(np.diff(sid[own]) != 0)]
        if stream == _PRICES:
            hit = additive_outliers(b["price"].to_numpy(float)[own], b["scale"].to_numpy(float)[own], b["phi"].to_numpy(float)[own], spike_steps, series=series)
            hit = hit[np.cumsum(own) - 1]  # rows sent again follow their first
        elif stream == _STILL_PRICE:
            hit = stuck_runs(b["price"].to_numpy(float), stuck, series)
        else:
            v = b["volume"].to_numpy()
            hit = stuck_runs(v, stuck, series) & (v != 0)
        hit &= settled
        found = pd.DataFrame({"sid": sid[hit], "quote_id": b["quote_id"].to_numpy()[hit]})
        found["field"] = "volume" if stream == _STILL_VOLUME else "price"
        return found.assign(code=_SPIKE if stream == _PRICES else _STUCK)

    return process


def _crossing(batch: pd.DataFrame) -> pd.DataFrame:
    """Of the prices at a meeting: the steps from part to part, as bits, and the pairs of log steps that lie in several parts."""
    b = batch.sort_values(["part", "place"], kind="stable")
    sid, part, x = b["sid"].to_numpy(), b["part"].to_numpy(), b["price"].to_numpy(float)
    at = np.flatnonzero((sid[1:] == sid[:-1]) & (part[1:] != part[:-1]))
    step = _steps(x)[at]
    one = pd.DataFrame({"sid": sid[1:][at], "bits": _bins(step, 0), "step": step, "low": _low(_bins(step, _COARSE), _COARSE)})
    at = np.flatnonzero((sid[2:] == sid[:-2]) & (part[2:] != part[:-2]))
    r = np.diff(np.log(x))
    two = pd.DataFrame({"sid": sid[2:][at], "y": r[1:][at], "x": r[:-1][at]})
    return pd.concat([one.astype({"bits": "Int64"}), two]).reindex(columns=["sid", "bits", "step", "low", "y", "x"])


def _targets(counts: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The bins that hold the two middle ranks of each source and kind: sid, kind, target, bin, low, rank within it, held.

    `counts` are counts per bin; with `before`, the targets of the coarser bins, per finer bin within those.
    """
    if before is None:
        whole = Window.partitionBy("sid", "kind")
        place = (F.sum("n").over(whole) - 1) / 2
        ranks = F.array(*[F.struct(F.lit(t).alias("target"), f(place).cast("long").alias("rank")) for t, f in ((0, F.floor), (1, F.ceil))])
        rows = counts.select("sid", "kind", "bin", "low", "n", F.sum("n").over(whole.orderBy("bin")).alias("upto"), ranks.alias("ranks")).select("*", F.inline("ranks"))
    else:
        rows = counts.join(before.select("sid", "kind", "target", F.col("bin").alias("coarse"), "rank"), ["sid", "kind", "coarse"])
        rows = rows.withColumn("upto", F.sum("n").over(Window.partitionBy("sid", "kind", "target").orderBy("bin")))
    start = F.col("upto") - F.col("n")
    return rows.where((F.col("rank") >= start) & (F.col("rank") < F.col("upto"))).select("sid", "kind", "target", "bin", "low", (F.col("rank") - start).alias("rank"), F.col("n").alias("held"))


def _numbered(kept: DataFrame) -> tuple[DataFrame, int]:
    """The sources and their numbers (source, sid), 64-bit hashes by the seed returned, under which no two sources share a number."""
    sources = materialize(kept.select("source").distinct(), "sources")
    seed = 0
    while True:
        names = sources.select("source", F.xxhash64(F.lit(seed), "source").alias("sid"))
        if not names.groupBy("sid").count().where("count > 1").limit(1).count():
            return names, seed
        seed += 1


def _facts(parts: DataFrame, survey: DataFrame, edges: DataFrame, volume_times: float) -> DataFrame:
    """One row per source: the exact median step (scale) and median positive volume (usual), and the coefficients phi, vphi."""
    prices = edges.where((F.col("stream") == _PRICES) & ~F.col("twin"))
    crossing = materialize(prices.select("meeting", "sid", "part", "place", "price").groupBy("meeting").applyInPandas(_crossing, "sid long, bits long, step double, low double, y double, x double"), "crossing")

    def crossed(shift: int, low: str) -> DataFrame:
        return crossing.where("bits is not null").select("sid", F.lit(_STEP).alias("kind"), F.shiftright("bits", shift).alias("bin"), F.col(low).alias("low"), F.lit(1).cast("long").alias("n"))

    counts = survey.where("tag = 0").select("sid", "kind", "bin", "low", "n").unionByName(crossed(_COARSE, "low"))
    counts = counts.groupBy("sid", "kind", "bin").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
    targets, shift, sums = materialize(_targets(counts), "targets"), _COARSE, []
    pick = lambda value, kind, target: F.max(F.when((F.col("kind") == kind) & (F.col("target") == target), F.col(value)))
    while shift:
        most = targets.agg(F.max("held")).first()[0] or 0  # one number
        finer = _FINE if most > _MANY and shift > _FINE else 0
        wanted = targets.groupBy("sid").agg(pick("bin", _STEP, 0).alias("s0"), pick("bin", _STEP, 1).alias("s1"), pick("bin", _VOLUME, 0).alias("v0"), pick("bin", _VOLUME, 1).alias("v1"), (_CANDIDATE * pick("low", _STEP, 0)).alias("w"), pick("low", _VOLUME, 0).alias("u"))
        wanted = materialize(wanted, "wanted")
        found = materialize(with_facts(parts, wanted, "sid").select(*_READ, "s0", "s1", "v0", "v1", "w", "u").mapInArrow(_within(shift, finer, volume_times), _COUNTS), "within")
        if shift == _COARSE:
            clip = lambda c: F.least(F.greatest(F.col(c), -F.col("w")), F.col("w"))
            pairs = crossing.where("y is not null").join(wanted.where("w is not null").select("sid", "w"), "sid").select("sid", (clip("x") * clip("y")).alias("xy"), (clip("x") * clip("x")).alias("xx"))
            sums.append(found.where("tag = 1").select("sid", "xy", "xx", "vxy", "vxx").unionByName(pairs, allowMissingColumns=True))
        inner = found.where("tag = 0").select("sid", "kind", "coarse", "bin", "low", "n")
        near = crossed(finer, "step").withColumn("coarse", F.shiftright("bin", shift - finer))
        counts = inner.unionByName(near).groupBy("sid", "kind", "coarse", "bin").agg(F.min("low").alias("low"), F.sum("n").alias("n"))
        targets, shift = materialize(_targets(counts, targets), "targets"), finer
    middle = lambda kind: (pick("low", kind, 0) + pick("low", kind, 1)) / 2
    within = lambda a, b: F.coalesce(F.least(F.greatest(F.try_divide(F.sum(a), F.sum(b)), F.lit(-_PHI)), F.lit(_PHI)), F.lit(0.0))
    phi = sums[0].groupBy("sid").agg(within("xy", "xx").alias("phi"), within("vxy", "vxx").alias("vphi"))
    return materialize(targets.groupBy("sid").agg(middle(_STEP).alias("scale"), middle(_VOLUME).alias("usual")).join(phi, "sid", "full"), "facts")


def flag_implausible(
    readings: DataFrame,
    spike_steps: float = 25.0,
    volume_times: float = 1000.0,
    stuck: int = 20,
    shard_rows: int = 200_000,
) -> DataFrame:
    """The implausible values of `readings` (source, quote_id, ms, price, volume): source, quote_id, field, reasons.

    Readings of a source are ordered by ms, then quote_id; a field that is NULL
    or NaN is passed over. Reasons, joined by a comma: `impossible` (price
    infinite, zero or negative; volume negative), `spike` (see
    additive_outliers, scale: the source's median relative step between
    successive prices, rows sent again not counted; for volume see
    high_volumes: above `volume_times` the source's median of the volumes above
    zero), `stuck` (run of `stuck` or more equal values; zero volumes never). A
    row sent again (same source, moment and price) is judged like its twin. In a
    source whose median step is 0 every price that leaves the level and returns
    is a spike; with fewer than two prices there is none. Rows with a null
    source, quote_id or ms are left out. One row per source, quote_id and field:
    of rows with one quote_id all reasons. An empty table gives an empty result;
    extra columns are ignored.

    Readings are stored in parts of about `shard_rows` rows, cut by rank: a busy
    source, day or hour is spread over parts, only the readings of a source at
    one millisecond share one. Medians are exact: histograms over all readings,
    then the values in the middle bins. Tests run within each part; the outermost
    readings of a part (REACH valid prices, `stuck` values) are judged together
    with those of its neighbour, so that cuts do not change a result.
    """
    rows = readings.where(F.col("source").isNotNull() & F.col("quote_id").isNotNull() & F.col("ms").isNotNull())
    kept = materialize(rows.select("source", F.col("quote_id").cast("long"), F.col("ms").cast("long"), F.col("price").cast("double"), F.col("volume").cast("long")), "readings")
    names, seed = _numbered(kept)
    numbered = kept.select(F.xxhash64(F.lit(seed), "source").alias("sid"), "quote_id", "ms", "price", "volume")
    parts = store_parts(numbered, ["sid", "ms"], shard_rows).select(*_READ)
    needs = {_PRICES: REACH, _STILL_PRICE: stuck, _STILL_VOLUME: stuck}
    survey = materialize(parts.mapInArrow(_survey(needs), _SURVEY), "survey")
    edges = survey.where("tag = 1").select("stream", "part", "side", "place", "twin", "sid", "quote_id", "ms", "price", "volume", "settled")
    edges = materialize(joined_edges(edges, survey.where("tag = 2").select("stream", "part", "through")), "edges")
    facts = _facts(parts, survey, edges, volume_times)
    inside = with_facts(parts, facts, "sid").select(*_READ, "scale", "phi", "usual", "vphi").mapInArrow(_judge(spike_steps, volume_times, stuck, needs), _CASES)
    met = edges.join(facts, "sid", "left").groupBy("stream", "meeting").applyInPandas(_judge_meeting(spike_steps, stuck), _CASES)
    cases = inside.unionByName(met).groupBy("sid", "quote_id", "field").agg(F.bit_or("code").alias("code"))
    reasons = F.concat_ws(",", *[F.when(F.col("code").bitwiseAND(F.lit(b)) > 0, n) for b, n in ((_IMPOSSIBLE, "impossible"), (_SPIKE, "spike"), (_STUCK, "stuck"))])
    return cases.join(names, "sid").select("source", "quote_id", "field", reasons.alias("reasons"))
