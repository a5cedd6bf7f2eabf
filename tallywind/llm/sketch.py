"""Percentiles of numeric columns from dyadic Count-Sketches that add up.

A value becomes a code of 24 bits that keeps its order: sign, exponent and 12
bits of mantissa. For every binary resolution (code >> j) there is one signed
Count-Sketch, at the coarser resolutions exact counts; a rank is inverted by
descending from the coarsest level to the finest. Sketches are linear: they are
merged by addition and rows are taken out again by adding their negation.

Error: a value is within 2**-13 of itself (relatively) by its code. At each of
the 12 sketched levels a node's count is off by at most sqrt(8 * F2 / WIDTH)
in one row with probability 7/8 or more, F2 being the sum of squared counts of
the other nodes there, and the median of DEPTH rows makes that far likelier;
nodes that do not collide are exact. Ranks therefore err by at most the sum over
the levels on the path, in practice well under one percent.

A state is a row: the group, `n`, and either pending updates (`codes`,
`counts`) or, beyond PENDING of them, the counters (`dense`). Pending updates are
applied to the counters when the state is asked or grows; since the sketch is
linear this changes nothing in the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 24
EXACT_BITS = 12  # levels of up to 2**12 nodes are counted exactly
LEVELS = BITS - EXACT_BITS  # sketched ones: code >> 0 .. code >> 11
DEPTH, WIDTH_BITS = 5, 11
WIDTH = 1 << WIDTH_BITS
PENDING = 4096
_TABLE = LEVELS * DEPTH * WIDTH
SIZE = _TABLE + (1 << EXACT_BITS)
_FLUSH = 500_000  # rows gathered before they are grouped
_TOGETHER = 24  # groups whose counters are held at once

_random = np.random.default_rng(7)
_MULTIPLY = _random.integers(1, 2**63, (LEVELS, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 2**63, (LEVELS, DEPTH), dtype=np.uint64)


def encode(x: np.ndarray) -> np.ndarray:
    """Codes of doubles, in the order of the values; -0.0 as 0.0."""
    bits = (np.asarray(x, np.float64) + 0.0).view(np.int64) >> (64 - BITS)
    return np.where(bits < 0, ~bits & ((1 << (BITS - 1)) - 1), bits + (1 << (BITS - 1)))


def decode(code: np.ndarray) -> np.ndarray:
    """The middle of the values that have the code; zero and infinities exactly."""
    top = 1 << (BITS - 1)
    code = np.asarray(code, np.int64)
    size = np.where(code >= top, code - top, top - 1 - code)
    low = (size << (64 - BITS)).view(np.float64)
    high = ((size + 1) << (64 - BITS)).view(np.float64)
    with np.errstate(invalid="ignore"):  # the code above the largest number stands for no value
        middle = np.where((size == 0) | np.isinf(low) | ~np.isfinite(high), low, low / 2 + high / 2)
    return np.where(code >= top, middle, -middle)


def _place(node: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of nodes in a row of a level's sketch."""
    with np.errstate(over="ignore"):
        h = node.astype(np.uint64) * _MULTIPLY[level, row] + _ADD[level, row]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64), 1 - 2 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.int64)


def counters(group: np.ndarray, code: np.ndarray, count: np.ndarray, groups: int) -> np.ndarray:
    """Counters of `groups` sketches (a row each) after the updates (group, code, count)."""
    out = np.zeros((groups, SIZE))
    if not len(code):
        return out
    weight = count.astype(np.float64)  # exact up to 2**53
    for level in range(LEVELS):
        node = code >> level
        for row in range(DEPTH):
            at, sign = _place(node, level, row)
            lo = (level * DEPTH + row) * WIDTH
            out[:, lo : lo + WIDTH] = np.bincount(group * WIDTH + at, weight * sign, groups * WIDTH).reshape(groups, WIDTH)
    out[:, _TABLE:] = np.bincount((group << EXACT_BITS) + (code >> LEVELS), weight, groups << EXACT_BITS).reshape(groups, -1)
    return out


def invert(tables: np.ndarray, probabilities: Sequence[float]) -> np.ndarray:
    """Values at the given probabilities (lower of the two middle ranks for a median of even n), a row per sketch; NaN for empty ones."""
    exact = np.maximum(tables[:, _TABLE:], 0)
    upto = np.cumsum(exact, axis=1)
    total = upto[:, -1]
    rank = np.floor(np.maximum(total[:, None] - 1, 0) * np.asarray(probabilities)[None, :])
    node = np.stack([np.searchsorted(u, r, side="right") for u, r in zip(upto, rank)]) if len(tables) else np.zeros(rank.shape, int)
    node = np.minimum(node, (1 << EXACT_BITS) - 1)
    lines = np.arange(len(tables))[:, None]
    rank = rank - (upto[lines, node] - exact[lines, node])
    parent = exact[lines, node]
    for level in reversed(range(LEVELS)):
        left = node * 2
        sides = []
        for child in (left, left + 1):
            rows = []
            for row in range(DEPTH):
                at, sign = _place(child, level, row)
                rows.append(tables[lines, (level * DEPTH + row) * WIDTH + at] * sign)
            sides.append(np.median(rows, axis=0))
        # the children share out what the parent has
        first = np.clip(sides[0] + (parent - sides[0] - sides[1]) / 2, 0, parent)
        right = rank >= first
        rank = np.where(right, rank - first, rank)
        parent = np.where(right, parent - first, first)
        node = left + right
    return np.where(total[:, None] > 0, decode(node), np.nan)


def _state_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    more = [("field", T.StringType()), ("codes", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.LongType())), ("dense", T.BinaryType())]
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(n, t) for n, t in more])


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def _gid(columns: Sequence[pa.ChunkedArray | pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row by the columns' values, null being a value; and a row of each group."""
    key = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        at = pc.fill_null(pc.dictionary_encode(c, null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        _, key = np.unique(key * (int(at.max(initial=0)) + 1) + at, return_inverse=True)
    _, first, gid = np.unique(key, return_index=True, return_inverse=True)
    return gid, first


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """States of the values of df, per combination of the key columns and value column (`field`), as partial as the tasks are.

    NULL and NaN values are left out; null keys are keys; infinities are values
    at the ends. No shuffle: pass the result to merge(). Empty tables give none.
    """
    keys, values = list(keys), list(values)
    if {"field", "codes", "counts", "dense"} & set(keys):
        raise ValueError("a key has the name of a column of the states")
    schema = _state_schema(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            gid, first = _gid([table.column(i) for i in range(len(keys))])
            for i, name in enumerate(values):
                column = table.column(len(keys) + i)
                x = column.to_numpy()
                good = ~np.isnan(x)
                pair, count = np.unique((gid[good].astype(np.int64) << BITS) | encode(x[good]), return_counts=True)
                if not len(pair):
                    continue
                g = pair >> BITS
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                keyed = table.select(range(len(keys))).take(pa.array(first[g[starts]])).combine_chunks().to_batches()[0].columns
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [*keyed, pa.array([name] * n), _lists(pair & ((1 << BITS) - 1), starts, pa.int32()), _lists(count, starts, pa.int64()), pa.nulls(n, pa.binary())], names=schema.names
                )

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _FLUSH:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    doubles = [F.coalesce(F.col(v).cast("double"), F.lit(float("nan"))).alias(f"__v{i}") for i, v in enumerate(values)]
    return df.select(*keys, *doubles).mapInArrow(run, schema)


def _pack(table: np.ndarray) -> bytes:
    return zlib.compress(table.astype(np.int64).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64).astype(np.float64)


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One state per combination of the key columns (a subset of the states' own) and field: the sum of the states.

    States of a group arrive sorted and are added as they come, so a group's
    memory is bounded by one sketch however many states it has. Drop the key
    that is finest last (a load or a day): its states are the salt of hot groups.
    """
    keys = list(keys)
    schema = _state_schema(states, keys)
    k = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def add(table: pa.Table, last_open: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            gid, first = _gid([table.column(i) for i in range(k)])
            order = np.argsort(first)  # groups in the order of arrival
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            gid, first = place[gid], first[order]
            code_column, count_column = table.column("codes").combine_chunks(), table.column("counts").combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(code_column), 0).to_numpy().astype(np.int64)
            code, count = code_column.flatten().to_numpy().astype(np.int64), count_column.flatten().to_numpy().astype(np.int64)
            pair = (np.repeat(gid, sizes) << BITS) | code
            by = np.argsort(pair, kind="stable")
            pair, count = pair[by], count[by]
            cut = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
            pair, count = pair[cut], np.add.reduceat(count, cut) if len(cut) else count
            pair, count = pair[count != 0], count[count != 0]
            group, code = pair >> BITS, pair & ((1 << BITS) - 1)
            pending = np.bincount(group, minlength=len(first))
            dense: dict[int, np.ndarray] = {}
            for i, data in zip(gid.tolist(), table.column("dense").to_pylist()):
                if data is not None:
                    dense[i] = dense[i] + _unpack(data) if i in dense else _unpack(data)
            for i in sorted({*np.flatnonzero(pending > PENDING).tolist(), *dense}):
                mine = group == i
                applied = counters(np.zeros(int(mine.sum()), np.int64), code[mine], count[mine], 1)[0]
                dense[i] = dense[i] + applied if i in dense else applied
            keep = ~np.isin(group, list(dense))
            group, code, count = group[keep], code[keep], count[keep]
            starts = np.searchsorted(group, np.arange(len(first)))
            keyed = table.select(range(k)).take(pa.array(first)).combine_chunks().to_batches()[0].columns
            packed = pa.array([_pack(dense[i]) if i in dense else None for i in range(len(first))], pa.binary())
            out = pa.RecordBatch.from_arrays([*keyed, _lists(code, starts, pa.int32()), _lists(count, starts, pa.int64()), packed], names=schema.names)
            if not last_open:
                return out, None
            n = len(first) - 1
            return out.slice(0, n), pa.Table.from_batches([out.slice(n)])

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            out, held = add(fresh if held is None else pa.concat_tables([held, fresh.cast(held.schema)]), True)
            if out.num_rows:
                yield out
        if held is not None:
            yield add(held, False)[0]

    columns = [*keys, "field"]
    return states.select(*columns, "codes", "counts", "dense").repartition(*columns).sortWithinPartitions(*columns).mapInArrow(run, schema)


def retract(states: DataFrame) -> DataFrame:
    """The states negated, pending updates and counters: merged with others they take their rows out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("dense")
            dense = pa.array([None if data is None else _pack(-_unpack(data)) for data in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], dense, *batch.columns[at + 1 :]], names=batch.schema.names)

    return states.withColumn("counts", F.transform("counts", lambda c: -c)).mapInArrow(run, states.schema)


def percentiles(states: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Key columns, `field`, `n` and `values` (an array, one per probability) of merged states, from the counters alone."""
    keys, probabilities = list(keys), list(probabilities)
    head = _state_schema(states, keys).fields[: len(keys) + 1]
    schema = T.StructType([*head, T.StructField("n", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    k = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(lo, _TOGETHER)
                codes, counts = part.column(k), part.column(k + 1)
                sizes = pc.fill_null(pc.list_value_length(codes), 0).to_numpy().astype(np.int64)
                group = np.repeat(np.arange(part.num_rows), sizes)
                tables = counters(group, codes.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), part.num_rows)
                for i, data in enumerate(part.column(k + 2).to_pylist()):
                    if data is not None:
                        tables[i] += _unpack(data)
                n = np.rint(tables[:, _TABLE:].sum(axis=1)).astype(np.int64)
                found = invert(tables, probabilities)
                values = _lists(found.ravel(), np.arange(part.num_rows) * len(probabilities), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(n), values], names=schema.names)

    return states.select(*keys, "field", "codes", "counts", "dense").mapInArrow(run, schema).where(F.col("n") > 0)
