"""The operators on readings: edge cases and brute force on small fixtures."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywind.functions.dates import parse_moment_ms
from tallywind.operators.anomalies import additive_outliers, flag_implausible, stuck_runs
from tallywind.operators.grid import regular_grid
from tallywind.operators.parts import store_parts
from tallywind.operators.profile import additive_score, auc, changed_loads, differing_loads, fit_additive, fit_logistic, profile_loads
from tallywind.operators.quantiles import group_quantiles
from tallywind.operators.rowparse import Field, parse_rows
from tallywind.operators.shards import time_shards
from tallywind.operators.trailing import trailing_totals
from tallywind.session import materialize

NAN, INF = float("nan"), float("inf")
DAY = 86_400_000


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# quantiles


def test_group_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(x)) for x in rng.lognormal(0, 3, 500)] + [("b", float(x)) for x in rng.integers(-3, 3, 401)] + [("c", 7.0), ("d", -0.0), ("d", 0.0), (None, 5.0), (None, 6.0), ("e", None), ("f", NAN), ("g", INF), ("g", -INF), ("g", 1.0)]
    df = spark.createDataFrame(data, "k string, x double").withColumn("bin", F.lit(1)).withColumn("rank", F.lit("extra"))
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.quantile for r in group_quantiles(df, ["k"], "x", q).collect()}
        for k in ("a", "b", "c", "d", None):
            assert got[k] == pytest.approx(float(np.quantile([x for y, x in data if y == k], q)), rel=1e-12, abs=1e-12)
        assert "e" not in got and "f" not in got
    assert {r.k: r.quantile for r in group_quantiles(df, ["k"], "x").collect()}["g"] == 1.0
    assert group_quantiles(df.limit(0), ["k"], "x").count() == 0


# anomalies


def brute_outliers(x, s, limit=25.0):
    found = set()
    for length in (1, 2, 3):
        for i in range(1, len(x) - length):
            level = np.median(np.r_[x[max(0, i - 4) : i], x[i + length : i + length + 4]])
            block = np.abs(x[i : i + length] / level - 1).min()
            if block > limit * s and abs(x[i - 1] / level - 1) < block / 2 and abs(x[i + length] / level - 1) < block / 2:
                found |= set(range(i, i + length))
    return found


def test_additive_outliers_against_brute_force():
    rng = np.random.default_rng(11)
    for seed in range(30):
        x = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, 400)))
        x[200:] *= 1.5  # a lasting change of level
        for at, size in ((50, 1), (90, 2), (130, 3), (260, 1)):
            x[at : at + size] *= 1.2 if seed % 2 else 0.7
        x[300:304] *= 1.3  # four in a row are no spike
        s = np.median(np.abs(np.diff(x) / x[:-1]))
        got = set(np.flatnonzero(additive_outliers(x, s, 0.1, 25.0)))
        assert got == {50, 90, 91, 130, 131, 132, 260} == brute_outliers(x, s)
    assert not additive_outliers(np.ones(10), 0.0, 0.0, 25.0).any()
    assert not additive_outliers(np.array([1.0]), 0.1, 0.0, 25.0).any()
    assert stuck_runs(np.array([1, 1, 1, 2, 2]), 3).tolist() == [True] * 3 + [False] * 2 and not len(stuck_runs(np.zeros(0), 3))


def test_spikes_of_a_source_without_steps(spark):
    x = np.ones(80)
    x[20], x[30:32], x[45:50], x[60:] = 1.2, 0.9, 1.1, 1.5  # five in a row and the last level are no spikes
    assert np.flatnonzero(additive_outliers(x, 0.0, 0.0, 25.0)).tolist() == [20, 30, 31]
    df = spark.createDataFrame([("s", i, i * 60_000, float(v), None) for i, v in enumerate(x)], "source string, quote_id long, ms long, price double, volume long")
    assert [q for q, r in rows(flag_implausible(df), "quote_id", "reasons") if "spike" in r] == [20, 30, 31]


def _series(n, seed=5):
    rng = np.random.default_rng(seed)
    x = 50 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    return [float(v) for v in x], [int(v) for v in rng.integers(100, 1000, n)]


def test_flags_do_not_depend_on_shards(spark):
    p, v = _series(3000)
    p[1000] *= 3
    for i in range(1500, 1521):
        p[i] = p[1500]
    for i in range(2000, 2030):
        v[i] = 777
    for i in range(2100, 2130):
        v[i] = 0
    p[10], p[11], p[12], v[13] = -1.0, INF, 0.0, -5
    v[14] = 10**9
    data = [("s", i, i * 60_000, p[i], v[i]) for i in range(3000)]
    data += [("s", 9000, 1000 * 60_000, p[1000], v[1000])]  # sent again
    data += [("t", 10_000 + i, i, 1.0 + i % 2 * 0.01, None) for i in range(30)] + [("t", 10_050, 99, NAN, None), ("t", 10_051, 100, None, 2**60 + 1), (None, 1, 1, 1.0, 1), ("t", None, 1, 1.0, 1), ("t", 5, None, -1.0, -1)]
    df = spark.createDataFrame(data, "source string, quote_id long, ms long, price double, volume long").withColumn("shard", F.lit("x")).withColumn("core", F.lit(1))
    whole = rows(flag_implausible(df), "source", "quote_id", "field", "reasons")
    assert whole == rows(flag_implausible(df, shard_rows=100), "source", "quote_id", "field", "reasons")
    got = {(q, f): r for _, q, f, r in whole}
    assert {q for (q, f), r in got.items() if f == "price" and r == "spike"} == {1000, 9000}
    assert {q for (q, f), r in got.items() if f == "price" and r == "stuck"} >= set(range(1500, 1521))
    assert {q for (q, f), r in got.items() if f == "volume" and r == "stuck"} == set(range(2000, 2030))
    assert {q for (q, f), r in got.items() if r == "impossible"} == {10, 11, 12, 13} and got[14, "volume"] == "spike"
    assert flag_implausible(df.limit(0)).count() == 0


def test_shards_have_their_halo(spark):
    rng = random.Random(2)
    data = [("a", rng.randrange(0, 100) * 1000, rng.random() < 0.3) for _ in range(2000)] + [("b", 5, True)]
    df = materialize(spark.createDataFrame(data, "k string, ms long, p boolean"))
    out = time_shards(df, ["k"], "ms", {"p": F.col("p"), "all": F.lit(True)}, rows=100, halo=30, bucket_ms=1000).collect()
    core = [(r.k, r.ms, r.p) for r in out if r.core]
    assert sorted(core) == sorted(data)
    for shard in {r.shard for r in out if r.k == "a"}:
        mine = [r for r in out if r.k == "a" and r.shard == shard]
        lo, hi = min(r.ms for r in mine if r.core), max(r.ms for r in mine if r.core)
        for pick in (lambda r: r[2], lambda r: True):
            before = sum(1 for x in data if x[0] == "a" and x[1] < lo and pick(x))
            after = sum(1 for x in data if x[0] == "a" and x[1] > hi and pick(x))
            flag = (lambda r: r.p) if pick(("", 0, False)) is False else (lambda r: True)
            assert sum(1 for r in mine if r.ms < lo and flag(r)) >= min(30, before)
            assert sum(1 for r in mine if r.ms > hi and flag(r)) >= min(30, after)


# grid


def test_grid(spark):
    m = 60_000
    data = [("a", 0 * m, 1.0, 1), ("a", 0 * m + 5, 3.0, 1), ("a", 1 * m, 4.0, 1), ("a", 4 * m, 10.0, 1), ("a", 40 * m, 11.0, 1), ("a", 41 * m, None, 1), ("a", 42 * m, NAN, 1), ("b", 7 * m, INF, 1), ("b", 9 * m, 2.0, 1), (None, 1, 1.0, 1), ("c", None, 1.0, 1), ("d", 5, 1.0, None)]
    df = spark.createDataFrame(data, "s string, ms long, v double, step long").withColumn("slot", F.lit(1)).withColumn("status", F.lit(2))
    got = {(r.s, r.slot_epoch): (r.value, r.readings, r.status) for r in regular_grid(df, ["s"], "ms", "v", "step").collect()}
    assert got["a", 0] == (2.0, 2, "observed") and got["a", 60] == (4.0, 1, "observed")
    assert got["a", 120][2] == "filled" and 4 < got["a", 120][0] < got["a", 180][0] < 10  # monotone
    assert got["a", 600] == (None, 0, "gap") and ("a", 2460) not in got
    assert got["b", 480] == (None, 0, "gap")
    assert {k for k, _ in got} == {"a", "b"} and len([1 for k, _ in got if k == "a"]) == 41
    assert regular_grid(df.limit(0), ["s"], "ms", "v", "step").count() == 0


def test_grid_does_not_depend_on_shards(spark):
    rng = random.Random(4)
    data = [("a", t * 60_000, math.sin(t / 9) * 5 + rng.random(), 1) for t in sorted(rng.sample(range(600), 200))]
    df = spark.createDataFrame(data, "s string, ms long, v double, step long")
    whole = rows(regular_grid(df, ["s"], "ms", "v", "step"))
    assert whole == rows(regular_grid(df, ["s"], "ms", "v", "step", shard_slots=5)) and len(whole) > 590 - 20
    from itertools import pairwise

    # between two knots the curve stays between their values
    known = sorted((r[1], r[2]) for r in whole if r[4] == "observed")
    for (t0, v0), (t1, v1) in pairwise(known):
        assert all(min(v0, v1) - 1e-9 <= r[2] <= max(v0, v1) + 1e-9 for r in whole if t0 < r[1] < t1 and r[4] == "filled")


# trailing periods


def test_trailing_against_brute_force(spark):
    rng = random.Random(6)
    d0 = dt.date(2026, 1, 1)
    data = [(e, d0 + dt.timedelta(days=rng.choice([0, 1, 2, 3, 20, 21, 60])), rng.choice([0, 1, 5, None]), rng.choice([1.0, 2.5, NAN, None])) for e in "xyz" for _ in range(40)] + [("none", d0, 0, 1.0), (None, d0, 1, 1.0), ("x", None, 1, 1.0)]
    df = spark.createDataFrame(data, "e string, d date, volume long, price double").withColumn("day", F.lit("extra")).withColumn("__active", F.lit(9))
    got = {(r.e, r.day, r.span_days): r for r in trailing_totals(df, ["e"], "d", ["volume", "price"], F.col("volume") > 0).collect()}
    expected = 0
    for e in "xyz":
        mine = [r for r in data if r[0] == e and r[1]]
        days = [r[1] for r in mine if r[2]]
        for k in range((max(days) - min(days)).days + 1):
            day = min(days) + dt.timedelta(days=k)
            for span in (7, 30):
                window = [r for r in mine if min(days) <= r[1] <= day and r[1] > day - dt.timedelta(days=span)]
                g = got[e, day, span]
                assert g.active_rows == sum(1 for r in window if r[2]) and g.volume_total == sum(r[2] or 0 for r in window)
                prices = [r[3] for r in window if r[3] is not None and r[3] == r[3]]
                assert g.price_total == pytest.approx(sum(prices)) and (g.price_avg is None) == (not prices)
                expected += 1
    assert len(got) == expected
    assert trailing_totals(df.limit(0), ["e"], "d", ["volume"], F.col("volume") > 0).count() == 0


# rows that fail to parse

SCHEMA = (Field("timestamp", "moment"), Field("asset", "string"), Field("price", "double"), Field("volume", "bigint"))


def test_parse_rows(spark):
    cases = [
        ("2026-01-01T00:00:00Z,A,1.5,10", None),
        ('"2026-01-01","A, ""x""\nz"," 1e3","-5"\r', None),
        ("NA,,null,N/A", None),
        (",,,", None),
        ("2026-01-01,A,nan,1", None),
        ("2026-01-01,A,-INF,1", None),
        ("2026-01-01,A,.5,+1", None),
        ("2026-01-01,A,1.5,10\r\r", "bad_volume"),
        ("2026-02-30,A,x,1", "bad_timestamp"),
        ("2026-02-28,A,x,y", "bad_price"),
        ("2026-02-28,A,1e400,1", "bad_price"),
        ("2026-02-28,A,1e-400,1", "bad_price"),
        ("2026-02-28,A,0e-400,1", None),
        ("2026-02-28,A,0x1A,1", "bad_price"),
        ("2026-02-28,A,1.5 ,1", "bad_price"),
        ("2026-02-28,A,infinity,1", "bad_price"),
        ("2026-02-28,A,1,9223372036854775808", "bad_volume"),
        ("2026-02-28,A,1,9223372036854775807", None),
        ("2026-02-28,A,1,1.0", "bad_volume"),
        ("2026-02-28,A,1", "column_count"),
        ("2026-02-28,A,1,2,", "column_count"),
        ('2026-02-28,"A,1,2', "bad_quoting"),
        ('2026-02-28,"A"x,1,2', "bad_quoting"),
        ('2026-02-28,A"x,1,2', "bad_quoting"),
        ("   ", "column_count"),
        ("2026-02-28,A," + "9" * 400 + ",1", "bad_price"),
        ('2026-02-28,"' + 'ab""' * 50_000 + '",1,2', None),
        ("x" * 300_000, "column_count"),
    ]
    data = [(i, line) for i, (line, _) in enumerate(cases)] + [(900, None), (901, ""), (902, "\r"), (903, "\n")]
    df = spark.createDataFrame(data, "id long, line string").withColumn("asset", F.lit(1)).withColumn("reason", F.lit(2))
    got = {r.id: r for r in parse_rows(df, "line", SCHEMA, ["id"]).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: reason for i, (_, reason) in enumerate(cases)}
    assert got[0].price == 1.5 and got[0].volume == 10 and got[0].timestamp == dt.datetime(2026, 1, 1)
    assert got[1].asset == 'A, "x"\nz' and got[1].price == 1000.0 and got[1].volume == -5
    assert got[2].timestamp is None and got[2].asset is None and got[2].price is None
    assert math.isnan(got[4].price) and got[5].price == -INF and got[8].asset is None
    assert parse_rows(df.limit(0), "line", SCHEMA, ["id"]).count() == 0
    with pytest.raises(ValueError):
        parse_rows(df, "line", SCHEMA, ["asset"])


# profiles


def test_logistic_regression_and_auc():
    x = np.array([[1, 0.0], [1, 1.0]])
    beta = fit_logistic(x, np.array([1.0, 3.0]), np.array([3.0, 1.0]), ridge=1e-9, rounds=50)
    assert beta == pytest.approx([-math.log(3), 2 * math.log(3)], rel=1e-4)
    assert auc(np.array([0.0, 1.0]), np.array([0, 5]), np.array([5, 0])) == 1.0
    assert auc(np.array([0.0, 1.0]), np.array([1, 1]), np.array([1, 1])) == 0.5 and auc(np.zeros(0), np.zeros(0), np.zeros(0)) == 0.5


def test_profile(spark):
    rng = random.Random(9)
    data = []
    for load in range(12):
        for i in range(300):
            asset = f"A{rng.randrange(20)}"
            volume = int(math.exp(rng.gauss(6, 1)))
            price = 10.0 * (1 + int(asset[1:])) + rng.random()
            if load == 2 and rng.random() < 0.4:
                price = rng.choice([None, NAN])
            if load == 3 and rng.random() < 0.4:
                asset = asset.lower() + str(rng.randrange(3))
            if load == 4:
                volume *= 8
            if load == 5:
                asset = f"A{rng.randrange(5)}"
            if load == 6 and rng.random() < 0.5:
                volume = None
            if load == 7 and rng.random() < 0.5:
                asset = None
            data.append((load, price, volume, asset))
    df = spark.createDataFrame(data, "load_id long, price double, volume long, asset string").withColumn("n", F.lit(1)).withColumn("known", F.lit(1))
    known = spark.createDataFrame([(f"A{i}",) for i in range(20)] + [(None,), ("A1",)], "asset string")
    profile = materialize(profile_loads(df, known))
    found = set(rows(differing_loads(profile)))
    assert {(2, "price", "absent"), (3, "asset", "unknown"), (4, "volume", "shift"), (5, "asset", "distinct"), (6, "volume", "absent"), (7, "asset", "absent")} <= found
    assert found <= {(2, "price", "absent"), (3, "asset", "unknown"), (3, "asset", "distinct"), (4, "volume", "shift"), (5, "asset", "distinct"), (6, "volume", "absent"), (7, "asset", "absent")}
    by = {r.load_id: r for r in profile.collect()}
    assert by[4].volume_alone > 0.8 and by[0].volume_alone < 0.7 and by[4].volume_drop > 0.2 and by[2].price_alone > 0.6
    nulls = spark.createDataFrame([(None, None, None, None), (1, NAN, 0, "zz")], df.select("load_id", "price", "volume", "asset").schema)
    assert profile_loads(nulls, known).count() == 2
    assert profile_loads(df.limit(0), known).count() == 0


def test_shift_of_rare_volumes(spark):
    rng = random.Random(10)
    data = []
    for load in range(8):
        for i in range(1000):
            volume = int(1000 * rng.lognormvariate(0, 0.2)) * (8 if load == 4 else 1) if i % 100 == 0 else 0
            data.append((load, 10.0, volume, f"A{rng.randrange(4)}"))
    df = spark.createDataFrame(data, "load_id long, price double, volume long, asset string")
    profile = materialize(profile_loads(df, spark.createDataFrame([(f"A{i}",) for i in range(4)], "asset string")))
    assert rows(differing_loads(profile)) == [(4, "volume", "shift")]


def test_the_two_sample_test_names_loads(spark):
    rng = random.Random(11)
    data = []
    for load in range(8):
        for i in range(20 if load == 7 else 600):
            volume = 1000 * rng.lognormvariate(0, 0.2) * (rng.choice([0.1, 1, 10]) if load == 4 else 1)  # wider, with the same median
            asset = rng.choice("ABCDEFGH") if load != 5 else rng.choice("AAAAAABCDEFGH")
            data.append((load, 10.0 * rng.lognormvariate(0, 0.2), int(volume), asset))
    df = spark.createDataFrame(data, "load_id long, price double, volume long, asset string")
    known = spark.createDataFrame([(a,) for a in "ABCDEFGH"], "asset string")
    profile = materialize(profile_loads(df, known))
    exact = materialize(profile_loads(df, known, two_sample=False))
    assert set(profile.columns) - set(exact.columns) == {"auc", *[f"{c}_{w}" for c in ("price", "volume", "asset") for w in ("alone", "drop")]}
    assert rows(profile.select(exact.columns)) == rows(exact)
    assert rows(differing_loads(exact)) == rows(differing_loads(profile)) == []
    assert rows(changed_loads(profile)) == [(4, "volume", "distribution"), (5, "asset", "distribution")]
    assert rows(changed_loads(profile.where("load_id in (0, 1)"))) == [] and rows(changed_loads(profile.limit(0))) == []
    other = profile.withColumn("auc", F.when(F.col("load_id") == 7, F.lit(0.62)).otherwise(F.lit(0.5)))  # 20 rows: within four standard errors
    assert rows(changed_loads(other)) == [] and rows(changed_loads(other, errors=0)) != []


# moments


def test_moments(spark):
    cases = {
        "2026-01-02": 1767312000000,
        "2/1/2026": 1767312000000,
        "2026/01/02 01:00:00.5-0300": 1767326400500,
        "2026-01-02T00:00:00+23:59": 1767312000000 - 86340000,
        "1969-12-31T23:59:59.999Z": -1,
        "2026-01-02T00:00:00.1239": 1767312000123,
    }
    bad = ["", " ", "agora", "2026-1-2", "2026-02-30", "2/1-2026", "2026-01-02T24:00:00", "2026-01-02T10:00", "2026-01-02 ", "2026-01-02T10:00:00z", "2026-01-02T10:00:00+03", "1/1/26", None, "2026-01-02T10:00:00Z\n", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in [*cases, *bad]], "t string")
    got = [r[0] for r in df.select(parse_moment_ms(F.col("t"))).collect()]
    assert got == [*cases.values(), *[None] * len(bad)]
    assert spark.createDataFrame([("1/2/2026",)], "t string").select(parse_moment_ms(F.col("t"), dayfirst=False)).first()[0] == 1767312000000


def brute_grid(known, max_fill=12):
    """Monotone cubic values of the missing periods between the knots {slot: value}, segment by segment."""
    slots = sorted(known)
    out = {}
    segments, run = [], [slots[0]]
    for a, b in zip(slots, slots[1:]):
        if b - a - 1 > max_fill:
            segments.append(run)
            run = []
        run.append(b)
    segments.append(run)
    for s in segments:
        h = np.diff(s).astype(float)
        d = np.diff([known[t] for t in s]) / h if len(s) > 1 else np.zeros(0)
        m = np.zeros(len(s))
        for k in range(len(s)):
            if len(s) == 1:
                break
            if len(s) == 2:
                m[k] = d[0]
            elif 0 < k < len(s) - 1:
                w0, w1 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = 0.0 if d[k - 1] * d[k] <= 0 else (w0 + w1) / (w0 / d[k - 1] + w1 / d[k])
            else:
                h0, h1, d0, d1 = (h[0], h[1], d[0], d[1]) if k == 0 else (h[-1], h[-2], d[-1], d[-2])
                e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
                m[k] = 0.0 if e * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(e) > 3 * abs(d0) else e
        for k in range(len(s) - 1):
            for t in range(s[k] + 1, s[k + 1]):
                u = (t - s[k]) / h[k]
                out[t] = (2 * u**3 - 3 * u**2 + 1) * known[s[k]] + (u**3 - 2 * u**2 + u) * h[k] * m[k] + (3 * u**2 - 2 * u**3) * known[s[k + 1]] + (u**3 - u**2) * h[k] * m[k + 1]
    return out


def test_grid_values_against_brute_force(spark):
    rng = random.Random(12)
    known, t = {}, 0
    for _ in range(250):
        t += rng.choice([1, 1, 2, 3, 5, 12, 13, 14, 30])
        known[t] = rng.choice([1.0, 2.0, rng.random() * 10])
    df = spark.createDataFrame([("a", t * 60_000, v, 1) for t, v in known.items()], "s string, ms long, v double, step long")
    want = brute_grid(known)
    for slots in (8192, 7):
        got = {r.slot_epoch // 60: r.value for r in regular_grid(df, ["s"], "ms", "v", "step", shard_slots=slots).collect() if r.status == "filled"}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_values_beyond_a_gap_do_not_matter(spark):
    near = [("a", t * 60_000, v, 1) for t, v in ((100, 10.0), (103, 15.0), (105, 16.0))]
    far = [("a", t * 60_000, v, 1) for t, v in ((0, 900.0), (205, -500.0))]
    schema = "s string, ms long, v double, step long"
    alone = {r.slot_epoch: r.value for r in regular_grid(spark.createDataFrame(near, schema), ["s"], "ms", "v", "step").collect()}
    beside = {r.slot_epoch: r.value for r in regular_grid(spark.createDataFrame(near + far, schema), ["s"], "ms", "v", "step").collect()}
    assert len(alone) == 6 and all(beside[k] == v for k, v in alone.items())


def test_a_very_long_gap(spark):
    far = 10**7
    df = spark.createDataFrame([("a", 0, 1.0, 1), ("a", far * 60_000, 2.0, 1)], "s string, ms long, v double, step long")
    assert regular_grid(df, ["s"], "ms", "v", "step").groupBy("status").count().collect() != [] and regular_grid(df, ["s"], "ms", "v", "step").where("status = 'gap'").count() == far - 1


def test_a_busy_hour_is_spread_over_parts(spark):
    p, v = _series(3000, 8)
    p[700] *= 3
    p[1500:1502] = [p[1500] * 0.2] * 2
    for i in range(2390, 2412):
        p[i] = p[2390]
    for i in range(880, 910):
        v[i] = 77
    data = [("hot", i, 3_600_000 * 5 + i * 500, p[i], v[i]) for i in range(3000)] + [("cold", 9000 + i, i * 3_600_000, 1.0 + i % 3 * 0.01, None) for i in range(40)]
    df = spark.createDataFrame(data, "source string, quote_id long, ms long, price double, volume long")
    whole = rows(flag_implausible(df), "source", "quote_id", "field", "reasons")
    assert {(q, f) for _, q, f, _ in whole} >= {(700, "price"), (1500, "price"), (1501, "price")} | {(i, "price") for i in range(2390, 2412)} | {(i, "volume") for i in range(880, 910)}
    for size in (70, 150, 400):  # parts with less than one edge's reach, with little more, with an inside
        assert rows(flag_implausible(df, shard_rows=size), "source", "quote_id", "field", "reasons") == whole


def test_parts_are_whole_and_even(spark):
    df = materialize(spark.createDataFrame([("x", i // 3) for i in range(6000)] + [("y", 5)], "k string, t long"))
    parts = store_parts(df, ["k", "t"], 1000)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert sum(sizes) == 6001 and len(sizes) == 7 and max(sizes) < 2500
    assert parts.groupBy("k", "t").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_additive_regression_is_the_logistic_one():
    rng = np.random.default_rng(4)
    codes, widths = rng.integers(0, [[3], [4]], (2, 60)), [3, 4]
    positive, negative = rng.integers(0, 9, 60).astype(float), rng.integers(0, 9, 60).astype(float)
    design = np.hstack([np.ones((60, 1)), np.eye(3)[codes[0]], np.eye(4)[codes[1]]])
    beta = fit_logistic(design, positive, negative)
    assert additive_score(*fit_additive(codes, widths, positive, negative), codes) == pytest.approx(design @ beta, abs=1e-6)


def test_profile_sees_another_mix_of_known_assets(spark):
    rng = random.Random(13)
    data = [(load, 10.0, 100, f"A{rng.randrange(8) if load != 3 or rng.random() < 0.2 else rng.randrange(2)}") for load in range(6) for _ in range(500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, load_id long, price double, volume long, asset string")
    known = spark.createDataFrame([(f"A{i}",) for i in range(8)], "asset string")
    by = {r.load_id: r for r in profile_loads(df, known).collect()}
    assert by[3].asset_alone > 0.7 and by[3].asset_drop > 0.1 and all(by[k].asset_alone < 0.62 for k in by if k != 3)
    again = {r.load_id: r.auc for r in profile_loads(df.repartition(7, "price", "asset"), known).collect()}
    assert again == pytest.approx({k: r.auc for k, r in by.items()}, abs=1e-9)
