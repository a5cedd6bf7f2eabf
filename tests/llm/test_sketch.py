from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywind.llm import sketch as S
from tallywind.llm.queries import PROBABILITIES, p1_percentiles
from tallywind.llm.sketch import decode, encode, merge, percentiles, retract, sketch

NAN, INF = float("nan"), float("inf")
P = (0.0, 0.1, 0.5, 0.9, 1.0)


def rank_error(x, p, v):
    """How far the value's ranks are from the wanted one, as a share; the code's resolution allowed for."""
    x = np.sort(x)
    slack = abs(v) * 2.0**-12 + 1e-300
    k = np.floor((len(x) - 1) * p)
    lo, hi = np.searchsorted(x, v - slack, "left"), np.searchsorted(x, v + slack, "right")
    return max(0, lo - k, k - (hi - 1)) / len(x)


def test_codes_keep_order():
    rng = np.random.default_rng(1)
    x = np.sort(np.r_[rng.normal(0, 1e6, 5000), rng.lognormal(0, 20, 5000), -rng.lognormal(0, 20, 5000), 0.0, INF, -INF])
    code = encode(x)
    assert (np.diff(code) >= 0).all() and code.min() >= 0 and code.max() < 1 << S.BITS
    back = decode(code)
    fine = np.isfinite(x) & (np.abs(x) > 1e-300)
    assert np.abs(back[fine] / x[fine] - 1).max() <= 2.0**-13 * 1.01
    assert decode(encode(np.array([0.0, -0.0, INF, -INF]))).tolist() == [0.0, 0.0, INF, -INF]


def test_percentiles_merge_and_bounds(spark):
    rng = np.random.default_rng(2)
    groups = {"wide": rng.lognormal(10, 4, 60_000), "ties": rng.integers(0, 5, 20_000).astype(float), "tiny": np.array([3.0]), "neg": rng.normal(-50, 10, 9000)}
    data = [(g, i % 7, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("gone", 0, None), ("gone", 0, NAN), (None, 1, 2.0), ("inf", 1, INF), ("inf", 1, -INF), ("inf", 1, 5.0)]
    df = spark.createDataFrame(data, "g string, day int, v double").withColumn("n", F.lit(1)).withColumn("dense", F.lit(1)).repartition(5)
    days = merge(sketch(df, ["g", "day"], ["v"]), ["g", "day"])
    whole = merge(days, ["g"])
    direct = merge(sketch(df, ["g"], ["v"]), ["g"])
    assert whole.where("g = 'wide'").first().dense is not None and whole.where("g = 'tiny'").first().dense is None
    got = {r.g: r for r in percentiles(whole, ["g"], P).collect()}
    assert {r.g: list(r["values"]) for r in percentiles(direct, ["g"], P).collect()} == {k: list(r["values"]) for k, r in got.items()}
    for g, x in groups.items():
        assert got[g].n == len(x)
        assert max(rank_error(x, p, v) for p, v in zip(P, got[g]["values"])) < 0.01
    assert "gone" not in got and got[None]["values"][2] == pytest.approx(2.0, rel=2e-4)
    assert got["inf"]["values"][0] == -INF and got["inf"]["values"][4] == INF
    assert percentiles(merge(sketch(df.limit(0), ["g"], ["v"]), ["g"]), ["g"], P).count() == 0
    with pytest.raises(ValueError):
        sketch(df.withColumn("field", F.lit(1)), ["field"], ["v"])


def test_deletions(spark):
    rng = np.random.default_rng(3)
    keep, drop = rng.lognormal(3, 2, 12_000), rng.lognormal(9, 1, 8000)
    frame = lambda x: spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    both = sketch(frame(np.r_[keep, drop]), ["g"], ["v"]).unionByName(retract(sketch(frame(drop), ["g"], ["v"])))
    row = percentiles(merge(both, ["g"]), ["g"], P).first()
    assert row.n == len(keep) and max(rank_error(keep, p, v) for p, v in zip(P, row["values"])) < 0.01
    nothing = sketch(frame(drop), ["g"], ["v"]).unionByName(retract(sketch(frame(drop), ["g"], ["v"])))
    assert percentiles(merge(nothing, ["g"]), ["g"], P).count() == 0


def test_deletions_of_merged_states(spark):
    rng = np.random.default_rng(4)
    keep, drop = rng.lognormal(3, 2, 12_000), rng.lognormal(9, 3, 30_000)
    state = lambda x: merge(sketch(spark.createDataFrame([("a", float(v)) for v in x], "g string, v double"), ["g"], ["v"]), ["g"])
    assert state(drop).first().dense is not None  # more than PENDING codes
    row = percentiles(merge(state(np.r_[keep, drop]).unionByName(retract(state(drop))), ["g"]), ["g"], P).first()
    assert row.n == len(keep) and max(rank_error(keep, p, v) for p, v in zip(P, row["values"])) < 0.01
    assert percentiles(merge(state(drop).unionByName(retract(state(drop))), ["g"]), ["g"], P).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_rank_errors_on_the_test_table(spark):
    """Every asset, field and probability of the query against exact ranks: within 0.01 of the rank, most far closer."""
    d = "/root/testdata/sf0.01"
    found = {(r.asset, r.field): r for r in p1_percentiles(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/cotacoes.parquet").select("asset", "price", "volume").toPandas()
    errors, pairs = [], 0
    for field in ("price", "volume"):
        present = rows[rows[field].notna()]
        for asset, x in present.groupby("asset", dropna=False)[field]:
            r = found[None if asset is None or asset != asset else asset, field]
            pairs += 1
            assert r.n == len(x)
            errors += [rank_error(x.to_numpy(float), p, r[f"p{round(100 * p):02d}"]) for p in PROBABILITIES]
    assert pairs == len(found) and max(errors) < 0.01 and np.mean(errors) < 0.001
