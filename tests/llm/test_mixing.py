import pytest
from pyspark.sql import functions as F

from tallywind.llm.mixing import fill_shares, mix
from tallywind.session import materialize


def test_fill_shares():
    q = fill_shares({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100)
    assert q == {"b": 20.0, "a": 80.0}
    assert fill_shares({"a": 10, "b": 10}, {"a": 0.9, "b": 0.1}, {"a": 1, "b": 1}, 1000) == {"a": 10.0, "b": 10.0}
    assert fill_shares({"a": 10}, {"a": 0.5, "none": 0.5}, {"a": 3, "none": 4}, 20) == {"none": 0.0, "a": 20.0}
    assert fill_shares({}, {}, {}, 10) == {} and fill_shares({}, {"a": 1.0}, {"a": 1}, 0) == {"a": 0.0}
    q = fill_shares({"a": 1000, "b": 1000, "c": 1000}, {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 1, "c": 1}, 1500)
    assert q == pytest.approx({"a": 300.0, "b": 450.0, "c": 750.0})


def test_mix(spark):
    data = [(i, "big" if i % 10 else "small", 5 + i % 7) for i in range(5000)] + [(9001, "small", 0), (9002, None, 8), (9003, "other", 8), (9004, "big", None)]
    df = materialize(spark.createDataFrame(data, "id long, source string, tokens long").withColumn("b", F.lit(1)).withColumn("whole", F.lit(1)))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats long")
    mixture, shares = mix(df, targets)
    got = mixture.collect()
    have = {s: sum(t or 0 for _, x, t in data if x == s) for s in ("big", "small")}
    by = {r.source: r for r in shares.collect()}
    taken = {s: sum(r.tokens for r in got if r.source == s) for s in have}
    assert {s: by[s].taken for s in have} == taken
    # small is clamped at three repetitions, big takes what is left of the total
    assert taken["small"] == 3 * have["small"]
    want = have["big"] + have["small"] - 3 * have["small"]
    assert want - 12 < taken["big"] <= want
    assert sum(r.actual_share for r in by.values()) == pytest.approx(1.0)
    assert by[None].taken == by["other"].taken == by["absent"].taken == 0 and by["absent"].available == 0
    assert len({(r.id, r.copy) for r in got}) == len(got) and max(r.copy for r in got) == 3
    assert sum(1 for r in got if r.id == 9001) == 3
    assert sorted(r.id for r in mix(df, targets)[0].collect()) == sorted(r.id for r in got)
    assert {r.id for r in mix(df, targets, seed=1)[0].collect()} != {r.id for r in got}
    empty, table = mix(df.limit(0), targets)
    assert empty.count() == 0 and {r.taken for r in table.collect()} == {0}
    none, table = mix(df, targets.limit(0))
    assert none.count() == 0
