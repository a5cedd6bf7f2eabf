"""Invariants on random columns with absences and NaN; fixed seeds."""

import math
import random

import pytest

from tallywind.frame import Frame
from tallywind.series import Series

SEEDS = (20260602, 1337, 987654321)
N = 400


def column(rng, kind, null=0.25, nan=0.0):
    out = []
    for _ in range(N):
        p = rng.random()
        if p < null:
            out.append(None)
        elif p < null + nan:
            out.append(float("nan"))
        elif kind == "int64":
            out.append(rng.randint(-100_000, 100_000))
        elif kind == "float64":
            out.append(round(rng.uniform(-1e6, 1e6), 3))
        elif kind == "bool":
            out.append(rng.random() < 0.5)
        else:
            out.append("".join(rng.choice("abAB1 é") for _ in range(rng.randint(0, 5))))
    return out


@pytest.fixture(scope="module", params=SEEDS)
def frame(request, spark):
    rng = random.Random(request.param)
    return Frame.from_columns(
        [
            ("i", column(rng, "int64"), "int64"),
            ("f", column(rng, "float64", 0.15, 0.15), "float64"),
            ("s", column(rng, "string", 0.2), "string"),
            ("p", column(rng, "bool"), "bool"),
            ("q", column(rng, "bool"), "bool"),
            ("k", [rng.randint(0, 9) for _ in range(N)], "int64"),
        ]
    )


def values(s):
    return s.to_table()


def key(v):
    return (v is not None, isinstance(v, float) and math.isnan(v), v if v is not None and v == v else 0)


def test_rows(frame):
    mask = frame["i"].gt(0)
    kept = frame.filter(mask)
    assert len(kept) == mask.count_true()
    data = frame.to_dict()
    assert kept["s"].to_table() == [s for s, i in zip(data["s"], data["i"]) if i is not None and i > 0]
    order = list(range(1, N + 1))
    random.Random(1).shuffle(order)
    back = [order.index(i) + 1 for i in range(1, N + 1)]
    assert values(frame.take(order).take(back)["i"]) == data["i"]
    present = frame.dropna(["i"])
    assert values(present.sort_by("i")["i"]) == sorted(values(present["i"]))
    with pytest.raises(ValueError):
        frame.sort_by("f")
    assert frame.clone().assign("i", frame["i"].fillna(0))["i"].count_nonnull() == N and frame["i"].to_table() == data["i"]


def test_absence_and_logic(frame):
    filled = frame["f"].fillna(0.0)
    assert filled.count_nonnull() == N
    assert sum(1 for v in values(filled) if v != v) == sum(1 for v in values(frame["f"]) if v is not None and v != v)
    p, q = frame["p"], frame["q"]
    assert values(p.lnot().lnot()) == values(p)
    assert values(p.land(q).lnot()) == values(p.lnot().lor(q.lnot()))
    assert values(frame["i"].astype("float64").astype("int64")) == values(frame["i"])
    assert values(frame["i"].astype("string").astype("int64")) == values(frame["i"])


def test_order(frame):
    unique = values(frame.drop_duplicates(["s"])["s"])
    assert unique == list(dict.fromkeys(values(frame["s"])))
    assert frame["s"].unique() == unique
    i = values(frame["i"])
    assert values(frame["i"].shift(3)) == [None] * 3 + i[:-3]
    expected, last = [], None
    for v in i:
        last = v if v is not None else last
        expected.append(last)
    assert values(frame["i"].ffill()) == expected
    present = sorted(v for v in i if v is not None)
    rank = {v: (2 * present.index(v) + present.count(v) + 1) / 2 for v in present}
    assert values(frame["i"].rank()) == [None if v is None else rank[v] for v in i]
    sums = values(frame["i"].rolling(4).min_periods(1).sum())
    assert sums == [sum(v for v in i[max(0, n - 3) : n + 1] if v is not None) if any(v is not None for v in i[max(0, n - 3) : n + 1]) else None for n in range(N)]


def test_groups_and_joins(frame):
    data = frame.to_dict()
    sums = frame.groupby("k").sum("i").to_dict()
    assert sums["i"] == [sum(i for i, k in zip(data["i"], data["k"]) if k == g and i is not None) for g in sums["k"]] and sums["k"] == sorted(set(data["k"]))
    assert sum(frame.groupby("k").count().to_dict()["count"]) == N
    small = Frame.from_columns([("k", [0, 1, 1, 2, 77], "int64"), ("w", list(range(5)))])
    left = frame.select(["k", "i"]).join(small, "k", "left")
    assert left.to_dict()["k"] == [k for k in data["k"] for _ in range({0: 1, 1: 2, 2: 1}.get(k, 1))]
    assert len(frame.select(["k"]).join(small, "k")) == sum({0: 1, 1: 2, 2: 1}.get(k, 0) for k in data["k"])
    both = frame.concat(frame)
    assert len(both) == 2 * N and both["s"].to_table() == data["s"] * 2


def test_statistics(frame):
    x = [v for v in values(frame["i"]) if v is not None]
    n, m = len(x), sum(x) / len(x)
    assert frame["i"].mean() == pytest.approx(m) and frame["i"].var() == pytest.approx(sum((v - m) ** 2 for v in x) / (n - 1))
    s = sorted(x)
    at = 0.3 * (n - 1)
    assert frame["i"].quantile(0.3) == pytest.approx(s[int(at)] + (s[int(at) + 1] - s[int(at)]) * (at - int(at)))
    assert frame["i"].min() == s[0] and frame["i"].max() == s[-1]
    numbers = [v for v in values(frame["f"]) if v is not None and v == v]
    assert frame["f"].min() == min(numbers) and frame["f"].max() == max(numbers)
    assert isinstance(frame["s"], Series) and frame["s"].nunique() == len({v for v in values(frame["s"]) if v is not None})
