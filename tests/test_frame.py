import functools
import math
import random
import statistics

import pytest

from tallywind.errors import MissingKey, TypeMismatch, UnknownName
from tallywind.frame import Frame, concat, join
from tallywind.operators import ordered
from tallywind.series import Series
from tallywind.session import materialize

NAN = float("nan")
X = [3, 1, 4, 1, 5, 9, 2, 6]


@pytest.fixture(scope="module")
def s(spark):
    return Series.of(X)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if isinstance(y, float) and isinstance(x, (int, float)):
            assert (math.isnan(x) and math.isnan(y)) or x == pytest.approx(y), (a, b)
        else:
            assert x == y, (a, b)


def test_inference(spark):
    assert Series.of([1, None]).dtype == "int64"
    assert Series.of([1, 2.5]).dtype == "float64"
    assert Series.of([None, None]).dtype == "string"
    assert Series.of([True]).dtype == "bool"
    with pytest.raises(TypeMismatch):
        Series.of([1, "a"])


def test_reductions(s):
    assert (s.sum(), s.prod(), s.median(), s.quantile(0.25), s.min(), s.max()) == (31, 6480, 3.5, 1.75, 1, 9)
    assert (s.argmin(), s.argmax(), s.mode(), s.nunique()) == (2, 6, 1, 7)
    assert s.std() == pytest.approx(2.748376)
    assert s.skew() == pytest.approx(0.833503, abs=1e-6)
    assert s.kurtosis() == pytest.approx(0.276606, abs=1e-6)
    assert s.sem() == pytest.approx(2.748376 / math.sqrt(8), abs=1e-6)
    assert Series.of([2.0, 4, 4, 4, 5, 5, 7, 9], "float64").mad() == 0.5
    assert s.unique() == [3, 1, 4, 5, 9, 2, 6]
    assert s.value_counts()[0] == (1, 2)
    assert s.nlargest(2) == [9, 6] and s.nsmallest(2) == [1, 1]


def test_absence_in_reductions(spark):
    e = Series.of([None, None], "int64")
    assert (e.sum(), e.prod(), e.mean(), e.min(), e.median(), e.mode(), e.argmin()) == (0, 0, None, None, None, None, None)
    f = Series.of([None, None], "float64")
    assert f.prod() is None
    g = Series.of([1, None, 3])
    assert g.sum(ignore_na=False) is None and g.sum(min_count=3) is None and g.sum(min_count=2) == 4
    assert Series.of([1.0, 2.0]).skew() is None and Series.of([1.0, 2.0, 4.0]).kurtosis() is None
    assert Series.of([2.0, 2.0, 2.0, 2.0]).skew() == 0
    n = Series.of([NAN, 1.0, 3.0], "float64")
    assert (n.min(), n.max(), n.sum()) == (1.0, 3.0, None)
    with pytest.raises(Exception):
        Series.of([2**62, 4]).prod()
    assert Series.of([-1, 5, -1, -1]).prod() == -5


def test_pairs(spark):
    f = Frame.from_columns([("a", [1.0, 2.0, 3.0, None]), ("b", [2.0, 4.0, 6.0, 1.0]), ("c", [1.0, 1.0, 1.0, 1.0])])
    assert f["a"].corr(f["b"]) == pytest.approx(1.0)
    assert math.isnan(f["a"].corr(f["c"]))
    assert f["a"].cov(f["b"]) == pytest.approx(2.0)
    assert f["a"].dot(f["b"]) is None
    m = f.corr().to_table()
    assert [r["__index__"] for r in m] == ["a", "b", "c"] and m[0]["b"] == pytest.approx(1.0)


def test_windows_do_not_depend_on_blocks(spark, monkeypatch):
    values = [5, None, 3, 8, None, 1, 7, 2, 2, 9]

    def results():
        f = Frame.from_columns([("x", values, "float64")])
        s = f["x"]
        return [t.to_table() for t in (s.shift(1), s.shift(-2), s.diff(), s.ffill(), s.bfill(), s.cummin(), s.cummax(), s.rolling(3).min_periods(1).sum(), s.rolling(2).mean(), s.expanding().mean(), s.expanding().std(), s.rank(), s.rank("first"), s.rank("max"), s.cumsum())]

    whole = results()
    monkeypatch.setattr(ordered, "reach_back", functools.partial(ordered.reach_back, block=3))
    monkeypatch.setattr(ordered, "running", functools.partial(ordered.running, block=3))
    monkeypatch.setattr(ordered, "rank", functools.partial(ordered.rank, block=3))
    for a, b in zip(results(), whole):
        same(a, b)
    same(whole[0], [None, 5.0, None, 3.0, 8.0, None, 1.0, 7.0, 2.0, 2.0])
    same(whole[3], [5.0, 5.0, 3.0, 8.0, 8.0, 1.0, 7.0, 2.0, 2.0, 9.0])
    same(whole[5], [5.0, None, 3.0, 3.0, None, 1.0, 1.0, 1.0, 1.0, 1.0])
    same(whole[14], [5.0] + [None] * 9)


def test_running_median_in_blocks(spark):
    rng = random.Random(5)
    for draw in (rng.random, lambda: float(rng.randrange(4)), lambda: -1.0):
        values = [None if rng.random() < 0.2 else draw() for _ in range(150)]
        rows = [(i + 1, v) for i, v in enumerate(values)]
        df = materialize(spark.createDataFrame(rows, f"{ordered.POS} long, v double"))
        for block in (7, 60):
            got = {r[0]: r[2] for r in ordered.running_median(df, "v", "m", block).collect()}
            for i in range(150):
                seen = [v for v in values[: i + 1] if v is not None]
                assert got[i + 1] == (pytest.approx(statistics.median(seen)) if seen else None)
    same(Series.of([NAN, 1.0, 3.0], "float64").expanding().median().to_table(), [NAN, NAN, 3.0])
    assert len(Series.of([], "float64").expanding().median()) == 0


def test_whole_numbers_wrap(spark):
    s = Series.of([2**63 - 1, -(2**63), 3])
    assert (s + 1).to_table() == [-(2**63), -(2**63) + 1, 4] and (s - 1).to_table() == [2**63 - 2, 2**63 - 1, 2]
    assert (s * 3).to_table() == [2**63 - 3, -(2**63), 9]


def test_fill_and_cumulative(spark):
    x = Series.of([1, None, None, 4, None], "float64")
    same(x.ffill().to_table(), [1.0, 1.0, 1.0, 4.0, 4.0])
    same(x.bfill().to_table(), [1.0, 4.0, 4.0, 4.0, None])
    same(Series.of([2, 3, 4]).cumprod().to_table(), [2, 6, 24])
    same(Series.of([NAN, 1.0], "float64").cummax().to_table(), [NAN, NAN])
    same(Series.of([1.0, NAN, 3.0], "float64").cummax().to_table(), [1.0, 1.0, 3.0])


def test_rank(spark):
    r = Series.of([3, 1, 4, 1, 5])
    same(r.rank().to_table(), [3.0, 1.5, 4.0, 1.5, 5.0])
    same(r.rank("min").to_table(), [3.0, 1.0, 4.0, 1.0, 5.0])
    same(r.rank("first").to_table(), [3.0, 1.0, 4.0, 2.0, 5.0])
    same(Series.of(["b", None, "a"]).rank().to_table(), [2.0, None, 1.0])
    same(r.pct_rank().to_table(), [0.5, 0.125, 0.75, 0.125, 1.0])
    with pytest.raises(TypeMismatch):
        Series.categorical(["a"]).rank()


def test_rolling(spark):
    x = Series.of([1, 2, 3, 4, 5])
    same(x.rolling(3).sum().to_table(), [None, None, 6, 9, 12])
    same(x.rolling(3).median().to_table(), [None, None, 2.0, 3.0, 4.0])
    same(x.rolling(3).min_periods(1).max().to_table(), [1, 2, 3, 4, 5])
    same(x.rolling(3).min_periods(2).count().to_table(), [None, 2, 3, 3, 3])
    same(x.expanding(2).sum().to_table(), [None, 3, 6, 10, 15])
    same(x.expanding().median().to_table(), [1.0, 1.5, 2.0, 2.5, 3.0])
    f = Frame.from_columns([("x", [1, 2, 3])])
    same(f.rolling(2).mean("x").to_table(), [None, 1.5, 2.5])


def test_predicates(spark):
    f = Series.of([1.0, NAN, None, 3.0], "float64")
    assert f.gt(0.0).to_table() == [True, False, None, True]
    assert f.ne(1.0).to_table() == [False, True, None, True]
    assert f.between(1, 3, "left").to_table() == [True, False, None, False]
    assert Series.of([1, None, 3]).isin([3, None]).to_table() == [False, None, True]
    b = Frame.from_columns([("a", [True, False, None, True]), ("b", [None, None, None, False])])
    assert b["a"].land(b["b"]).to_table() == [None, False, None, False]
    assert b["a"].lor(b["b"]).to_table() == [True, None, None, True]
    assert b["a"].lxor(b["b"]).to_table() == [None, None, None, True]
    assert b["b"].any() is False and Series.of([None], "bool").all() is True and b["a"].count_true() == 2
    assert Series.of([1, 2, 2]).is_monotonic_increasing() and not Series.of([1, 2, 2]).is_monotonic_increasing(True)
    assert not Series.of([1, None]).is_monotonic_increasing() and Series.of([], "int64").is_monotonic_decreasing()
    assert Series.of([1, 2, 2, 5]).searchsorted(2) == 2 and Series.of([1, 2, 2, 5]).searchsorted(2, "right") == 4
    assert Series.of([None, 2, None], "int64").first_valid_index() == 2
    assert Series.of([1, None, 1, None]).duplicated().to_table() == [False, False, True, True]
    assert Series.of([1, None, 1], "int64").is_unique() is False


def test_choice(spark):
    f = Frame.from_columns([("x", [1, 2, None]), ("c", [True, None, False])])
    assert f["x"].where(f["c"], 9).to_table() == [1, 9, 9]
    assert f["x"].mask(f["c"], 9).to_table() == [9, 2, None]
    assert Series.ifelse(f["c"], f["x"], 0).to_table() == [1, 0, 0]
    assert f["x"].fillna(7).to_table() == [1, 2, 7]
    assert f["x"].combine_first(Series.of([5, 5, 5])).to_table() == [1, 2, 5]


def test_arithmetic(spark):
    f = Frame.from_columns([("a", [7, -7, 5]), ("b", [2, 2, 0]), ("x", [1.005, -2.5, NAN], "float64")])
    assert (f["a"] + f["b"]).to_table() == [9, -5, 5]
    same((f["a"] / f["b"]).to_table(), [3.5, -3.5, None])
    assert f["a"].floordiv(f["b"]).to_table() == [3, -3, None]
    same(f["x"].round(2).to_table(), [1.0, -2.5, NAN])
    same(f["x"].round().to_table(), [1.0, -3.0, NAN])
    assert Series.of([15, -15, 14]).round(-1).to_table() == [20, -20, 10]
    same(f["x"].clip(-1, 1).to_table(), [1.0, -1.0, NAN])
    same(Series.of([-4.0, 0.0, 4.0]).sqrt().to_table(), [NAN, 0.0, 2.0])
    same(Series.of([-4.0, 0.0, 1.0]).log().to_table(), [NAN, -math.inf, 0.0])
    assert (1 + Series.of([1, 2])).to_table() == [2, 3] and (Series.of([1, 2]) * 1.5).dtype == "float64"
    with pytest.raises(TypeMismatch):
        Series.of(["a"]) + 1


def test_rows(spark):
    f = Frame.from_columns([("k", ["a", "b", "c", "d"]), ("v", [4, 3, None, 1])])
    assert f.filter(f["v"].gt(2)).to_dict() == {"k": ["a", "b"], "v": [4, 3]}
    assert f.filter(f["v"].gt(2))["v"].shift().to_table() == [None, 4]
    assert f.take([4, 1, 1])["k"].to_table() == ["d", "a", "a"]
    assert f.head(2)["k"].to_table() == ["a", "b"] and f.tail(2)["k"].to_table() == ["c", "d"]
    assert f.iloc(2, 3)["k"].to_table() == ["b", "c"] and len(f.iloc(2, 1)) == 0
    assert f.dropna()["k"].to_table() == ["a", "b", "d"]
    assert f.dropna().sort_by("v")["k"].to_table() == ["d", "b", "a"]
    with pytest.raises(ValueError):
        f.sort_by("v")
    with pytest.raises(IndexError):
        f.take([5])
    assert sorted(f.sample(3, 1)["k"].to_table()) == sorted(set(f.sample(3, 1)["k"].to_table()))
    assert f["k"].rep_each(2).to_table() == ["a", "a", "b", "b", "c", "c", "d", "d"]
    assert f["v"].append(9).to_table() == [4, 3, None, 1, 9] and f["v"].set(3, 8).to_table() == [4, 3, 8, 1]
    assert f.at(2, "k") == "b" and f.iat(1, 2) == 4 and f.row(3) == {"k": "c", "v": None}
    assert Series.of([3, 1, 2]).argsort() == [2, 3, 1] and Series.of([1, None]).argsort() is None
    with pytest.raises(UnknownName, match="did you mean 'v'"):
        f["vv"]


def test_columns(spark):
    f = Frame.from_columns([("a", [1, 2]), ("b", [3.0, 4.5])])
    assert f.assign("c", lambda t: t["a"] * t["b"]).to_dict()["c"] == [3.0, 9.0]
    assert f.insert(1, "z", 5).columns == ["z", "a", "b"] and f.drop_column("a").columns == ["b"]
    assert f.rename({"a": "x"}).columns == ["x", "b"]
    with pytest.raises(ValueError):
        f.rename({"a": "b"})
    assert f.astype({"a": "string"})["a"].to_table() == ["1", "2"]
    assert f.cumsum().to_dict() == {"a": [1, 3], "b": [3.0, 7.5]}
    assert f.sum().to_dict() == {"a": [3], "b": [7.5]} and f.nunique() == {"a": 2, "b": 2}
    assert f.to_markdown().splitlines()[0].startswith("|") and "4.5" in f.to_string()
    g = Frame.from_columns([("a", [1, 2]), ("b", [3.0, 5.25])])
    assert f.equals(f.clone()) and not f.equals(g)
    assert f.compare(g).to_table() == [{"row": 2, "column": "b", "self": "4.5", "other": "5.25"}]
    assert Frame.from_dict([{"x": 1}, {"y": "q"}], "records").to_dict() == {"x": [1, None], "y": [None, "q"]}


def test_groupby(spark):
    f = Frame.from_columns([("uf", ["SP", "RJ", "SP", "MG", "SP", "RJ"]), ("vendas", [10, 20, 30, 40, 50, 60]), ("custo", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])])
    g = f.groupby("uf")
    assert g.sum("vendas").to_dict() == {"uf": ["MG", "RJ", "SP"], "vendas": [40, 80, 90]}
    assert g.count().to_dict()["count"] == [1, 2, 3]
    assert g.first().to_dict()["vendas"] == [40, 20, 10] and g.last().to_dict()["vendas"] == [40, 60, 50]
    assert g.agg({"vendas": ["sum", "median"]}).to_dict() == {"uf": ["MG", "RJ", "SP"], "vendas_sum": [40.0, 80.0, 90.0], "vendas_median": [40.0, 40.0, 30.0]}
    assert g.transform("mean", "vendas").to_table() == [30.0, 40.0, 30.0, 40.0, 30.0, 40.0]
    assert g.quantile(0.5, "custo").to_dict()["custo"] == [4.0, 4.0, 3.0] and g.prod("vendas").to_dict()["vendas"] == [40, 1200, 15000]
    assert g.apply("custo", lambda v: float(v.max() - v.min())).to_dict()["custo"] == [0.0, 4.0, 4.0]
    n = Frame.from_columns([("k", [1.0, NAN, 1.0, NAN, 2.0], "float64"), ("v", [10, 20, 30, 40, 50])])
    assert n.groupby("k").sum().to_dict()["v"] == [40, 50, 60]
    assert Frame.from_columns([("c", ["A", "A"]), ("v", [None, None], "int64")]).groupby("c").sum().to_dict()["v"] == [0]
    with pytest.raises(MissingKey):
        Frame.from_columns([("c", ["A", None]), ("v", [1, 2])]).groupby("c")


def test_product_of_a_large_group(spark):
    big = spark.range(0, 50_000).selectExpr("id", "id % 2000 + 1 as x", "if(id = 7, 0, id % 900 + 2) as z", "if(id % 2 = 0, -1, 1) as s", "if(id % 10000 = 3, 2, 1) as t")
    f = Frame.of(big.selectExpr("*", "'all' as g"), ["id"])
    assert f.groupby("g").prod("z", "s", "t").to_dict() == {"g": ["all"], "z": [0], "s": [-1 if 25_000 % 2 else 1], "t": [32]}
    with pytest.raises(Exception, match="64 bits"):
        f.groupby("g").prod("x").to_dict()
    assert Series.of([2**62, -2]).prod() == -(2**63) and Series.of([3] * 39).prod() == 3**39
    with pytest.raises(Exception):
        Series.of([3] * 40).prod()


def test_functions_of_groups_and_values(spark):
    f = Frame.from_columns([("k", ["a", "b", "a", "b", "a"]), ("v", [3, 10, 1, None, 5])])
    assert f.groupby("k").transform(lambda v: v - v.min(), "v").to_table() == [2.0, 0.0, 0.0, None, 4.0]
    assert f.groupby("k").transform(lambda v: len(v), "v", "int64").to_table() == [3, 2, 3, 2, 3]
    assert f["v"].map(lambda v: v * 2).to_table() == [6, 20, 2, None, 10]
    assert f["v"].map(lambda v, i: f"{i}:{v}").to_table() == ["1:3", "2:10", "3:1", None, "5:5"]
    assert f["v"].map(lambda v: v / 2).dtype == "float64" and f["v"].map(lambda v: None).to_table() == [None] * 5
    assert f["v"].map(lambda v: v > 2).dtype == "bool" and f["v"].map(str, "string").to_table() == ["3", "10", "1", None, "5"]


def test_order_before_positions(spark):
    """Frames are numbered when a position is asked for, and keep their order until then."""
    df = spark.createDataFrame([(3, "c", 1.0), (1, "a", 2.0), (2, "b", 3.0)], "i long, t string, x double")
    f = Frame.of(df, ["i"])
    assert f["t"].to_table() == ["a", "b", "c"] and f.head(2)["t"].to_table() == ["a", "b"] and f.tail(1)["t"].to_table() == ["c"]
    down = f.sort_by("x", asc=False)
    assert down["t"].to_table() == ["b", "a", "c"] and down["t"].shift().to_table() == [None, "b", "a"] and down.groupby("t").first("x").to_dict()["x"] == [2.0, 3.0, 1.0]
    assert f.filter(f["x"].gt(1.5)).iloc(2, 2).to_dict() == {"i": [2], "t": ["b"], "x": [3.0]}
    assert f.join(down, "i").to_dict()["t_right"] == ["a", "b", "c"]
    ties = spark.createDataFrame([(1, n) for n in range(200)], "k long, n long")
    one, two = (Frame.of(df, ["k"])["n"].shift(1).to_table() for df in (ties, ties.repartition(5)))
    assert one == two and len(set(one)) == 200


def test_json_array_file(spark, tmp_path):
    f = Frame.from_columns([("a", [1, None]), ("b", ["x", 'say "y"'])])
    for pretty in (False, True):
        f.to_json(str(tmp_path / "j"), pretty=pretty, lines=False)
        from tallywind.sources.json import read_json

        assert read_json(spark, str(tmp_path / "j")).collect() == [(1, "x"), (None, 'say "y"')]
    f.head(0).to_json(str(tmp_path / "none"), lines=False)
    assert spark.read.text(str(tmp_path / "none")).collect()[0][0] == "[]"


def test_join(spark):
    a = Frame.from_columns([("k", [1, 2, 3]), ("v", ["x", "y", "z"])])
    b = Frame.from_columns([("k", [3, 1, 1, 9]), ("v", ["p", "q", "r", "s"])])
    assert a.join(b, "k").to_dict() == {"k": [1, 1, 3], "v_left": ["x", "x", "z"], "v_right": ["q", "r", "p"]}
    assert join(a, b, "k", "left").to_dict()["v_right"] == ["q", "r", None, "p"]
    assert a.join(b, "k", "outer").to_dict()["k"] == [1, 1, 2, 3, 9]
    assert a.join(b, "k", "right").columns == ["k", "v_right", "v_left"]
    c = Frame.from_columns([("k", [1.0, 2.0]), ("w", [1, 2])])
    assert len(a.join(c.astype({"k": "float64"}), "k")) == 0
    assert a.join(b.rename({"k": "j"}), ("k", "j")).columns == ["k", "v_left", "v_right"]
    with pytest.raises(Exception):
        a.join(Frame.from_columns([("k", [1, None]), ("w", [1, 2])]), "k")
    n = Frame.from_columns([("k", [NAN], "float64"), ("a", [1])])
    assert len(n.join(Frame.from_columns([("k", [NAN, 1.0], "float64"), ("b", [1, 2])]), "k")) == 1


def test_reshape(spark):
    f = Frame.from_columns([("i", ["a", "a", "b"]), ("c", ["x", "y", "x"]), ("v", [1, 2, 3])])
    assert f.pivot("i", "c", "v").to_dict() == {"i": ["a", "b"], "x": [1, 3], "y": [2, None]}
    assert f.pivot_table("i", "c", "v", "mean").to_dict() == {"i": ["a", "b"], "x": [1.0, 3.0], "y": [2.0, None]}
    assert f.melt(["i"], ["v"]).to_dict() == {"i": ["a", "a", "b"], "variable": ["v"] * 3, "value": [1, 2, 3]}
    m = Frame.from_columns([("a", [1, 2]), ("b", ["p", None])]).melt([])
    assert m.to_dict() == {"variable": ["a", "a", "b", "b"], "value": ["1", "2", "p", None]}
    assert concat([f, f]).to_dict()["v"] == [1, 2, 3, 1, 2, 3]
    with pytest.raises(TypeMismatch):
        concat([f, f.drop_column("v")])
    d = Frame.from_columns([("a", [1, 1, 2, None, None], "int64")])
    assert d.drop_duplicates().to_dict()["a"] == [1, 2, None] and d.duplicated(keep="none").to_table() == [True, True, False, True, True]


def test_categorical(spark):
    c = Series.categorical(["b", "a", None, "b"])
    assert c.cat.levels() == ["b", "a"] and c.cat.codes().to_table() == [1, 2, None, 1]
    assert c.cat.rename_categories({"b": "z"}).to_table() == ["z", "a", None, "z"]
    assert c.cat.set_categories(["a"]).to_table() == [None, "a", None, None]
    assert c.cat.remove_categories(["a"]).to_table() == ["b", None, None, "b"]
    assert Series.from_codes([2, None, 1], ["x", "y"]).to_table() == ["y", None, "x"]
    assert c.describe()["levels"] == 2 and c.gt("a").to_table() == [True, False, None, True]
    with pytest.raises(ValueError):
        c.cat.add_categories(["b"])


def test_describe(spark):
    d = Series.of(X).describe()
    assert (d["count"], d["25%"], d["max"]) == (8, 1.75, 9)
    assert Series.of(["a", "b", "a"]).describe() == {"count": 3, "nulls": 0, "unique": 2, "top": "a", "freq": 2}
    assert Series.of([True, None]).describe() == {"count": 1, "nulls": 1, "true": 1, "false": 0}
