"""Texts, moments, conversions, files and the query catalogue."""

import json
import math
import sys
from pathlib import Path

import pytest

from tallywind.errors import TypeMismatch
from tallywind.frame import Frame
from tallywind.series import Series
from tallywind.sources import read_csv, read_csv_mem, read_json, read_json_mem
from tallywind.sources.json import count_non_finite

NAN, INF = float("nan"), float("inf")
DATA = Path("/root/testdata/sf0.001")


def test_texts(spark):
    s = Series.of(["ação", "", None, "aBc dEf"])
    t = s.str
    assert t.len().to_table() == [6, 0, None, 7]
    assert t.upper().to_table() == ["AçãO", "", None, "ABC DEF"] and t.lower().to_table()[3] == "abc def"
    assert t.swapcase().to_table()[3] == "AbC DeF" and t.capitalize().to_table()[3] == "Abc def"
    assert Series.of(["o'neil x2y", "", "ABC d", None]).str.title().to_table() == ["O'Neil X2Y", "", "Abc D", None]
    assert t.contains("").to_table() == [True, True, None, True] and t.startswith("a").to_table() == [True, False, None, True]
    assert t.find("c").to_table() == [0, 0, None, 3] and Series.of(["çx"]).str.find("x").to_table() == [3] and t.find("").to_table() == [1, 1, None, 1]
    assert t.replace("a", "").to_table() == ["ção", "", None, "Bc dEf"] and t.replace("", "z").to_table() == s.to_table()
    x = Series.of(["hello", None]).str
    assert [x.slice(2, 4).get(1), x.slice(-3).get(1), x.slice(1, -2).get(1), x.slice(4, 2).get(1), x.slice(0, 2).get(1), x.slice(2, 99).get(1)] == ["ell", "llo", "hell", "", "he", "ello"]
    assert x.slice(1).get(2) is None
    assert [x.pad(7).get(1), x.pad(8, "both", "*").get(1), x.pad(3).get(1), x.pad(6, "right", ".").get(1)] == ["  hello", "*hello**", "hello", "hello."]
    assert Series.of(["-5"]).str.zfill(4).get(1) == "00-5" and x.rep(2, "-").to_table() == ["hello-hello", None]
    assert x.count("l").to_table() == [2, None] and Series.of(["aaaa"]).str.count("aa").get(1) == 2
    with pytest.raises(ValueError):
        x.count("")
    assert x.split("l").to_dict() == {"1": ["he", None], "2": ["", None], "3": ["o", None]}
    assert Series.of(["a.b.c", "a"]).str.split(".", 1).to_dict() == {"1": ["a", "a"], "2": ["b.c", None]}
    assert Series.of(["12", "1a", "", " \t", "ab", None, "1\n"]).str.isdigit().to_table() == [True, False, False, False, False, None, False]
    assert Series.of([" \t", "", "a"]).str.isspace().to_table() == [True, False, False]
    assert Series.of(["ab1", "Ab", "1"]).str.islower().to_table() == [True, False, False] and Series.of(["AB1", "Ab"]).str.isupper().to_table() == [True, False]
    assert x.removeprefix("he").get(1) == "llo" and x.removesuffix("lo").get(1) == "hel" and x.removeprefix("x").get(1) == "hello"
    assert Series.of(["b", None, "a"]).str.cat("-") == "b-a" and Series.of([" a\x0b "]).str.strip().get(1) == "a"


def test_moments(spark):
    text = ["2024-02-29T23:59:59.999Z", "1969-12-31", None, "2021-01-03T10:30:00"]
    t = Series.of(text).astype("datetime")
    assert t.to_table() == [1709251199999, -86400000, None, 1609669800000]
    d = t.dt
    assert d.year().to_table() == [2024, 1969, None, 2021] and d.ms().to_table() == [999, 0, None, 0] and d.weekday().to_table() == [3, 2, None, 6]
    assert d.yearday().to_table() == [60, 365, None, 3] and d.quarter().to_table() == [1, 4, None, 1] and d.week().to_table() == [9, 1, None, 53]
    assert Series.of(["2022-01-01"]).astype("datetime").dt.week(january_as_53=True).get(1) == 53
    assert d.format().to_table()[0] == "2024-02-29T23:59:59.999Z"
    assert Series(t.frame, d.truncate("M").col, "datetime").astype("string").to_table()[0] == "2024-02-01T00:00:00.000Z" and d.truncate("x").to_table() == [None] * 4
    assert d.ceil("h").astype("string").to_table()[0] == "2024-03-01T00:00:00.000Z" and d.ceil("D").astype("string").to_table()[1] == "1969-12-31T00:00:00.000Z"
    assert d.round("D").astype("string").to_table()[3] == "2021-01-03T00:00:00.000Z" and d.round("Y").astype("string").to_table()[1] == "1970-01-01T00:00:00.000Z"
    assert d.add_days(1).astype("string").to_table()[0] == "2024-03-01T23:59:59.999Z" and d.diff().to_table() == [None, -86400000 - 1709251199999, None, None]
    assert d.is_month_end().to_table() == [True, True, None, False] and d.is_leap_year().to_table() == [True, False, None, False] and d.days_in_month().to_table() == [29, 31, None, 31]
    assert d.is_year_end().to_table()[1] and d.month_name().to_table()[0] == "February" and d.day_name().to_table()[0] == "Thursday"
    assert d.strftime("%d/%m/%y %I%p %% %q %B").to_table()[0] == "29/02/24 11PM % %q February"
    assert Series.dt_parse("31/12/2025 01:00:00+01:00", True) == Series.dt_parse("2025-12-31") and Series.dt_parse("2025-02-30") is None
    assert Series.dt_format(-1) == "1969-12-31T23:59:59.999Z" and Series.dt_from_parts(2024, 2, 29, 1) == 1709168400000 and Series.dt_from_parts(2023, 2, 29) is None


def test_conversions(spark):
    assert Series.of(["1.5", "abc", None, " 3", "0x1A", "1e400", "inf"]).astype("float64").to_table() == [1.5, None, None, 3.0, None, None, INF]
    assert Series.of(["12", "007", "1.5", "9223372036854775808", "+4", "4 "]).astype("int64").to_table() == [12, 7, None, None, 4, None]
    assert Series.of([2.9, -2.9, NAN, 1e300], "float64").astype("int64").to_table() == [2, -2, None, None]
    assert Series.of([0.1, 10.0, 2.492e-05, NAN, -INF, None], "float64").astype("string").to_table() == ["0.10000000000000001", "10", "2.4919999999999999e-05", "nan", "-inf", None]
    assert Series.of([True, None]).astype("string").to_table() == ["true", None] and Series.of(["true", "True", "x"]).astype("bool").to_table() == [True, None, None]
    assert Series.of([1, 0, None]).astype("bool").to_table() == [True, False, None]
    with pytest.raises(Exception, match="neither 0 nor 1"):
        Series.of([2]).astype("bool").to_table()
    with pytest.raises(TypeMismatch):
        Series.of([True]).astype("datetime")
    assert Series.categorical(["3", "x"]).astype("int64").to_table() == [3, None] and Series.of([86400000]).astype("datetime").astype("int64").to_table() == [86400000]


CSV = 'a,b,c,d,e\n1,1.5,true,x,\n\n 2,nan,False,"q,""z""\nw",NA\n3,1e3,TRUE\n4,-inf,false,y,null,extra\n'


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(CSV.encode())
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    got = [tuple(r) for r in df.collect()]
    assert [r[0] for r in got] == [1, 2, 3, 4] and [r[2] for r in got] == [True, False, True, False]
    assert got[1][3] == 'q,"z"\nw' and got[2][3] is None and all(r[4] is None for r in got) and math.isnan(got[1][1]) and got[3][1] == -INF
    assert read_csv_mem(spark, CSV.replace("\n", "\r\n").replace('""\r\n', '""\n')).count() == 4
    assert [c for c in read_csv_mem(spark, "1;2,5\n", sep=";", decimal=",", header=False).first()] == [1, 2.5]
    assert read_csv_mem(spark, "a,b\n").dtypes == [("a", "string"), ("b", "string")]
    assert read_csv_mem(spark, "a,b\n,-\n", na_values=["-"]).first()[:] == ("", None)
    assert read_csv_mem(spark, "x\n9223372036854775808\n").first()[0] == 9.223372036854775808e18
    assert dict(read_csv_mem(spark, "m\n2026/06\n").dtypes) == {"m": "string"}
    with pytest.raises(ValueError):
        read_csv_mem(spark, "")
    with pytest.raises(ValueError):
        read_csv_mem(spark, "a\n", sep=",", decimal=",")
    with pytest.warns(UserWarning, match="separator"):
        read_csv_mem(spark, "a;b\n1;2\n")
    f = Frame.from_columns([("a", ["x,y", None, 'q"']), ("b", [0.1, NAN, None], "float64"), ("c", [True, None, False])])
    assert f.to_csv_mem() == 'a,b,c\n"x,y",0.10000000000000001,true\n,nan,\n"q""",,false\n'
    f.to_csv(str(tmp_path / "out"))
    assert sorted(map(str, read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, f.to_dataframe().collect()))


def test_json(spark, tmp_path):
    df = read_json_mem(spark, '[{"b": 1, "a": "é"}, {"a": null, "b": 2.5, "c": true}]')
    assert df.columns == ["b", "a", "c"] and [tuple(r) for r in df.collect()] == [(1.0, "é", None), (2.5, None, True)]
    assert read_json_mem(spark, "[]").count() == 0
    with pytest.raises(ValueError):
        read_json_mem(spark, '[{"a": [1]}]')
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "x"},\n {"b": "y"}]')
    assert sorted((tuple(r) for r in read_json(spark, str(tmp_path / "x.json")).collect()), key=str) == [(1, "x"), (None, "y")]
    f = Frame.from_columns([("x", [1.5, NAN, -INF, None], "float64"), ("s", ["a", None, "b", "c"])])
    with pytest.warns(UserWarning, match="2 values"):
        assert json.loads(f.to_json_mem()) == [{"x": 1.5, "s": "a"}, {"x": None, "s": None}, {"x": None, "s": "b"}, {"x": None, "s": "c"}]
    assert count_non_finite(f.to_dataframe()) == 2
    g = Frame.from_columns([("x", [1, None]), ("s", ["a", None])])
    g.to_json(str(tmp_path / "lines"))
    assert sorted(map(str, read_json(spark, str(tmp_path / "lines"), lines=True).select("x", "s").collect())) == sorted(map(str, g.to_dataframe().collect()))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_catalogue_against_sql(spark):
    """Every query with a SQL twin gives the twin's rows on the smallest tables."""
    import duckdb

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from tallywind.plans import data, reference

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return str(v)[:26] if hasattr(v, "isoformat") else v

    wrong = []
    for catalogue in (data, reference):
        for name, sql in catalogue.SQL.items():
            df = catalogue.QUERIES[name](spark, str(DATA))
            columns = sorted(df.columns)
            mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
            there = con.sql(sql)
            at = [there.columns.index(c) for c in columns]
            if mine != sorted(([plain(r[i]) for i in at] for r in there.fetchall()), key=str):
                wrong.append(name)
    assert not wrong
