"""What the physical plans of the catalogue must and must not contain."""

from pathlib import Path

import pytest

from tallywind.frame import Frame
from tallywind.operators import profile
from tallywind.plans import data, reference
from tallywind.session import materialize

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES = {**reference.QUERIES, **data.QUERIES}


def plan(spark, name):
    return QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["join_star", "join_inner", "join_outer", "drop_duplicates_first", "duplicated_mask", "groupby_transform_mean", "rolling_suite", "rank_methods", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_no_nested_loops_and_no_row_udfs(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p


def test_scans_read_what_is_needed(spark):
    p = plan(spark, "groupby_agg_pricing")
    scan = next(line for line in p.split("\n") if "FileScan" in line)
    assert "l_shipdate" in scan.split("DataFilters")[1] and "l_partkey" not in scan and "l_orderkey" not in scan
    assert "partial_sum" in p


def test_frames_reach_the_scan(spark):
    f = Frame.of(spark.read.parquet(str(DATA / "orders.parquet")), ["o_orderkey"])
    out = f.filter(f["o_totalprice"].gt(1000.0)).assign("twice", lambda t: t["o_totalprice"] * 2).groupby("o_orderpriority").agg({"twice": ["sum", "max"]}).to_dataframe(False)
    p = out._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in p.split("\n") if "FileScan" in line)
    assert "GreaterThan(o_totalprice,1000.0)" in scan and "o_custkey" not in scan and "o_orderdate" not in scan and "numbered" not in p
    assert p.count("Exchange") <= 1 and "partial_sum" in p


def test_windows_of_one_frame_share_a_pass(spark):
    f = Frame.of(spark.read.parquet(str(DATA / "orders.parquet")).select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    t = f["o_totalprice"]
    p = f.with_columns({"a": t.shift(1), "b": t.rolling(5).sum(), "c": t.rolling(3).max(), "d": t.diff()}).to_dataframe(False)._jdf.queryExecution().executedPlan().toString()
    assert p.count("hashpartitioning(__blk") == 1


def test_parsing_records_shuffles_nothing(spark):
    assert "Exchange" not in plan(spark, "p5_found")


@pytest.mark.parametrize(("name", "tested"), [("p6_found", False), ("p6_aggregates", False), ("p6_changed", True)])
def test_the_classifier_runs_where_it_is_read(spark, monkeypatch, name, tested):
    written = []
    monkeypatch.setattr(profile, "materialize", lambda df, name="step", **options: written.append(name) or materialize(df, name, **options))
    found = QUERIES[name](spark, str(DATA))
    assert ("cells" in written) == tested
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
