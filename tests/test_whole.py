"""Queries that have to read their whole tables."""

from tallywind.plans import reference


def test_all_orders_are_grouped_and_joined(spark, tmp_path):
    orders = [(k, 1 if k <= 90 else k % 5 + 2, float(k), "OFP"[k % 3]) for k in range(1, 200)]  # a customer with 90 orders
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, f"c{k}") for k in range(1, 10)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.o_custkey: r for r in reference.QUERIES["groupby_first_last_nunique_prod_whole"](spark, str(tmp_path)).collect()}
    assert set(got) == {k for _, k, _, _ in orders}
    for key, row in got.items():
        mine = sorted(o for o in orders if o[1] == key)
        odd = sum(o[0] % 2 for o in mine)
        assert (row.first_price, row.last_price, row.statuses, row.p) == (mine[0][2], mine[-1][2], len({o[3] for o in mine}), (-1) ** odd)
    joined = reference.QUERIES["join_left_whole"](spark, str(tmp_path))
    assert joined.where("o_orderkey is not null").count() == len(orders) and joined.where("o_orderkey is null").count() == 3


def test_all_spellings_are_parsed(spark, tmp_path):
    texts = {1: "2025-03-01T00:00:01Z", 2: "2025-03-01 00:00:01", 3: "01/03/2025 01:00:01+01:00", 4: "01-03-2025", 5: "soon", 6: None, 7: "2025/03/01T00:00:01.500-0000"}
    spark.createDataFrame(list(texts.items()), "quote_id long, timestamp string").write.parquet(str(tmp_path / "cotacoes.parquet"))
    day = 1740787200000
    got = {r.quote_id: r.ms for r in reference.QUERIES["dt_parse_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: day + 1000, 2: day + 1000, 3: day + 1000, 4: day, 5: None, 6: None, 7: day + 1500}
