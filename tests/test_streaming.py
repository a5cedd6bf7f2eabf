import datetime as dt

from tallywind.streaming.windows import last_values, sessions, windowed_totals


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    data = [(i % 3, t + dt.timedelta(minutes=7 * i), float(i) if i % 5 else None, i) for i in range(60)]
    df = spark.createDataFrame(data, "k long, ts timestamp, v double, i long")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = windowed_totals(df, "ts", "k", "v", "1 hour")
    assert sum(r.n for r in batch.collect()) == 60 and sum(r.total for r in batch.collect()) == sum(x[2] or 0 for x in data)
    assert windowed_totals(df, "ts", "k", "v", "1 hour", "30 minutes").count() > batch.count()
    assert sum(r.n for r in sessions(df, "ts", "k", "10 minutes").collect()) == 60
    assert windowed_totals(df.limit(0), "ts", "k", "v", "1 hour").count() == 0
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, plan, mode in (("totals", windowed_totals(stream, "ts", "k", "v", "1 hour"), "complete"), ("lasts", last_values(stream, "k", "i", "v"), "update")):
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, batch.collect()))
    assert {r.k: r.v for r in spark.table("lasts").collect()} == {0: 57.0, 1: 58.0, 2: 59.0}
