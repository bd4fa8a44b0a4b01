import datetime as dt

from tempora.streaming import monitors


def test_rates_and_hotspots(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(at(i * 3), "t", 60) for i in range(10)] + [(at(7200), "t", 1), (at(20000), "t", 1)]
    df = spark.createDataFrame(rows, "ts timestamp, table string, rows long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for i, (f, want) in enumerate([(lambda s: monitors.rates(s, "table", "rows"), (600,)), (lambda s: monitors.hotspots(s, "table"), (10,)), (lambda s: monitors.mass_operations(s, "rows"), ("LOW",))]):
        q = f(stream).writeStream.format("memory").queryName(f"m{i}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.sql(f"SELECT * FROM m{i}").collect()
        assert any(want[0] in tuple(r) for r in got), (i, got)
