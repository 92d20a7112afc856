import datetime as dt

from capstan.streaming.events import windowed_counts


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a", float(m)) for m in (1, 2, 11, 12, 13)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "10 minutes", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["total"]) for r in spark.table("counts").collect()) == [(2, 3.0), (3, 36.0)]
