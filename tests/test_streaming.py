import datetime

from quantloom.streaming import qc


def test_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t + datetime.timedelta(minutes=7 * i), i % 3, float(i) if i % 4 else None) for i in range(100)], "ts timestamp, user_id long, value double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = qc.windowed_counts(qc.read_stream(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, qc.windowed_counts(rows).collect()))
