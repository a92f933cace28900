import os

from pyspark.sql import functions as F

from quillgrid.streaming import serving


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(s, f"2024-01-0{1 + k % 3} {k % 24:02d}:00:00", k % 4, "view") for s in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "session long, t string, key long, kind string").select("session", F.to_timestamp("t").alias("ts"), "key", "kind")
    folder = os.path.join(tmp_path, "in")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    for name, batch, live in (
        ("sessions_q", serving.sessions(df, "6 hours"), serving.sessions(stream, "6 hours", "1 hour")),
        ("stages_q", serving.stage_counts(df, "1 hour"), serving.stage_counts(stream, "1 hour", "1 hour")),
    ):
        q = live.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", os.path.join(tmp_path, name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))
    q = serving.first_by_key(stream, "10 days").writeStream.format("memory").queryName("firsts_q").outputMode("append").option("checkpointLocation", os.path.join(tmp_path, "f")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts_q").count() == df.select("session", "key").distinct().count()
