"""The streaming form gives what the batch form gives."""

from pyspark.sql import functions as F

from causeway.streaming import windowed_observations


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windowed_observations(stream, "ts", ["event_type"], "1 day", "40 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    plain = lambda df: sorted((r.start, r.event_type, round(r["mean"], 6), r.n) for r in df.collect())
    assert plain(spark.table("windows")) == plain(windowed_observations(events, "ts", ["event_type"], "1 day", "40 days"))
