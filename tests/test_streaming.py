"""Sessions of a stream are those of the table."""

from pyspark.sql import functions as F

from reelgraph.streaming import sessions


def test_a_stream_gives_the_sessions_of_the_table(spark, tmp_path):
    rows = [(u, 60 * k + (500 if k > 4 else 0), 1.0) for u in (1, 2) for k in range(9)]
    table = spark.createDataFrame(rows, "user_id long, s int, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "value")
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    # A last event, far ahead, lets the watermark pass the others.
    table.limit(1).select(F.lit(3).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(10**6)).alias("ts"), F.lit(0.0).alias("value")).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sessions(stream, "90 seconds", "1 minute").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.user_id, r.n, r.total) for r in spark.table("found").where("user_id < 3").collect())
    assert got == sorted((r.user_id, r.n, r.total) for r in sessions(table, "90 seconds").collect()) == [(1, 4, 4.0), (1, 5, 5.0), (2, 4, 4.0), (2, 5, 5.0)]
