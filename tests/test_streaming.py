from pyspark.sql import functions as F

from tessella.streaming import stateful, windows


def test_stream_and_table_agree(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.watermarked(windows.read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "1 day")
    live = windows.run_to_memory(windows.tumbling(stream, "ts", "1 day", "event_type", n=F.count("*")), "live_windows")
    table = windows.tumbling(events, "ts", "1 day", "event_type", n=F.count("*"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, table.collect()))


def test_state_outlives_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema)
    live = windows.run_to_memory(stateful.running_balance(stream, "user_id", "ts", "value"), "live_balance", "update")
    got = {r["user_id"]: r["n"] for r in live.groupBy("user_id").agg(F.max("n_events").alias("n")).collect()}
    assert got == {r["user_id"]: r["count"] for r in events.groupBy("user_id").count().collect()}
