"""Streams give what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.streaming import streams


def stream(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def finished(df, mode, name, tmp_path):
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("ts", "event_id", F.col("user_id").alias("session"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.col("event_type").alias("tgt"), F.col("event_type").alias("name"))


def test_counts(spark, sf, tmp_path):
    e = events(spark, sf)
    got = finished(streams.call_counts(stream(spark, e, tmp_path)), "complete", "counts", tmp_path)
    assert sorted(got.collect()) == sorted(streams.call_counts(e).collect())


def test_windows(spark, sf, tmp_path):
    e = events(spark, sf)
    got = finished(streams.windowed_counts(stream(spark, e, tmp_path), "1 hour", "30 minutes"), "complete", "windows", tmp_path)
    assert got.agg(F.sum("cnt")).first()[0] == 2 * e.count()


def test_pairs(spark, sf, tmp_path):
    e = events(spark, sf).coalesce(1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = finished(streams.call_pairs(stream(spark, e, tmp_path)), "append", "pairs", tmp_path)
    from treeline.operators.runtime import trace_edges

    assert sorted(got.groupBy("src", "tgt").agg(F.count("*").alias("cnt")).collect()) == sorted(trace_edges(e, "session", ["ts", "event_id"], "name").collect())


def test_pairs_in_order_of_time_over_many_batches(spark, sf, tmp_path):
    """Events in any order, a file a micro-batch, give what the batch query gives; a session of a third of all rows among them."""
    from treeline.operators.runtime import trace_edges

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hot = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("session") % 5).cast("long")
    e = events(spark, sf).select("ts", "event_id", hot.alias("session"), "name").filter("name is not null")
    end = e.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select("ts", F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("session"), F.lit("end").alias("name"))
    for n, part in enumerate([*(e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k) for k in range(4)), end]):
        part.orderBy(F.rand(n)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finished(streams.ordered_call_pairs(rows, "300 days"), "append", "ordered", tmp_path)
    want = trace_edges(e, "session", ["ts", "event_id"], "name").collect()
    assert sorted(got.groupBy("src", "tgt").agg(F.count("*").alias("cnt")).collect()) == sorted(want) and len(want) > 5


def test_late_events_are_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [[("10:00", 1, "a"), ("10:20", 2, "c")], [("10:15", 3, "b"), ("10:09", 4, "late"), ("10:15", 5, None)], [("23:00", 6, "end")]]
    for batch in batches:
        spark.createDataFrame([(7, f"2024-01-01 {t}:00", n, name) for t, n, name in batch], "session long, ts string, event_id long, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("session long, ts string, event_id long, name string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = finished(streams.ordered_call_pairs(rows), "append", "late", tmp_path)
    assert sorted(map(tuple, got.collect())) == [(7, "a", "b"), (7, "b", "c")]


def test_maintenance_sees_each_batch(spark, tmp_path):
    seen = []
    files = stream(spark, spark.createDataFrame([("a",), ("b",)], "rel_path string"), tmp_path)
    streams.maintain(files, lambda df, n: seen.append((n, df.count())), str(tmp_path / "state")).awaitTermination()
    assert seen == [(0, 2)]
