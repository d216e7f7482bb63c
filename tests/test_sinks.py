"""Sinks: replaced partitions, ordered text, repeated batches; streams that equal their batch form."""

from pyspark.sql import functions as F

from lectern.plans import runs, streams
from lectern.sources import sinks
from lectern.streaming.telemetry import routed

SF = "/root/testdata/sf0.001"


def test_publish_replaces_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.publish(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
    sinks.publish(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = sinks.publish_batch(f"{tmp_path}/s")
    for batch_id in (0, 1, 1):
        write(spark.range(3), batch_id)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6


def test_a_repeated_batch_leaves_both_tables_as_they_were(spark, tmp_path):
    path, write = f"{tmp_path}/t", sinks.publish_batch_apart(f"{tmp_path}/t", F.col("v") > 7)
    rows = lambda lo, hi: spark.range(lo, hi).select("id", F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    seen = []
    for batch_id in (0, 1, 1, 0):
        write(rows(0, 6) if batch_id == 0 else rows(6, 12), batch_id)
        seen.append([sorted(r.id for r in side.collect()) for side in sinks.read_apart(spark, path, rows(0, 1).schema)])
    assert seen[0] == [[0, 1, 2, 3, 4, 5], []]  # a null condition sets nothing apart
    assert seen[1:] == [[[0, 1, 2, 3, 4, 5, 6, 7, 10], [8, 9, 11]]] * 3
    plan = sinks.read_apart(spark, path, rows(0, 1).schema)[1]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(apart" in plan


def test_a_stream_restarted_from_an_older_checkpoint_writes_its_batch_again(spark, tmp_path):
    spark.createDataFrame([(1, "{\"type\": \"pong\"}"), (2, "loading"), (3, " ")], "event_id long, line string").write.parquet(f"{tmp_path}/in")
    sides = []
    for run in "ab":  # the second run starts from nothing, as after a lost checkpoint
        stream = routed(spark.readStream.schema("event_id long, line string").parquet(f"{tmp_path}/in"), "line")
        streams._drained(stream, f"{tmp_path}/state-{run}", "append", sinks.publish_batch_apart(f"{tmp_path}/out", F.col("route") == "log"))
        sides.append([[(r.event_id, r.route) for r in side.collect()] for side in sinks.read_apart(spark, f"{tmp_path}/out", stream.schema)])
    assert sides[0] == sides[1] == [[(1, "pong")], [(2, "log")]]


def test_lines_keep_their_order(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 2).cast("string").alias("book"), "id").repartition(7)
    sinks.write_lines(rows, f"{tmp_path}/m", "book", ["id"], F.concat(F.lit("file "), "id"))
    got = [line for f in sorted((tmp_path / "m" / "book=1").glob("part-*")) for line in f.read_text().splitlines()]
    assert got == [f"file {i}" for i in range(1, 300, 2)]


def test_throttled_stream_equals_batch(spark):
    stream = sorted((r.device, r.event_id) for r in streams.stream_throttle(spark, SF).collect())
    assert stream == sorted((r.device, r.event_id) for r in runs.QUERIES["f10_throttle_samples"](spark, SF).collect())


def test_listener_reports_batches(spark, tmp_path):
    import time

    from lectern.streaming.observers import Progress

    seen, listener = [], None
    listener = Progress(lambda batch, rows, rate: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        spark.range(25).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").foreachBatch(sinks.publish_batch(f"{tmp_path}/out")).start().awaitTermination()
        for _ in range(50):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(rows for _, rows in seen) == 25
