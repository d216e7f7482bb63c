"""Streaming queries: the event table read as a stream to its end, the result read back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.operators.engine import ColumnEngine, apply_engine, guarded_apply
from lectern.operators.telemetry import micros, ratio
from lectern.plans import runs, sql
from lectern.plans.tables import gpu_lines, jobs, messages, table
from lectern.sources.sinks import publish, publish_batch, publish_batch_apart, read_apart, shared_dir
from lectern.streaming import telemetry as S
from lectern.streaming.observers import observed
from lectern.streaming.replay import delivered


#: Events of one group of runs, about.
GROUP_EVENTS = 50_000


def _shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The stream with the columns of the batch ``messages``."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("task_id"), (F.col("event_id") % 4).alias("worker"), (F.col("event_type") == "view").alias("cached"), "props", "event_type",
        F.rint(F.col("value") * 1000).cast("long").alias("audio_ms"), (F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) + 1).alias("chars"), (F.col("event_id") * 37 % 900 + 100).alias("wall_ms"),
    )


def _drained(stream: DataFrame, state: str, mode: str, write) -> None:
    """Run ``stream`` over all input there is, each batch handed to ``write``."""
    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, S.ROCKSDB)
    try:
        q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state).foreachBatch(write).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all input there is and read what it published; in complete mode the last batch."""
    spark, path = stream.sparkSession, _shared(stream.sparkSession)
    _drained(stream, f"{path}/state", mode, publish_batch(f"{path}/out"))
    out = spark.read.schema(stream.schema.add("batch_id", "long")).parquet(f"{path}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch_id").alias("batch_id"))), "batch_id")
    return out.drop("batch_id")


def _messages_apart(spark, d):
    """The messages of the stream of lines, and its lines that are none, as the two tables that one run writes."""
    line = F.when(F.col("task_id") % 10 == 0, "  ").when(F.col("task_id") % 5 == 0, F.concat(F.lit("log "), F.col("props"))).otherwise(F.concat(F.lit('{"type": "'), F.when(F.col("event_type") == "error", "task_error").when(F.col("event_type") == "view", "pong").otherwise("result"), F.lit('", '), F.expr("substr(props, 2)")))
    routed = S.routed(_events(spark, d).select(F.col("task_id").alias("event_id"), line.alias("line")), "line")
    stream, path = routed.select("event_id", "route", "m.k", F.when(F.col("route") == "log", F.col("line")).alias("line")), _shared(spark)
    _drained(stream, f"{path}/state", "append", publish_batch_apart(f"{path}/out", F.col("route") == "log"))
    return read_apart(spark, f"{path}/out", stream.schema)


def stream_messages(spark, d):
    told, log = _messages_apart(spark, d)
    return told.unionByName(log).drop("line")


def stream_log_lines(spark, d):
    return _messages_apart(spark, d)[1].select("event_id", "line")


def _delivered(events, key):
    """The given events as a stream of files that overlap in time."""
    return delivered(events.withColumn("at", micros(F.col("ts"))).drop("ts"), key)[0]


def stream_throughput(spark, d):
    events = messages(spark, d).select("run_id", "task_id", "ts", "cached", "chars", "audio_ms", "wall_ms")
    totals = events.groupBy("run_id").agg(F.sum("chars").alias("total"))
    groups = max(1, -(-events.count() // GROUP_EVENTS))
    return finished(S.tracked(_delivered(events.join(totals, "run_id"), "task_id"), groups))


def stream_throttle(spark, d):
    return finished(S.throttled(_delivered(gpu_lines(spark, d).select("device", "event_id", "ts"), "event_id"), runs.GAP))


def stream_worker_stats(spark, d):
    return finished(S.worker_stats(_events(spark, d)), "complete").withColumn("factor", ratio(F.col("audio_ms"), F.col("wall_ms")))


def dedupe_completions(spark, d):
    e = _events(spark, d).select("run_id", "task_id", "ts")
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return finished(S.dedupe_completions(twice)).select("run_id", "task_id")


#: Narration estimated by length: 60 ms for each character, and up to 200 ms by the seed.
ESTIMATE = ColumnEngine(lambda text, seed: (F.length(text) * 60 + seed % 200) * 24, 24_000)


def engine_plugin(spark, d):
    rows = jobs(spark, d).select(F.concat("book_id", F.lit("/"), "task_id").alias("task_id"), F.lit(0).alias("part"), "text", "seed")
    return apply_engine(rows, ESTIMATE).drop("part")


def guarded(spark, d):
    rows = table(spark, d, "conversations").select(F.concat(F.col("conv_id"), F.lit("-"), F.col("turn"), F.lit("-"), F.col("role")).alias("task_id"), "text", F.lit(7).alias("seed"))
    return guarded_apply(rows, ESTIMATE, 220).select("task_id", "sample_rate", (F.col("frames") > 0).alias("voiced"))


def atomic_publish(spark, d):
    """Chunk lists published by book, and read back."""
    path = _shared(spark)
    publish(jobs(spark, d).select("book_id", "sequence", "task_id"), path, "book_id")
    return spark.read.schema("sequence long, task_id string, book_id string").parquet(path)


def observers(spark, d):
    """The metrics that a hook sees when all events have been read."""
    metrics = Observation()
    observed(messages(spark, d), metrics).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([metrics.get], "events long, cache_hits long, chars long, longest_ms long")


QUERIES = {
    "b3_atomic_publish": atomic_publish,
    "l4_observers": observers,
    "k1_stream_messages": stream_messages,
    "k1_stream_log_lines": stream_log_lines,
    "k2_stream_throughput": stream_throughput,
    "k3_stream_throttle": stream_throttle,
    "k4_stream_worker_stats": stream_worker_stats,
    "k5_dedupe_completions": dedupe_completions,
    "l1_engine_plugin": engine_plugin,
    "l3_guarded_apply": guarded,
}

ORACLES = {
    "b3_atomic_publish": f"WITH {sql.JOBS} SELECT book_id, sequence, task_id FROM jobs",
    "l4_observers": f"WITH {sql.MESSAGES} SELECT count(*) AS events, count(*) FILTER (cached) AS cache_hits, CAST(sum(chars) AS BIGINT) AS chars, max(audio_ms) AS longest_ms FROM messages",
    "k1_stream_messages": runs.ORACLES["a8_worker_messages"],
    "k1_stream_log_lines": "SELECT event_id, 'log ' || props AS line FROM events WHERE event_id % 5 = 0 AND event_id % 10 <> 0",
    "k2_stream_throughput": runs.ORACLES["f6_eta"].replace("SELECT run_id, task_id, round(", "SELECT run_id, task_id, processed, made_audio, fresh, round(f, 6) AS realtime_factor, round("),
    "k3_stream_throttle": runs.ORACLES["f10_throttle_samples"],
    "k4_stream_worker_stats": runs.ORACLES["e6_worker_throughput"],
    "k5_dedupe_completions": "SELECT user_id AS run_id, event_id AS task_id FROM events",
    "l1_engine_plugin": f"WITH {sql.JOBS} SELECT book_id || '/' || task_id AS task_id, duration_ms * 24 AS frames, 24000 AS sample_rate FROM jobs",
    "l3_guarded_apply": r"SELECT DISTINCT conv_id || '-' || turn || '-' || role AS task_id, 24000 AS sample_rate, true AS voiced FROM conversations WHERE regexp_matches(text, '\S')",
}
