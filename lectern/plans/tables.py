"""The narration model over the given tables: books, chapters, contents, jobs, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import keys, text
from lectern.operators.ordered import numbered, position_bucket, prefix_sums
from lectern.schemas import CHAPTER_PREFIX, MIN_CHAPTER_CHARS
from lectern.sources.sinks import settled

LIMIT, ENGINE = 220, "xtts"
OPTIONS = {"voice_mode": "builtin", "speed": "1.0", "performance_mode": "optimized", "worker_count": "4"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt out once where there are fewer files than cores: a file may be one row group."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, doc_id, text) of documents long enough to be chapters."""
    docs = documents(spark, sf_dir).select("source", "doc_id", "text")
    return docs.filter(F.length(text.strip(F.col("text"))) >= MIN_CHAPTER_CHARS).select(F.col("source").alias("book_id"), "doc_id", "text")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spine`` with chapter_index, title and source_href."""
    rows = numbered(spine(spark, sf_dir), ["book_id"], position_bucket(F.col("doc_id")), ["doc_id"], "chapter_index")
    return rows.select("book_id", "doc_id", "chapter_index", F.concat(F.lit(CHAPTER_PREFIX), F.col("chapter_index")).alias("title"), F.format_string("text/d%d.xhtml", "doc_id").alias("source_href"), "text")


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents rows from labels: a good document is listed, a poor one is a link to nothing."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), "doc_id")
    href = F.when(F.col("quality") == 1, F.format_string("text/d%d.xhtml#s%d", "doc_id", "toxic")).otherwise(F.format_string("text/x%d.xhtml", "doc_id"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("book_id", F.col("doc_id").alias("pos"), F.concat(F.lit("T"), F.col("doc_id")).alias("title"), href.alias("href"))


def options():
    return F.create_map(*(F.lit(x) for kv in OPTIONS.items() for x in kv))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk: its place in the book, key, seed and the stand-in duration of its narration."""
    chunked = settled(spine(spark, sf_dir).select("book_id", "doc_id", text.chunk_text(F.col("text"), LIMIT).alias("chunks")), "chunked")
    filled = (F.size("chunks") > 0).cast("long")
    placed = prefix_sums(chunked, ["book_id"], position_bucket(F.col("doc_id")), ["doc_id"], {"chapter_index": filled, "upto": F.size("chunks").cast("long")})
    rows = placed.select("book_id", "doc_id", "chapter_index", F.size("chunks").cast("long").alias("chapter_chunks"), "upto", F.posexplode("chunks").alias("i", "text"))
    rows = rows.withColumn("chunk_index", F.col("i").cast("long") + 1).withColumn("sequence", F.col("upto") - F.col("chapter_chunks") + F.col("chunk_index"))
    rows = rows.withColumn("key", keys.chunk_key(F.lit(ENGINE), options(), F.col("text")))
    rows = rows.withColumn("task_id", keys.task_id(F.col("chapter_index"), F.col("chunk_index"), F.col("key")))
    rows = rows.withColumn("seed", keys.stable_seed(F.col("task_id"), F.col("text")))
    rows = rows.withColumn("duration_ms", F.length("text").cast("long") * 60 + F.col("seed") % 200)
    return rows.select("book_id", "doc_id", "sequence", "chapter_index", "chunk_index", "chapter_chunks", "text", "key", "task_id", "seed", "duration_ms")


def artifacts(job_rows: DataFrame) -> DataFrame:
    """Finished files: every third job's, some of them cut short."""
    return job_rows.filter("seed % 3 = 0").select("book_id", "task_id", (F.lit(600) + F.col("seed") % 2000).alias("size"), (F.col("duration_ms") / 1000).alias("seconds"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker events: run, order, task, worker, what happened and how long it took."""
    events = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return events.select(
        F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("task_id"), (F.col("event_id") % 4).alias("worker"),
        F.col("event_type").alias("kind"), (F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "error").alias("failed"),
        F.rint(F.col("value") * 1000).cast("long").alias("audio_ms"), (k + 1).alias("chars"), (F.col("event_id") * 37 % 900 + 100).alias("wall_ms"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed tasks of each supplier's configurations: the line number is how many workers share them."""
    lines, workers = table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("long")
    start = F.floor(F.col("l_orderkey") * 37 % 24000 / workers).cast("long")
    return lines.select(
        F.col("l_suppkey").alias("config"), workers.alias("workers"), (F.col("l_orderkey") % workers).alias("worker"), F.col("l_orderkey").alias("task_id"),
        start.alias("started_ms"), (start + 100 + F.col("l_orderkey") % 900).alias("ended_ms"), F.rint(F.col("l_quantity") * 20).cast("long").alias("audio_ms"),
    )


def gpu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines, one in seven of them short of a field."""
    events = table(spark, sf_dir, "events")
    line = F.format_string("GPU %d, %d, %d.5, %d, 24576", F.col("user_id") % 5, F.col("event_id") % 101, F.col("event_id") % 300, F.col("event_id") * 13 % 24576)
    cut = F.format_string("GPU %d, %d", F.col("user_id") % 5, F.col("event_id") % 101)
    return events.select("event_id", (F.col("user_id") % 5).alias("device"), "ts", F.when(F.col("event_id") % 7 == 0, cut).otherwise(line).alias("line"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion requests, one per order."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pick = lambda by, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))
    return o.select(
        key.alias("request_id"),
        pick(key, "trendyol", "xtts", "mms", "other").alias("engine_id"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "high").when(F.substring("o_orderpriority", 1, 1) == "3", "standard").otherwise("low").alias("quality_key"),
        pick(F.floor(key / 3), "builtin", "clone", "whisper").alias("voice_mode"),
        pick(F.floor(key / 5), "optimized", "deepspeed", "compatibility", "turbo").alias("performance_mode"),
        (F.lit(0.5) + (key % 13) / 10).alias("speed"),
        (key % 7 != 0).alias("has_reference"), (key % 5 != 0).alias("consent"), (key % 11 != 0).alias("licence_ok"),
        F.concat(F.lit("out/"), key, pick(F.floor(key / 2), ".m4b", ".M4B", ".mp3")).alias("output"),
        (key % 17).alias("n_chapters"), (key % 17 * (key % 3)).alias("n_chunks"), (F.lit(60) + key % 40).alias("max_chars"),
        pick(F.floor(key / 7), "1,3-5,9", " 2 , 2-4", "5-3", "", "7", "0,1").alias("selector"),
    )
