"""Where chunks and chapters lie in time, and the texts written from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import escape_metadata
from lectern.operators.ordered import position_bucket, prefix_sums


def _duration():
    """duration_ms, an error for a job without one: nothing may be put together before all are done."""
    return F.coalesce("duration_ms", F.raise_error(F.lit("a job has no duration")).cast("long"))


def elapsed(jobs: DataFrame) -> DataFrame:
    """``jobs`` with start_ms and end_ms of every chunk in its book."""
    rows = prefix_sums(jobs, ["book_id"], position_bucket(F.col("sequence")), ["sequence"], {"end_ms": _duration()})
    return rows.withColumn("start_ms", F.col("end_ms") - F.col("duration_ms"))


def chapter_timeline(jobs: DataFrame) -> DataFrame:
    """(book_id, chapter_index, start_ms, end_ms): a chapter ends a millisecond after its start at least."""
    chapters = jobs.groupBy("book_id", "chapter_index").agg(F.sum(_duration()).alias("chapter_ms"))
    rows = prefix_sums(chapters, ["book_id"], position_bucket(F.col("chapter_index")), ["chapter_index"], {"upto": F.col("chapter_ms")})
    start = F.col("upto") - F.col("chapter_ms")
    return rows.select("book_id", "chapter_index", start.alias("start_ms"), F.greatest(F.col("upto"), start + 1).alias("end_ms"))


#: Chunks of a segment of a book's list of paths.
SEGMENT = 4096


def timeline_total(jobs: DataFrame, path: Column) -> DataFrame:
    """(book_id, total_ms, n_chunks, paths): how long a book is, and the paths of its chunks in order.

    The list is put in order in segments, many tasks for a long book; one row of segments makes the book's.
    """
    rows = jobs.select("book_id", position_bucket(F.col("sequence"), SEGMENT).alias("segment"), "sequence", _duration().alias("ms"), path.alias("path"))
    parts = rows.groupBy("book_id", "segment").agg(F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("sequence", "path"))).alias("paths"))
    parts = parts.select("book_id", "segment", "ms", "n", F.transform("paths", lambda p: p["path"]).alias("paths"))
    books = parts.groupBy("book_id").agg(F.sum("ms").alias("total_ms"), F.sum("n").alias("n_chunks"), F.array_sort(F.collect_list(F.struct("segment", "paths"))).alias("all"))
    return books.select("book_id", "total_ms", "n_chunks", F.flatten(F.transform("all", lambda s: s["paths"])).alias("paths"))


def chapter_metadata_doc(timings: DataFrame, title, author) -> DataFrame:
    """(book_id, doc): the chapter metadata text of every book, one section per row of ``timings``."""
    section = F.concat_ws(
        "\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.greatest(F.col("start_ms"), F.lit(0))),
        F.concat(F.lit("END="), F.greatest(F.col("start_ms") + 1, F.col("end_ms"))), F.concat(F.lit("title="), escape_metadata(F.col("title"))),
    )
    books = timings.select("book_id", F.struct("chapter_index", section.alias("text")).alias("s")).groupBy("book_id").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    name, by = escape_metadata(title), escape_metadata(author)
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), name, F.lit("\nartist="), by, F.lit("\nalbum="), name, F.lit("\nmedia_type=2\n"))
    return books.select("book_id", F.concat(head, F.array_join(F.transform("sections", lambda s: s["text"]), "\n"), F.lit("\n")).alias("doc"))


def manifest_lines(jobs: DataFrame, path) -> DataFrame:
    """(book_id, sequence, line) of the ordered list of chunk files, quotes escaped."""
    return jobs.select("book_id", "sequence", F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'")).alias("line"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """(task_id, frames, sample_rate, seconds) of tasks done in parts; parts of different rates are an error."""
    rows = parts.groupBy("task_id").agg(F.sum("frames").alias("frames"), F.min("sample_rate").alias("sample_rate"), F.max("sample_rate").alias("other"))
    mismatch = F.raise_error(F.concat(F.lit("parts of different sample rates: "), F.col("task_id").cast("string"))).cast("int")
    rate = F.when(F.col("sample_rate") == F.col("other"), F.col("sample_rate")).when(F.col("sample_rate") != F.col("other"), mismatch)
    return rows.select("task_id", "frames", rate.alias("sample_rate")).select("*", F.round(F.col("frames") / F.col("sample_rate"), 6).alias("seconds"))
