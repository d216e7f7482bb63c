"""Artifacts kept between runs: a table by run, audio files by chapter, and their listing without reading them."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.schemas import MIN_ARTIFACT_BYTES
from lectern.sources.batches import for_python
from lectern.sources.sinks import publish, settled

STORED = "task_id string, size bigint, seconds double, book_id string"
#: Bytes before the samples of a plain audio file, and the byte after them that ends it.
HEAD_BYTES, PAD = 44, "\x00"
#: Tasks for each core that write files or list folders, where a file costs more than its bytes.
TASKS_PER_CORE = 4
_LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Bytes that a file counts besides its own where files are dealt to tasks; by Spark's 4 MB a task would get a few of them.
_OPENING, OPEN_BYTES = "spark.sql.files.openCostInBytes", 64 << 10
#: Characters of a value that the name of its folder holds as %XX, and the name for no value, as Spark has them.
_ESCAPED, _NO_VALUE = re.compile(r"""[\x00-\x1f\x7f"#%'*/:=?\\{[\]^]"""), "__HIVE_DEFAULT_PARTITION__"


def save(artifacts: DataFrame, path: str) -> None:
    """Keep ``artifacts`` (book_id, task_id, size, seconds) at ``path``; a run saved again replaces what it kept before."""
    publish(artifacts.select("task_id", F.col("size").cast("long"), F.col("seconds").cast("double"), F.col("book_id").cast("string")), path, "book_id")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What was saved at ``path``, partitioned by book_id, so a join with a few books' jobs reads those alone."""
    return spark.read.schema(STORED).parquet(path)


def _little_endian(n: Column, width: int) -> Column:
    digits = [F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*digits))


def _number(head: Column, at: int, width: int) -> Column:
    """The little-endian number at byte ``at``, from 0."""
    digits = F.concat(*(F.hex(F.substring(head, at + i + 1, 1)) for i in reversed(range(width))))
    return F.conv(digits, 16, 10).cast("long")


def audio(duration_ms: Column, rate: int) -> Column:
    """The bytes of a mono 8-bit audio file of silence, but for PAD, as a string that a text sink writes as it is."""
    n = F.floor(duration_ms * rate / 1000).cast("long")
    word = lambda s: F.encode(F.lit(s), "UTF-8")
    constant = lambda v, width: _little_endian(F.lit(v), width)
    head = [word("RIFF"), _little_endian(n + HEAD_BYTES - 8, 4), word("WAVEfmt "), constant(16, 4), constant(1, 2), constant(1, 2), constant(rate, 4), constant(rate, 4), constant(1, 2), constant(8, 2), word("data"), _little_endian(n, 4)]
    return F.concat(F.concat(*head).cast("string"), F.repeat(F.lit(PAD), n.cast("int")))


def _tasks(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def _folder(column: str, value: object) -> str:
    text = "" if value is None else str(value)
    return f"{column}={_ESCAPED.sub(lambda m: f'%{ord(m[0]):02X}', text) or _NO_VALUE}"


def _placed(root: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write each row's ``value`` to a file below ``root``; what other runs left in its folder goes once the first file is there."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, attempt, before, n = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), None, 0
        for batch in batches:
            for book, chapter, value in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{root}/{_folder('book_id', book)}/{_folder('chapter_index', chapter)}"
                n, before = n + 1 if folder == before else 0, folder
                name = f"part-{task:05d}-{run}.c{n:03d}.txt"  # the same for each attempt
                os.makedirs(folder, exist_ok=True)
                with open(staged := f"{folder}/.{name}-{attempt}", "wb") as f:
                    f.write(value.rstrip(b"\0"))
                    f.truncate(len(value) + len(PAD))  # zeros to there, a hole where the file system has them
                os.replace(staged, f"{folder}/{name}")
                for old in os.listdir(folder) if n == 0 else ():
                    if run not in old:
                        os.unlink(f"{folder}/{old}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return write


def save_audio(chapters: DataFrame, path: str, rate: int) -> None:
    """One file for each row (book_id, chapter_index, duration_ms), in a folder of its book and chapter; whole files only appear.

    Rows are few bytes and files are dear, so rows are dealt to all cores whatever their size; each task moves its own files into place.
    On a local file system (``file:``, also one that all machines mount) Hadoop starts two processes for each file that it
    makes, to set permissions; there the tasks write the files themselves, under the names that Spark's writer would give.
    """
    dealt = chapters.select(F.col("book_id").cast("string"), "chapter_index", "duration_ms").repartition(_tasks(chapters.sparkSession), "book_id", "chapter_index")
    rows = dealt.sortWithinPartitions("book_id", "chapter_index").select("book_id", "chapter_index", audio(F.col("duration_ms"), rate).alias("value"))
    if urlsplit(path).scheme == "file":
        os.makedirs(root := unquote(urlsplit(path).path), exist_ok=True)  # also where no row comes
        place = _placed(root, uuid.uuid4().hex)
        for_python(rows.withColumn("value", F.col("value").cast("binary"))).mapInArrow(place, "n long").agg(F.sum("n")).collect()
        return
    made = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    made.option("lineSep", PAD).option("maxRecordsPerFile", 1).partitionBy("book_id", "chapter_index").text(path)


@contextmanager
def _by_few(spark: SparkSession) -> Iterator[None]:
    """Folders are listed and files are read by a few tasks for each core, not by one for each folder or for a few files."""
    before = {k: spark.conf.get(k) for k in (_LISTERS, _OPENING)}
    spark.conf.set(_LISTERS, _tasks(spark))
    spark.conf.set(_OPENING, OPEN_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files under ``path`` as Spark's binaryFile source gives them, listed now, once for all that is read from them."""
    with _by_few(spark):
        found = spark.read.format("binaryFile").load(path)
    return found.withColumns({"book_id": F.col("book_id").cast("string"), "chapter_index": F.col("chapter_index").cast("long")})


def listing(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """(book_id, chapter_index, path, length, modificationTime) of the files under ``path``, or of those ``found`` there; no file is opened."""
    return (files(spark, path) if found is None else found).select("book_id", "chapter_index", "path", "length", "modificationTime")


def measured(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """``listing`` of the files large enough to count, with ``seconds`` as their heads say; null where a head is no audio's."""
    counted = (files(spark, path) if found is None else found).filter(F.col("length") > MIN_ARTIFACT_BYTES)
    rows = counted.select("book_id", "chapter_index", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))
    sound = (F.substring("head", 1, 4) == F.encode(F.lit("RIFF"), "UTF-8")) & (F.substring("head", 37, 4) == F.encode(F.lit("data"), "UTF-8"))
    seconds = F.when(sound, _number(F.col("head"), 40, 4) / F.nullif(_number(F.col("head"), 28, 4), F.lit(0)))
    return rows.select("book_id", "chapter_index", "length", seconds.alias("seconds"))


def inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``listing`` and ``measured`` as tables, where there may be very many files; they are listed once.

    Spark's own reading of folders' names takes a time that grows with the square of their number, so it is left off, and
    a file's path tells its book and chapter.  So books are told as they are written (``007`` is no number).
    """

    def told(column: str) -> Column:
        text = F.regexp_extract("path", f"/{column}=([^/]*)/[^/]*(?:/[^/]*)?$", 1)
        return F.url_decode(F.replace(F.when(text != _NO_VALUE, text), F.lit("+"), F.lit("%2B")))

    with _by_few(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        found = found.withColumns({"book_id": told("book_id"), "chapter_index": told("chapter_index").cast("long")})
        return settled(listing(spark, path, found), "listing"), settled(measured(spark, path, found), "measured")
