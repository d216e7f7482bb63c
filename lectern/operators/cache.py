"""Finished artifacts: which count, which jobs they save, what is left to run or to delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.schemas import MIN_ARTIFACT_BYTES, MIN_ARTIFACT_SECONDS


def valid_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.filter((F.col("size") > MIN_ARTIFACT_BYTES) & (F.col("seconds") > MIN_ARTIFACT_SECONDS))


def probe(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``jobs`` with ``cached`` and the artifact's ``seconds``, null for jobs to run."""
    found = valid_artifacts(artifacts).groupBy("book_id", "task_id").agg(F.max("seconds").alias("seconds"))
    return jobs.join(found, ["book_id", "task_id"], "left").withColumn("cached", F.col("seconds").isNotNull())


def pending(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    return jobs.join(valid_artifacts(artifacts), ["book_id", "task_id"], "left_anti")


def removable(artifacts: DataFrame, finished: DataFrame) -> DataFrame:
    """Artifacts of runs that finished and are not to be kept: (book_id, keep) rows of ``finished``."""
    return artifacts.join(finished.filter("not keep"), "book_id", "left_semi")


#: Rows of a side that one task matches, about.
MATCH_ROWS = 1 << 20


def matched(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results with their job and ``known``; of unknown tasks with nulls for a job.

    Both sides are counted and dealt to as many tasks as their rows need, so a task sorts no more of them where there are more.
    """
    cores = results.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-max(results.count(), jobs.count()) // MATCH_ROWS))
    told = jobs.withColumn("known", F.lit(True)).repartition(parts, "task_id")
    return results.repartition(parts, "task_id").join(told, "task_id", "left").withColumn("known", F.col("known").isNotNull())


def match_results(results: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results with their job, and results of unknown tasks."""
    rows = matched(results, jobs)
    return rows.filter("known").drop("known"), rows.filter("not known").select(*results.columns)
