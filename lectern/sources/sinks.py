"""Sinks that only ever show complete output, and the folder for tables between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where none is set, a new folder serves a local master, whose executors are this machine; a cluster has no
    folder that could be guessed, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lectern_shared", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = sc._lectern_shared = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return named.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: what is used several times is worked out once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that ``df`` holds; each appears when all of it is written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def publish_batch(path: str):
    """A foreachBatch function that writes a batch under its id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        publish(batch.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")

    return write


def publish_batch_apart(path: str, apart: Column):
    """A foreachBatch function that writes a batch as two tables under its id: the rows where ``apart`` holds, and the others.

    Both are partitions of one write, so they appear together, and a repeated batch replaces itself in both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("apart", F.coalesce(apart, F.lit(False))).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("apart", "batch_id").parquet(path)

    return write


def read_apart(spark: SparkSession, path: str, columns: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The ``columns`` of the other rows, and of those that ``publish_batch_apart`` set apart; each reads its own files."""
    rows = spark.read.schema(T.StructType([*columns, T.StructField("apart", T.BooleanType()), T.StructField("batch_id", T.LongType())])).parquet(path)
    return tuple(rows.filter(side).select(*columns.names) for side in (~F.col("apart"), F.col("apart")))


def write_lines(df: DataFrame, path: str, partition: str, order: list[str], line: Column) -> None:
    """One folder of text files for each value of ``partition``; its files, by name, hold its lines in ``order``.

    Rows are dealt by ranges of partition and order, so a partition with most of the rows is written by many tasks.
    """
    rows = df.select(F.col(partition), *(F.col(c) for c in order), line.alias("value"))
    rows.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order).select(partition, "value").write.mode("overwrite").partitionBy(partition).text(path)
