"""A table of events delivered again as files that overlap in time, as several collectors would write them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.sinks import settled, shared_dir

#: Deliveries; each has most events of its stretch of time, and one in ``LATE`` of the stretch before.
DELIVERIES, LATE = 4, 5
#: Events of a file.
FILE_ROWS = 1_000_000


def delivered(events: DataFrame, key: str, deliveries: int = DELIVERIES) -> tuple[DataFrame, int]:
    """A stream of ``events`` (with ``at``, microseconds), a file or a few per batch, and how late an event may be, in seconds.

    ``ts`` is the event time; the last delivery is one row marked ``closing``, later than all by more than that, which lets go what waits.
    """
    spark, path = events.sparkSession, f"{shared_dir(events.sparkSession)}/delivered-{uuid.uuid4().hex}"
    found = events.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).first()
    first, width = found.first or 0, max(1, -(-((found.last or 0) - (found.first or 0) + 1) // deliveries))
    late = (F.pmod(F.xxhash64(key, F.lit("late")), F.lit(LATE)) == 0).cast("int")
    rows = events.withColumn("ts", F.timestamp_micros("at")).withColumn("closing", F.lit(False))
    dealt = settled(rows.withColumn("delivery", (F.floor((F.col("at") - first) / width) + late).cast("int")), "deliveries")
    files = max(1, -(-found.n // (deliveries * FILE_ROWS)))
    for i in range(deliveries + 1):  # one after the other, as they come in
        dealt.filter(F.col("delivery") == i).drop("delivery").repartition(files).write.mode("append").parquet(path)
    after = (found.last or 0) + 2 * width + 2_000_000
    end = rows.limit(0).unionByName(spark.range(1).select(F.timestamp_micros(F.lit(after)).alias("ts"), F.lit(True).alias("closing")), allowMissingColumns=True)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    delay = width // 1_000_000 + 1
    return stream.withWatermark("ts", f"{delay} seconds"), delay
