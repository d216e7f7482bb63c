"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of an order bucket over dense integer positions.
BUCKET = 4096


def position_bucket(position: Column, width: int = BUCKET) -> Column:
    return F.floor(position / width).cast("long")


def prefix_sums(df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """``df`` with a running sum for each of ``sums``, per ``keys``, in ``order``.

    ``bucket`` must not decrease along the order and bounds how many rows are sorted together.  Sums run inside
    a bucket first; the totals of earlier buckets, one row each, are added to them.  So a group that holds
    most rows is still spread over its buckets.  ``before`` leaves the row itself out of its sum.
    """
    rows = df.withColumn("_bucket", bucket)
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*keys, "_bucket").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0).cast("long")).alias(f"_t_{n}") for n in sums))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_s_{n}") for n in sums))
    rows = rows.join(totals, [*keys, "_bucket"])
    own = lambda n: F.col(f"_v_{n}") if before else F.lit(0)
    return rows.select(*(F.col(c) for c in df.columns if c not in sums), *((F.col(f"_s_{n}") + F.col(f"_t_{n}") - own(n)).cast("long").alias(n) for n in sums))


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with the row's number in its group, from 1."""
    return prefix_sums(df, keys, bucket, order, {name: F.lit(1).cast("long")})
