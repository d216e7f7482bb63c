"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records into buckets that fit in memory, by seeded hashes: the shard is the one of the
shards whose hash with the key is highest, so the key and the number of shards decide it and one more shard
only takes records to itself; the bucket inside the shard is another hash.  Pass two orders each bucket by a
Fisher-Yates shuffle, whose draws are hashes of seed, shard and bucket, and numbers its records after those of the
buckets before it.  A bucket is one row, permuted in one task, from a sorted array; so a slot depends on the records
and the seed, not on how many tasks there are, but for records alike in all columns that are too many for a bucket.

A null key is a key like any other; a null text has no bytes.  Repeated rows are records of their own and
share a shard.  No row gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import comparable, fresh, join_spread, settle, table, unordered

SHARDS, SEED = 8, 42
#: Target bytes of a bucket, and bytes counted for each record besides its own.
BUCKET_BYTES, RECORD_BYTES = 8 << 20, 64
#: Target records of a bucket, beyond which a permutation by array functions would take long.
BUCKET_ROWS = 2048
#: Cells that an order to keep is cut into.
CELLS = 1 << 16
#: Runs of an order to keep that a shard has at least.
RUNS = 16


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard (from 0) whose hash with ``key`` is highest; the first of equal ones."""
    scores = F.array(*(F.xxhash64(key, F.lit(seed), F.lit(s)) for s in range(shards)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _runs(records: DataFrame, size: Column, order: str, buckets: int, total: int) -> tuple[DataFrame, int]:
    """(cell, bucket): which of ``buckets`` runs of about equal bytes along ``order`` each cell of it is in; at most CELLS rows and one."""
    last = records.agg(F.max(order).alias("last")).first().last or 0
    width = max(1, -(-(last + 1) // CELLS))
    cells = records.groupBy(F.floor(F.col(order) / width).cast("long").alias("cell")).agg(F.sum(size).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return cells.select("cell", F.least(F.lit(buckets - 1), F.floor(before / max(1, total) * buckets)).cast("int").alias("bucket")), width


def _permutation(n: Column, *seeds: Column) -> Column:
    """The numbers from 0 to n - 1 after a Fisher-Yates shuffle whose draws are hashes of ``seeds``."""

    def swap(a: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        one = lambda at: F.slice(a, at + 1, F.lit(1))
        swapped = F.concat(F.slice(a, F.lit(1), j), one(i), F.slice(a, j + 2, i - j - 1), one(j), F.slice(a, i + 2, n - i - 1))
        return F.when(j == i, a).otherwise(swapped)

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), n - 1), swap)


def _by(a: Column, b: Column) -> Column:
    return F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0)


def sharded(records: DataFrame, key: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, order: str | None = None) -> DataFrame:
    """Every row of settled ``records`` with ``shard`` and ``slot``, the place in its shard from 0, in place of columns so named.

    With ``order``, a column of different positions from 0, a shard's buckets are consecutive runs of about equal
    bytes along it, at least RUNS, so a shard follows that order but for the shuffle inside a run.
    """
    bytes_of = F.col(size) + RECORD_BYTES
    found = records.agg(F.sum(bytes_of).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    total = found.bytes or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)), -(-found.rows // (shards * BUCKET_ROWS)))
    names = records.columns
    plain, maps = comparable(records), unordered(records)
    whole = F.xxhash64(*plain)
    record = F.struct(F.struct(*plain).alias("by"), F.struct(*maps).alias("of")) if maps else F.struct(*names)
    placed = records.select(record.alias("record"), shard_of(F.col(key), shards, seed).alias("shard"), *([whole.alias("h")] if order is None else [F.col(order).alias("at")]))
    if order is not None:
        buckets = max(RUNS, buckets)
        runs, width = _runs(records, bytes_of, order, buckets, total)
        placed = placed.withColumn("cell", F.floor(F.col("at") / width).cast("long")).join(F.broadcast(runs), "cell")
    else:
        copies = settle(records.groupBy(whole.alias("h")).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > BUCKET_ROWS), "shard-copies")
        salt = F.lit(0).cast("long")
        if not copies.isEmpty():  # rows alike in all columns, more than a bucket: dealt to all buckets by where they are read
            placed = join_spread(placed.withColumn("at", F.monotonically_increasing_id()), copies, ["h"], "copies", F.col("at"))
            salt = F.when(F.col("copies").isNotNull(), F.col("at") + 1).otherwise(F.lit(0).cast("long"))
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("h", salt, F.lit(seed), F.lit("bucket")), F.lit(buckets)).cast("int"))
    placed = placed.select("record", "shard", "bucket")

    full = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("start"))
    gathered = placed.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("record"), *([_by] if maps else [])).alias("records"))
    permuted = _permutation(F.size("records"), F.lit(seed), F.col("shard"), F.col("bucket"))
    mixed = gathered.join(offsets, ["shard", "bucket"]).select("shard", "start", "records", permuted.alias("places"))
    rows = mixed.select("shard", "start", F.posexplode(F.transform("places", lambda p: F.get("records", p))).alias("place", "record"))
    part = lambda c: F.col("record")["of" if c in maps else "by"] if maps else F.col("record")
    own = [part(c)[c].alias(c) for c in names if c not in ("shard", "slot")]
    return rows.select(*own, "shard", (F.col("start") + F.col("place")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are shuffled into the shards; sizes and checksums are those of the texts that lie there."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size_of = F.octet_length(text).cast("long") + 1
    docs = table(spark, sf_dir, "documents")  # as good as settled: a table that is read, with no work before it
    size = fresh(docs.columns, "size")
    found = sharded(docs.withColumn(size, size_of), "doc_id", size).drop(size)
    grown = shard_of(F.col("doc_id"), SHARDS + 1)
    return found.select("doc_id", size_of.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {}
