"""What the operators share: tables, shared-storage checkpoints, size checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.batches import ARROW_BYTES, for_python  # noqa: F401  the operators take them from here
from lectern.sources.sinks import shared_dir

#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Their bytes, written out, at most.
BROADCAST_BYTES = 128 << 20
#: Parts that the rows of a heavy key are dealt to where each of them meets many rows.
SALTS = 64
#: Keys with more than one in so many rows of a side are broadcast; there are fewer of them than this.
SPREAD = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor re-reads the table, it does not recompute what made it.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a settled ``df`` has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    if df.count() > BROADCAST_ROWS:
        return False
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first().n or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A settled ``df`` with a broadcast hint if it is small, else as it is."""
    return F.broadcast(df) if is_small(df) else df


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until it is none of the names ``taken``, whatever their case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def limit63(wanted: int, total: int) -> int:
    """The highest ``hash63`` of a share that holds about ``wanted`` of ``total``; the share is never empty, and whole if they are no more."""
    return min((1 << 63) - 1, (wanted << 63) // max(1, total))


def hash63(*of: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 1)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def unordered(df: DataFrame) -> list[str]:
    """The columns of ``df`` that hold maps, which have neither hash nor order."""
    return [f.name for f in df.schema.fields if not _hashable(f.dataType)]


def comparable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` for a hash or an order; those that have neither as their JSON."""
    maps = unordered(df)
    return [F.to_json(F.struct(F.col(f"`{c}`"))).alias(c) if c in maps else F.col(f"`{c}`") for c in df.columns]


def join_spread(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, salt: Column, how: str = "left", merge: bool = False, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts``, a settled table with one row for each key, by the keys ``on``.

    ``weight`` of facts is how many rows have the key.  Keys with more than one in SPREAD rows, so fewer than
    SPREAD keys, are broadcast, and their rows are dealt out by ``salt``; so no task gets all rows of a key.
    ``total`` is the sum of the weights, if the caller knows it.  ``merge`` makes the join of the other keys a sort-merge join at every size.  Null keys match nothing.
    """
    if total is None:
        total = facts.agg(F.sum(weight).alias("n")).first().n or 0
    is_heavy, given = F.coalesce(F.col(weight) * SPREAD > total, F.lit(False)), F.struct(*facts.columns)
    keys = [f"_on_{c}" for c in on]
    named = [F.col(c).alias(k) for c, k in zip(on, keys)]
    same = [F.col(c) == F.col(k) for c, k in zip(on, keys)]
    heavy, light = facts.filter(is_heavy).select(*named, given.alias("_heavy")), facts.filter(~is_heavy).select(*named, given.alias("_light"), (F.coalesce(F.col(weight), F.lit(0)).cast("long") % 1).alias("_zero"))  # 0, but no literal that would drop out of the keys
    left = rows.join(F.broadcast(heavy), same, "left").drop(*keys)
    left = left.withColumn("_dealt", F.when(F.col("_heavy").isNotNull(), F.pmod(salt.cast("long"), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    joined = left.join(light.hint("merge") if merge else light, [*same, F.col("_dealt") == F.col("_zero")], "left")
    found = F.coalesce("_heavy", "_light")
    if how == "inner":
        joined = joined.filter(F.col("_heavy").isNotNull() | F.col("_light").isNotNull())
    return joined.select(*(F.col(c) for c in rows.columns), *(found[c].alias(c) for c in facts.columns if c not in on))


def join_salted(rows: DataFrame, facts: DataFrame, on: list[str], salt: Column) -> DataFrame:
    """The inner join of settled ``rows`` with ``facts``, any number of rows a key, by the keys ``on``, none of them null.

    Keys with more than one in SPREAD of ``rows``, so fewer than SPREAD keys, are dealt to SALTS parts by ``salt``, and their
    facts are there in each of them; nothing but those keys is broadcast.
    """
    sizes = settle(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "key-sizes")
    total = sizes.agg(F.sum("_n").alias("n")).first().n or 0
    heavy = F.broadcast(sizes.filter(F.col("_n") * SPREAD > total).select(*on, F.lit(True).alias("_heavy")))
    dealt = rows.join(heavy, on, "left").withColumn("_salt", F.when(F.col("_heavy"), F.pmod(salt, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_heavy")
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = facts.join(heavy, on, "left").withColumn("_salt", F.explode(parts)).drop("_heavy")
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")
