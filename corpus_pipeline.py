"""A training corpus from raw documents: quality, near duplicates, contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last
return the columns of documents; the last adds the shard of each document and its slot there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, mixing, quality, sharding, simhash
from lectern.llm.common import fresh, settle, table

#: Target weights of the sources; None for the square root of their sizes.
WEIGHTS = None


def drop_poor_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts.

    Each row is scored by itself, repeated ones alike; null and empty texts are scored as empty ones.  Without labels of
    both kinds every document stays; no document gives none.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that SimHash links.

    Null, empty and wordless texts are one group.  Of rows that repeat the smallest id one stays; a null id stays only
    in a group where no row has another.
    """
    return simhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated.

    Null and wordless texts stay; repeated rows are judged alike; an empty benchmark keeps every document.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _mixed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with their place in the mix, and the name of that column, which none of docs has."""
    prefix = "mix_"
    while any(fresh(docs.columns, prefix + m) != prefix + m for m in mixing.MADE):
        prefix = "_" + prefix
    place = prefix + "mix_position"
    return mixing.mixed(docs, weights=WEIGHTS, prefix=prefix).select(*docs.columns, place), place


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the files' order, as the Pfair schedule of their sources has them.

    A null source is a source; rows without an id have a place by their other columns; repeated rows all stay.
    """
    placed, place = _mixed(docs)
    return placed.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it, shuffled inside consecutive runs of the mix.

    The mix is worked out again, since files read in any order, and gives the same places.  A null id is a key like
    any other; a null text has no bytes; repeated rows share a shard.
    """
    placed, place = _mixed(docs)
    size = fresh(placed.columns, "size")
    placed = settle(placed.withColumn(size, F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1), "mixed-records")
    return sharding.sharded(placed, "doc_id", size, order=place).drop(size, place)


STAGES = [
    ("quality classifier", drop_poor_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: A classifier is trained on the way; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
