"""Which conversion requests may run, and why others may not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.schemas import MAX_SPEED, MIN_CHUNK_CHARS, MIN_SPEED, PERFORMANCE_MODES, VOICE_MODES, engines, presets


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that is broken, null if none is."""
    return reduce(lambda c, rule: c.when(rule[0], rule[1]), rules[1:], F.when(*rules[0]))


def engine_lookup(requests: DataFrame) -> DataFrame:
    """Requests with their engine's properties; unknown engines keep nulls."""
    return requests.join(F.broadcast(engines(requests.sparkSession)), "engine_id", "left")


def preset_lookup(requests: DataFrame) -> DataFrame:
    return requests.join(F.broadcast(presets(requests.sparkSession)), "quality_key")


def eligible(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_reason``, rules in the order in which they are met."""
    rows = engine_lookup(requests.drop("max_chars"))
    wants = F.coalesce("needs_reference", F.lit(False)) | ((F.col("engine_id") == "xtts") & (F.col("voice_mode") == "clone"))
    rules = [
        (~F.lower("output").endswith(".m4b"), "output suffix"),
        (F.col("n_chapters") <= 0, "no chapter"),
        (F.col("max_chars").isNull(), "unknown engine"),
        (wants & ~F.col("has_reference"), "no reference"),
        (wants & ~F.col("consent"), "no consent"),
        (F.col("needs_licence") & ~F.col("licence_ok"), "licence"),
        (F.col("n_chunks") <= 0, "no chunk"),
    ]
    return rows.withColumn("reject_reason", first_reason(rules))


def validated(requests: DataFrame) -> DataFrame:
    """Requests with ``reject_reason`` for their options."""
    rules = [
        (~F.col("voice_mode").isin(*VOICE_MODES), "voice mode"),
        (~F.round("speed", 6).between(MIN_SPEED, MAX_SPEED), "speed"),
        (~F.col("performance_mode").isin(*PERFORMANCE_MODES), "performance mode"),
        (F.col("max_chars") < MIN_CHUNK_CHARS, "chunk limit"),
    ]
    return requests.withColumn("reject_reason", first_reason(rules))


def name_union(sources: list[DataFrame]) -> DataFrame:
    """Trimmed names of (pos, name) rows, first source first, each once at its first place; blanks dropped."""
    rows = reduce(DataFrame.unionByName, (s.select(F.lit(i).alias("source"), "pos", F.trim("name").alias("name")) for i, s in enumerate(sources)))
    return rows.filter("name is not null and name <> ''").groupBy("name").agg(F.min(F.struct("source", "pos")).alias("first"))


def resolve_name(requested: Column, listed: Column, default: str) -> Column:
    """The listed name to use: the one asked for, else the default, else, if that was asked for or none was, the first; null is an error."""
    has, some = F.array_contains(listed, requested), F.size(listed) > 0
    fallback = F.when(F.array_contains(listed, default), F.lit(default))
    missing = F.when(requested == default, F.get(listed, F.lit(0))).otherwise(fallback)
    return F.when(requested.isNull() | (requested == ""), F.coalesce(fallback, F.get(listed, F.lit(0)), F.lit(default))).when(some & ~has, missing).otherwise(requested)


def _must(found: Column, what: str, key: Column) -> Column:
    """True, or an error that names ``key`` where ``found`` is not true."""
    return F.when(F.coalesce(found, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(key.cast("string"), F.lit("null")))).cast("boolean"))


def known_only(results: DataFrame, jobs: DataFrame, key: str = "task_id") -> DataFrame:
    """``results`` joined with their jobs; a result of an unknown task is an error when it is reached."""
    rows = results.join(jobs.withColumn("_known", F.lit(True)), key, "left")
    return rows.filter(_must(F.col("_known"), "result of an unknown task", F.col(key))).drop("_known")


def require_each(parents: DataFrame, children: DataFrame, key: str, what: str) -> DataFrame:
    """``parents``, each of which must have a row in ``children``; one without is an error that says ``what`` it lacks."""
    some = children.select(key).distinct().withColumn("_some", F.lit(True))
    return parents.join(some, key, "left").filter(_must(F.col("_some"), what, F.col(key))).drop("_some")
