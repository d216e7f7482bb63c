"""Narration engines: any model that turns chunks into audio lengths, loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import enforce_limit
from lectern.operators.timeline import merge_parts

RESULT = "task_id string, part int, frames long, sample_rate int"


class Engine(Protocol):
    """What a model must offer; an instance is sent to the workers before ``load``."""

    def load(self) -> None: ...

    def synthesize(self, texts: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        """frames and sample_rate of each text."""


@dataclass(frozen=True)
class ColumnEngine:
    """An engine that is a column: ``frames`` of (text, seed), all at one rate; it runs inside the JVM."""

    frames: Callable[[Column, Column], Column]
    sample_rate: int


def apply_engine(jobs: DataFrame, engine: Engine | ColumnEngine) -> DataFrame:
    """RESULT rows of ``jobs`` (task_id, part, text, seed): as columns, or batch by batch in Python workers."""
    if isinstance(engine, ColumnEngine):
        return jobs.select("task_id", "part", engine.frames(F.col("text"), F.col("seed")).cast("long").alias("frames"), F.lit(engine.sample_rate).alias("sample_rate"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine.load()
        for batch in batches:
            made = engine.synthesize(batch["text"], batch["seed"])
            yield batch[["task_id", "part"]].assign(frames=made["frames"].astype("int64"), sample_rate=made["sample_rate"].astype("int32"))

    return jobs.select("task_id", "part", "text", "seed").mapInPandas(run, RESULT)


def guarded_apply(jobs: DataFrame, engine: Engine | ColumnEngine, limit: int) -> DataFrame:
    """(task_id, frames, sample_rate, seconds) of (task_id, text, seed) rows; texts over the limit go in parts that are merged."""
    parts = jobs.select("task_id", "seed", F.posexplode(enforce_limit(F.array("text"), limit)).alias("part", "text"))
    return merge_parts(apply_engine(parts, engine))
