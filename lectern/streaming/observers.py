"""Hooks on running work: metrics of a batch, progress of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(events: DataFrame, metrics: Observation) -> DataFrame:
    """``events``, unchanged; when they have been read, ``metrics`` holds their counts and sums."""
    return events.observe(metrics, F.count(F.lit(1)).alias("events"), F.count_if("cached").alias("cache_hits"), F.sum("chars").alias("chars"), F.max("audio_ms").alias("longest_ms"))


class Progress(StreamingQueryListener):
    """Calls ``report`` with (batch, rows read, rows a second) after every batch, and ``failed`` with an error."""

    def __init__(self, report: Callable[[int, int, float], None], failed: Callable[[str], None] = lambda _: None):
        self.report, self.failed = report, failed

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed(event.exception)
