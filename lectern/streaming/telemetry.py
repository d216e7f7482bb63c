"""Streams of completion events: routing, running statistics, throttling, deduplication.

What depends on the order of events (``throttled``, ``tracked``) takes them in event time, whatever files or batches they
come in: a key's events wait in its state until the watermark has passed them, and a timer hands them over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.schemas import WARMUP_CHUNKS
from lectern.sources.feeds import parse_messages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def routed(lines: DataFrame, line: str) -> DataFrame:
    """A stream of message lines with their parsed form and route."""
    return parse_messages(lines, line)


def worker_stats(events: DataFrame) -> DataFrame:
    """Running totals per run and worker; for update or complete mode."""
    return events.filter("not cached").groupBy("run_id", "worker").agg(F.sum("audio_ms").alias("audio_ms"), F.sum(F.greatest("wall_ms", F.lit(0))).alias("wall_ms"), F.count(F.lit(1)).alias("chunks"))


def dedupe_completions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each task once, however often its completion is delivered within ``delay``."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "task_id"])


def _shape(fields: str) -> T.StructType:
    """A state's columns, all long but those with a kind."""
    out = T.StructType()
    for field in fields.split():
        name, _, kind = field.partition(":")
        out = out.add(name, kind or "long")
    return out


#: Waiting events of a block of state, and events that are Python objects at a time.
BLOCK_ROWS, STEP_ROWS = 100_000, 10_000


def _block(events: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, events.schema) as out:
        out.write_table(events)
    return sink.getvalue().to_pybytes()


def _read(state, schema: pa.Schema) -> pa.Table:
    """The rows of all blocks of a list state."""
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(b[0])).read_all() for b in state.get())])


class _InOrder(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then hands them to ``released`` by time and ``tie``.

    They wait as Arrow blocks of columns, so an event takes the bytes of its values and no Python object.

    Events later than the watermark's delay are dropped by Spark; so are those without a time.
    """

    fields, tie = "at", "at"

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}
        self.handle, self.schema = handle, pa.schema([(f.name, kinds[f.dataType]) for f in _shape(self.fields)])
        self.waiting = handle.getListState("waiting", _shape("block:binary"))
        self.due = handle.getValueState("due", _shape("at"))

    def _wake(self, at: int) -> None:
        """Have a timer for the event at ``at``, in microseconds; a key has one, for its earliest event."""
        due = -(-at // 1000)
        if self.due.exists():
            if self.due.get()[0] <= due:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(due)
        self.due.update((due,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            part = part[~part["closing"].astype(bool)].reindex(columns=self.schema.names)
            if len(part):
                columns = [pa.Array.from_pandas(part[f.name], type=f.type) for f in self.schema]
                self.waiting.appendList([(_block(pa.Table.from_arrays(columns, schema=self.schema)),)])
                first = int(part["at"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        events = _read(self.waiting, self.schema).sort_by([("at", "ascending"), (self.tie, "ascending")])
        n = int(events["at"].to_numpy().searchsorted(passed, side="right"))
        ready, rest = events.slice(0, n), events.slice(n)
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(_block(rest.slice(i, BLOCK_ROWS)),) for i in range(0, len(rest), BLOCK_ROWS)])
            self._wake(rest["at"][0].as_py())
        for i in range(0, n, STEP_ROWS):
            yield self.released(key, ready.slice(i, STEP_ROWS).to_pylist())

    def released(self, key, events: list[dict]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Throttle(_InOrder):
    """Keeps a device's sample if the last kept one is ``gap`` microseconds ago."""

    fields, tie = "at event_id", "event_id"

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", _shape("at"))

    def released(self, key, events: list[dict]) -> pd.DataFrame:
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for e in events:
            if last is None or e["at"] - last >= self.gap:
                last = e["at"]
                kept.append(e["event_id"])
        self.last.update((last,))
        return pd.DataFrame({"device": pd.array([key[0]] * len(kept), "Int64"), "event_id": pd.array(kept, "Int64")})


def _ordered(events: DataFrame, key: str, processor: _InOrder, output: str) -> DataFrame:
    return events.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")


def throttled(samples: DataFrame, seconds: float) -> DataFrame:
    """(device, event_id) of the samples kept, of a watermarked stream of (device, at in microseconds, event_id, closing)."""
    return _ordered(samples, "device", _Throttle(int(seconds * 1_000_000)), "device long, event_id long")


_FIELDS = ("processed", "audio", "made_chars", "made_audio", "worked", "hits", "fresh", "first_at", "first_audio", "total", "started")
TRACKED = "run_id long, task_id long, processed long, made_audio long, fresh long, realtime_factor double, eta_seconds double, eta_warmup boolean"


def _rounded(value: float, places: int) -> float:
    """To so many places as in SQL: the scaled value, halves away from zero."""
    scaled = abs(value) * 10.0**places
    whole = math.floor(scaled)
    return math.copysign((whole + (scaled - whole >= 0.5)) / 10.0**places, value)


class _Tracker(_InOrder):
    """The throughput counters of a group of runs, kept between batches; one row after each event.

    To call a key and to reach its state takes the time of thousands of events, so runs, many and short as they may be, share a key.
    """

    fields, tie = "run_id at task_id cached:boolean chars audio_ms wall_ms total", "task_id"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters = pa.schema([(f, pa.int64()) for f in ("run_id", *_FIELDS)])
        self.state = handle.getListState("counters", _shape("block:binary"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs = {s["run_id"]: s for s in _read(self.state, self.counters).to_pylist()}
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        counted = pa.Table.from_pylist(list(self.runs.values()), schema=self.counters)
        self.state.put([(_block(counted.slice(i, BLOCK_ROWS)),) for i in range(0, len(counted), BLOCK_ROWS)])

    def released(self, key, events: list[dict]) -> pd.DataFrame:
        out = []
        for e in events:
            s = self.runs.get(e["run_id"])
            if s is None:
                s = self.runs[e["run_id"]] = dict.fromkeys(_FIELDS, 0) | {"run_id": e["run_id"], "first_at": None, "started": e["at"]}
            s["total"] = e["total"]
            s["processed"] += e["chars"]
            s["audio"] += e["audio_ms"]
            if e["cached"]:
                s["hits"] += 1
            else:
                s["fresh"] += 1
                s["made_chars"] += e["chars"]
                s["made_audio"] += e["audio_ms"]
                s["worked"] += max(0, e["wall_ms"])
                if s["first_at"] is None:
                    s["first_at"], s["first_audio"] = e["at"], e["audio_ms"]
            out.append((e["run_id"], e["task_id"], s["processed"], s["made_audio"], s["fresh"], *self.estimate(s, e["at"])))
        found = pd.DataFrame(out, columns=["run_id", "task_id", "processed", "made_audio", "fresh", "realtime_factor", "eta_seconds", "eta_warmup"])
        return found.astype({"run_id": "Int64", "eta_seconds": "float64"})

    @staticmethod
    def estimate(s: dict, now: int) -> tuple[float, float | None, bool]:
        left, warm = max(s["total"] - s["processed"], 0), s["fresh"] >= WARMUP_CHUNKS
        factor = (s["made_audio"] - s["first_audio"]) * 1000 / (now - s["first_at"]) if warm and now > s["first_at"] else 0.0
        if left == 0 and factor <= 0:
            factor = s["made_audio"] / s["worked"] if s["worked"] > 0 else 0.0
        eta = 0.0 if left == 0 else left * s["made_audio"] / s["made_chars"] / 1000 / factor if factor > 0 and s["made_chars"] > 0 and warm else None
        return _rounded(factor, 6), None if eta is None else _rounded(eta, 4), not warm and left > 0


#: Groups of runs of a stream whose size is not known.
GROUPS = 1024


def tracked(events: DataFrame, groups: int = GROUPS) -> DataFrame:
    """TRACKED rows of a watermarked stream of (run_id, task_id, at, cached, chars, audio_ms, wall_ms, total, closing).

    Runs are dealt to ``groups`` keys of state by a hash; a checkpoint keeps to its number.
    """
    return _ordered(events.withColumn("group", F.pmod(F.xxhash64("run_id"), F.lit(groups))), "group", _Tracker(), TRACKED)
