"""Events that wait for the watermark: few bytes each, handed over in order and in steps."""

import duckdb
import numpy as np
import pandas as pd

from lectern.plans import streams
from lectern.streaming import telemetry as S


class State:
    def __init__(self):
        self.rows = []

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows) if isinstance(self, Listed) else self.rows[0]

    def clear(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def update(self, row):
        self.rows = [row]


class Listed(State):
    pass


class Handle:
    def getListState(self, name, shape):
        return Listed()

    def getValueState(self, name, shape):
        return State()

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_events_take_the_bytes_of_their_values_and_leave_in_order():
    p, seen = S._Throttle(1_000_000), []
    p.init(Handle())
    given = p.released
    p.released = lambda key, events: (seen.append([(e["at"], e["event_id"]) for e in events]), given(key, events))[1]
    at = np.random.default_rng(1).permutation(250_000)
    parts = (pd.DataFrame({"at": at[i : i + 10_000] // 2 * 1000, "event_id": at[i : i + 10_000], "closing": False}) for i in range(0, len(at), 10_000))
    assert list(p.handleInputRows((1,), parts, None)) == []
    assert sum(len(r[0]) for r in p.waiting.rows) < 20 * len(at)
    kept = pd.concat(list(p.handleExpiredTimer((1,), Clock(99_999), None)))
    events = [e for step in seen for e in step]
    assert events == [(i // 2 * 1000, i) for i in range(200_000)] and max(map(len, seen)) <= S.STEP_ROWS
    assert kept["event_id"].tolist() == list(range(0, 200_000, 2000))
    rest = pd.concat(list(p.handleExpiredTimer((1,), Clock(10**9), None)))
    assert rest["event_id"].tolist() == list(range(200_000, 250_000, 2000)) and not p.waiting.exists()


def test_nulls_wait_as_nulls():
    p = S._Tracker()
    p.init(Handle())
    row = {"at": 5, "task_id": 1, "cached": True, "chars": 3, "audio_ms": None, "wall_ms": 2, "total": 3}
    list(p.handleInputRows((1,), iter([pd.DataFrame([row | {"closing": False}, row | {"audio_ms": 7, "cached": None, "closing": False}])]), None))
    seen = []
    p.released = lambda key, events: (seen.extend(events), pd.DataFrame())[1]
    list(p.handleExpiredTimer((1,), Clock(1), None))
    assert [(e["cached"], e["audio_ms"]) for e in seen] == [(True, None), (None, 7)]


class Kept(Handle):
    """A handle that gives the same states again."""

    def __init__(self):
        self.states = {}

    def getListState(self, name, shape):
        return self.states.setdefault(name, Listed())

    def getValueState(self, name, shape):
        return self.states.setdefault(name, State())


def followed(rows):
    handle, out = Kept(), []
    for first, end, passed in ((0, 300, 200), (300, 450, 450)):  # a new processor each time, as in a new task: counters come from the state
        p = S._Tracker()
        p.init(handle)
        list(p.handleInputRows((1,), iter([rows[rows["at"].between(first * 1000, end * 1000 - 1)]]), None))
        out += list(p.handleExpiredTimer((1,), Clock(passed), None))
    return pd.concat(out).sort_values("task_id").reset_index(drop=True)


def test_runs_that_share_a_key_keep_their_own_counters():
    rng, n = np.random.default_rng(2), 900
    rows = pd.DataFrame({"run_id": np.arange(n) % 37, "at": rng.permutation(n) // 2 * 1000, "task_id": np.arange(n), "cached": rng.random(n) < 0.2, "closing": False})
    rows = rows.assign(chars=rng.integers(1, 99, n), audio_ms=rng.integers(1, 999, n), wall_ms=rng.integers(-5, 99, n))
    rows["total"] = rows.groupby("run_id")["chars"].transform("sum")
    alone = pd.concat([followed(own) for _, own in rows.groupby("run_id")])
    together = followed(rows)
    assert len(together) == n and together["eta_seconds"].notna().sum() > n // 3
    pd.testing.assert_frame_equal(together, alone.sort_values("task_id").reset_index(drop=True))


def test_many_short_runs_share_few_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "_ordered", lambda events, key, *_: events.select("run_id", events[key].alias("key")))
    events = spark.range(6000).selectExpr("id % 2000 AS run_id")
    keys = {(r.run_id, r.key) for r in S.tracked(events, 5).collect()}
    assert len(keys) == 2000 and len({k for _, k in keys}) == 5
    assert len({r.key for r in S.tracked(events).collect()}) <= S.GROUPS


def test_groups_grow_with_the_events(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(streams, "_delivered", lambda events, key: events)
    monkeypatch.setattr(streams, "finished", lambda stream: stream)
    monkeypatch.setattr(S, "tracked", lambda events, groups: seen.append(groups))
    for size in (streams.GROUP_EVENTS, 30):
        monkeypatch.setattr(streams, "GROUP_EVENTS", size)
        streams.stream_throughput(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert seen == [1, -(-n // 30)]


def test_halves_are_rounded_as_in_sql():
    assert [S._rounded(x, 4) for x in (2845087.80135, -2845087.80135, 0.00005, 0.00004999, 0.0, 3e300)] == [2845087.8014, -2845087.8014, 0.0001, 0.0, 0.0, 3e300]
    assert duckdb.execute("SELECT round(2845087.80135::DOUBLE, 4), round(-2845087.80135::DOUBLE, 4)").fetchone() == (2845087.8014, -2845087.8014)
