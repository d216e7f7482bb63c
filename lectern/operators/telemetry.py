"""Throughput, remaining time and per-worker statistics from completion events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ordered import numbered, prefix_sums
from lectern.schemas import LOG_EVERY, MAX_WORKERS, TARGET_REALTIME, TIE_RATIO, VRAM_RESERVE_GB, VRAM_WORKER_GB, WARMUP_CHUNKS

ORDER = ["ts", "task_id"]


def micros(ts: Column) -> Column:
    """Microseconds since 1970 by the clock that ``ts`` shows, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def day(ts: Column) -> Column:
    """The order bucket of events: a day of a run at a time."""
    return F.floor(micros(ts) / 86_400_000_000).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive, to six places."""
    return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)


def run_totals(events: DataFrame) -> DataFrame:
    new = ~F.col("cached")
    return events.groupBy("run_id").agg(
        F.sum("chars").alias("processed_chars"),
        F.coalesce(F.sum(F.when(new, F.col("chars"))), F.lit(0)).alias("synthesized_chars"),
        F.sum("audio_ms").alias("audio_ms"),
        F.coalesce(F.sum(F.when(new, F.greatest("wall_ms", F.lit(0)))), F.lit(0)).alias("wall_ms"),
        F.count_if("cached").alias("cache_hits"),
        F.count_if(new).alias("uncached"),
    )


def running_throughput(events: DataFrame, workers: int = 1) -> DataFrame:
    """The tracker's counters and factors after each event of a run.

    Factors leave out the first uncached event and need WARMUP_CHUNKS uncached ones.  Remaining time is 0 when
    no character is left, null while warming up.  Once nothing is left, a run too short to be measured gets
    its workers' factor, or with several workers that of the whole run.
    """
    new = (~F.col("cached")).cast("long")
    rows = events.withColumn("_now", micros(F.col("ts")))
    sums = {
        "processed": F.col("chars"), "audio": F.col("audio_ms"), "made_chars": new * F.col("chars"), "made_audio": new * F.col("audio_ms"),
        "worked": new * F.greatest("wall_ms", F.lit(0)), "hits": F.col("cached").cast("long"), "fresh": new,
    }
    rows = prefix_sums(rows, ["run_id"], day(F.col("ts")), ORDER, sums)
    runs = events.withColumn("_now", micros(F.col("ts"))).groupBy("run_id").agg(F.sum("chars").alias("total"), F.min("_now").alias("_start"), F.min(F.when(~F.col("cached"), F.struct("_now", "task_id", "audio_ms"))).alias("_first"))
    rows = rows.join(runs, "run_id")
    left, since = F.greatest(F.col("total") - F.col("processed"), F.lit(0)), F.col("_now") - F.col("_first._now")
    warm = F.col("fresh") >= WARMUP_CHUNKS
    factor = F.when(warm & (since > 0), (F.col("made_audio") - F.col("_first.audio_ms")) * 1000 / since).otherwise(F.lit(0.0))
    by_worker = F.when(F.col("worked") > 0, F.col("made_audio") / F.col("worked")).otherwise(F.lit(0.0))
    ran = F.col("_now") - F.col("_start")
    whole = F.when((F.col("made_audio") > 0) & (ran > 0), F.col("made_audio") * 1000 / ran).otherwise(F.lit(0.0))
    final = F.when((left == 0) & (factor <= 0), by_worker if workers == 1 else whole).otherwise(factor)
    eta = F.when(left == 0, F.lit(0.0)).when((final > 0) & (F.col("made_chars") > 0) & warm, left * F.col("made_audio") / F.col("made_chars") / 1000 / final)
    return rows.select(
        "run_id", "task_id", "ts", "cached", "processed", "audio", "made_audio", "worked", "hits", "fresh",
        F.round(final, 6).alias("realtime_factor"), F.round(by_worker, 6).alias("worker_factor"), F.round(whole, 6).alias("end_to_end_factor"),
        F.round(eta, 4).alias("eta_seconds"), (~warm & (left > 0)).alias("eta_warmup"),
    )


def progress_points(events: DataFrame) -> DataFrame:
    """Share done after each event, and whether the event is one that gets a log line."""
    rows = prefix_sums(events, ["run_id"], day(F.col("ts")), ORDER, {"done": F.lit(1).cast("long"), "fresh": (~F.col("cached")).cast("long")})
    rows = rows.join(events.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")), "run_id")
    log = ~F.col("cached") & ((F.col("fresh") == WARMUP_CHUNKS) | (F.col("fresh") % LOG_EVERY == 0))
    return rows.select("run_id", "task_id", "done", "total", F.rint(F.col("done") * 100 / F.col("total")).cast("long").alias("percent"), log.alias("logged"))


def worker_throughput(events: DataFrame) -> DataFrame:
    done = events.filter("not cached").groupBy("run_id", "worker").agg(F.sum("audio_ms").alias("audio_ms"), F.sum(F.greatest("wall_ms", F.lit(0))).alias("wall_ms"), F.count(F.lit(1)).alias("chunks"))
    return done.withColumn("factor", ratio(F.col("audio_ms"), F.col("wall_ms")))


def worker_range(events: DataFrame) -> DataFrame:
    return worker_throughput(events).filter("factor > 0").groupBy("run_id").agg(F.min("factor").alias("slowest"), F.max("factor").alias("fastest"))


def vram_by_worker(events: DataFrame, allocated: Column) -> DataFrame:
    """The sum, per run, of every worker's latest allocation in GB."""
    latest = events.groupBy("run_id", "worker").agg(F.max_by(allocated, F.struct(*ORDER)).alias("gb"))
    return latest.groupBy("run_id").agg(F.round(F.sum("gb"), 2).alias("allocated_gb"))


def mode_set(events: DataFrame, mode: Column) -> DataFrame:
    return events.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(mode)), "+").alias("modes"))


def latest_per_key(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "worker").agg(F.max_by(F.struct("kind", "task_id"), F.struct(*ORDER)).alias("last")).select("run_id", "worker", "last.kind", "last.task_id")


def config_factor(tasks: DataFrame, warm_up: int = 2) -> DataFrame:
    """(config, workers, factor): audio made over elapsed time, the first tasks of each worker left out.

    ``tasks`` are (config, workers, worker, task_id, started_ms, ended_ms, audio_ms).  Time runs from the first
    start to the last end of a configuration's tasks, so tasks that run side by side count once.
    """
    minute = F.coalesce(F.floor(F.col("started_ms") / 60_000).cast("long"), F.lit(-(1 << 62)))  # null times come first, as in the order
    ranked = numbered(tasks.withColumn("_of", F.struct("config", "workers", "worker")), ["_of"], minute, ["started_ms", "task_id", "ended_ms", "audio_ms"], "n").filter(F.col("n") > warm_up)
    elapsed = F.max("ended_ms") - F.min("started_ms")
    return ranked.groupBy("config", "workers").agg(ratio(F.sum("audio_ms"), elapsed).alias("factor"))


def best_workers(factors: DataFrame, target: float = TARGET_REALTIME, tie: float = TIE_RATIO) -> DataFrame:
    """Per config the fewest workers that reach the target, else the fewest within the tie band of the best; 1 if none is valid."""
    valid = (F.col("workers") > 0) & (F.col("factor") > 0)
    top = factors.groupBy("config").agg(F.max(F.when(valid, F.col("factor"))).alias("top"))
    rows = factors.join(top, "config")
    reached = F.min(F.when(valid & (F.col("factor") >= target), F.col("workers")))
    near = F.min(F.when(valid & (F.col("factor") >= F.col("top") * (1 - max(0.0, tie))), F.col("workers")))
    return rows.groupBy("config").agg(F.coalesce(reached, near, F.lit(1)).alias("workers"), reached.isNotNull().alias("target_reached"))


def take_while_below(factors: DataFrame, target: float = TARGET_REALTIME, memory: tuple[Column, Column] | None = None) -> DataFrame:
    """The configurations tried: in worker order, up to and with the first that ends the search.

    That is the first that reaches the target, or, with ``memory`` (a device's total and used GB with so many
    workers), the first that leaves no room for another worker.  Unknown sizes, null or 0, do not end it.
    """
    ends = F.col("factor") >= target
    if memory is not None:
        total, used = memory
        full = (total > 0) & (used > 0) & (F.greatest(total - used, F.lit(0.0)) < VRAM_RESERVE_GB + VRAM_WORKER_GB)
        ends = ends | F.coalesce(full, F.lit(False))
    first = factors.filter(ends).groupBy("config").agg(F.min("workers").alias("stop"))
    return factors.join(first, "config", "left").filter(F.col("stop").isNull() | (F.col("workers") <= F.col("stop"))).drop("stop")


def target_percent(factor: Column, target: float = TARGET_REALTIME) -> Column:
    return F.least(F.lit(999), F.rint(factor / target * 100).cast("long"))


def capacity(total_gb: Column, used_gb: Column) -> Column:
    """Workers that fit in a device's free memory, from 1 to the most allowed."""
    free = F.greatest(total_gb - used_gb, F.lit(0.0))
    fit = F.floor(F.greatest(free - VRAM_RESERVE_GB, F.lit(0.0)) / VRAM_WORKER_GB)
    return F.least(F.lit(MAX_WORKERS), F.greatest(F.lit(1), fit)).cast("int")


#: A device's samples are thinned in blocks of this many intervals, so that one device is many groups.
INTERVALS = 64
#: Rows of one group of blocks, about.
SAMPLES_AT_ONCE = 50_000


def _next(at: np.ndarray, block: np.ndarray, gap: int) -> np.ndarray:
    """For each sample the first of its block at least ``gap`` later; itself if there is none."""
    line = block * (2 * INTERVALS * gap) + at % (INTERVALS * gap)  # blocks too far apart to reach each other
    to = np.searchsorted(line, line + gap, "left")
    own = np.arange(len(at))
    inside = to < len(at)
    inside[inside] = block[to[inside]] == block[inside]
    return np.where(inside, to, own)


def _sorted_blocks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows by device, block, time and event; which block, from 0, each is in; where blocks begin."""
    pdf = pdf.assign(_d=pd.factorize(pdf["device"], use_na_sentinel=False)[0]).sort_values(["_d", "block", "at", "event_id"])
    new = (pdf["_d"].diff().fillna(1) != 0) | (pdf["block"].diff().fillna(1) != 0)
    return pdf, new.cumsum().to_numpy() - 1, np.flatnonzero(new)


def throttle(samples: DataFrame, seconds: float) -> DataFrame:
    """(device, event_id) of the samples at least ``seconds`` after the last kept one of their device.

    Which samples stay depends on all earlier ones, but in a block of INTERVALS intervals only through the first
    sample that it keeps, which lies in its first interval or is the first one after it.  So each block says
    for every such sample which one it keeps last; those few rows are read in order, one block leading to the
    next; then each block keeps the samples that follow from its first.  Samples without a time have no distance
    and all stay; of samples at the same time the one with the smallest id comes first.
    """
    gap = int(seconds * 1_000_000)
    timed = samples.select("device", micros(F.col("ts")).alias("at"), "event_id")
    if gap <= 0:
        return timed.select("device", "event_id")
    width = INTERVALS * gap
    placed = timed.filter("at is not null").withColumn("block", F.floor(F.col("at") / width).cast("long"))
    parts = max(1, -(-placed.count() // SAMPLES_AT_ONCE))
    part = F.pmod(F.xxhash64("device", "block"), F.lit(parts))

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, block, begins = _sorted_blocks(pdf)
        at = pdf["at"].to_numpy()
        last = _next(at, block, gap)
        while True:  # follow all chains at once
            further = last[last]
            if (further == last).all():
                break
            last = further
        early = at % width < gap
        after = np.flatnonzero(~early)
        early[after[np.unique(block[after], return_index=True)[1]]] = True
        return pdf.assign(exit=at[last])[["device", "block", "at", "event_id", "exit"]][early]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, device, block, last = False, None, None, None
        for b in batches:
            kept = []
            for i, (d, n, at, end) in enumerate(zip(*(b.column(c).to_pylist() for c in ("device", "block", "at", "exit")))):
                if not started or d != device:
                    started, device, block, last = True, d, None, None
                if n != block and (last is None or at - last >= gap):
                    block, last = n, end
                    kept.append(i)
            yield b.select(["device", "block", "event_id"]).take(pa.array(kept, pa.int64()))

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, block, _ = _sorted_blocks(pdf)
        to = _next(pdf["at"].to_numpy(), block, gap)
        kept = pdf["first"].to_numpy().astype(bool)
        new = np.flatnonzero(kept)
        while len(new):
            new = to[new][~kept[to[new]]]
            kept[new] = True
        return pdf[["device", "event_id"]][kept]

    device = timed.schema["device"].dataType.simpleString()
    event = timed.schema["event_id"].dataType.simpleString()
    few = placed.groupBy(part.alias("part")).applyInPandas(entries, f"device {device}, block long, at long, event_id {event}, exit long")
    ordered = few.repartition("device").sortWithinPartitions("device", "block", "at", "event_id")
    firsts = ordered.mapInArrow(follow, f"device {device}, block long, event_id {event}").withColumn("first", F.lit(True))
    joined = placed.join(firsts, placed["device"].eqNullSafe(firsts["device"]) & (placed["block"] == firsts["block"]) & placed["event_id"].eqNullSafe(firsts["event_id"]), "left")
    marked = joined.select(placed["device"], placed["block"], "at", placed["event_id"], F.coalesce("first", F.lit(False)).alias("first"))
    kept = marked.groupBy(part.alias("part")).applyInPandas(chains, f"device {device}, event_id {event}")
    return kept.unionByName(timed.filter("at is null").select("device", "event_id"))


def change_log(events: DataFrame, key: str = "kind") -> DataFrame:
    """The events at which ``key`` differs from the one before in their run.

    Rows are compared day by day; the first of a day is compared with the last of the day before it in the run.
    """
    rows = events.withColumn("_of", F.struct("run_id", F.coalesce(day(F.col("ts")), F.lit(-(1 << 62))).alias("day")))
    ends = rows.groupBy("_of").agg(F.max_by(F.struct(key), F.struct(*ORDER)).alias("_end"))
    ends = ends.select("_of", F.lag("_end").over(Window.partitionBy("_of.run_id").orderBy("_of.day")).alias("_earlier"))
    before = F.lag(F.struct(key)).over(Window.partitionBy("_of").orderBy(*ORDER))
    rows = rows.withColumn("_last", before).join(ends, "_of").withColumn("_before", F.coalesce("_last", "_earlier")[key])
    return rows.filter(~F.col(key).eqNullSafe(F.col("_before"))).select("run_id", "task_id", key)


def first_error_stops(events: DataFrame) -> DataFrame:
    """Every event with ``discarded``: whether it came after the first failure of its run."""
    first = events.filter("failed").groupBy("run_id").agg(F.min(F.struct(*ORDER)).alias("stop"))
    rows = events.join(first, "run_id", "left")
    return rows.select("run_id", "task_id", F.coalesce(F.struct(*ORDER) > F.col("stop"), F.lit(False)).alias("discarded"), F.col("stop").isNotNull().alias("run_failed"))

