"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in a random order fixed by their ids, form blocks of ``BLOCK_ROWS``.  Weights are taken as the
exact numbers that they are.  With weight w of W in all, a
source's j-th block (from 0) may not run before slot floor(j * W / w) and must run by slot ceil((j + 1) * W / w); in
every slot the released block with the earliest deadline runs, ties by source.  So at any point a source is less
than one block off its share.  When a source runs out, the others start anew with their shares of each other, so
the same holds from there on.  The schedule has one slot for each block; every row finds its block's slot in it
by a join, and its place by arithmetic.  No row is dropped or repeated.

A slot depends on all before it, so one task works out the schedule, from three numbers a source, and writes it as a table
as it goes; neither the number of sources nor that of blocks is bounded.  The driver does it where at most
``SENT_SOURCES`` sources have at most ``SLOTS`` blocks, so no executor runs Python for it.

Where ``MAX_SOURCES`` is set, only so many sources, those with the largest weights, are scheduled by themselves.  The others are
scheduled as one source that has the sum of their weights; inside it rows go by their turn, (rank + 1) / weight, in
steps of about 1 %, at random inside a step.  Sources with the weight zero, none or no number come after all others, mixed by
their sizes.  Weights default to the square root of the source's rows.  A null source is a source of its own.
Repeated rows take places next to each other in their source; rows without an id come after
the others of their source, in an order fixed by their other columns.  No row gives no row.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import comparable, join_spread, settle, table
from lectern.operators.ordered import numbered

BLOCK_ROWS = 32
#: Slots of a schedule that is sent to every task, and may be worked out on the driver; rows are dealt out to meet a longer one.
SLOTS = 1 << 19
#: Sources whose facts are sent to every task; more are joined.
SENT_SOURCES = 1000
#: Sources scheduled by themselves; None for all.
MAX_SOURCES: int | None = None
#: Places in the order of sources of those that share a schedule, and of those without a weight: after all others.
SHARED, IDLE = 1 << 62, (1 << 62) + 1
#: Slots that the task which works out the schedule hands over at a time.
SLOT_BATCH = 1 << 16
#: Rows that one task numbers at a time, at least, and the number of such buckets that is aimed at.
BUCKET_ROWS, BUCKETS = 256, 100_000
#: Steps of a turn to the double of it.
STEPS = 64

MADE = ("block", "slot", "release", "deadline", "mix_position")


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in the exact ratios of ``weights``."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(f.denominator for f in exact)) if exact else 1
    return [int(f * scale) for f in exact]


def slots(blocks: list[int], weights: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, release, deadline) of each slot: earliest deadline first among released blocks.

    Sources without a weight come when no other is left, one block of each in turn.  A source whose turn has not come since the last
    one ran out waits in a tree over all sources by weight, so a start anew costs only those that have run since.
    """
    none, t, done = len(blocks), 0, [0] * len(blocks)
    heavy = sorted((s for s, n in enumerate(blocks) if n > 0 and weights[s] > 0), key=lambda s: (-weights[s], s))
    rising, total = [-weights[s] for s in heavy], sum(weights[s] for s in heavy)
    place, leaves = {s: i for i, s in enumerate(heavy)}, 1 << (len(heavy) - 1).bit_length() if heavy else 1
    least = [none] * leaves + heavy + [none] * (leaves - len(heavy))  # the first source below each node
    for i in range(leaves - 1, 0, -1):
        least[i] = min(least[2 * i], least[2 * i + 1])

    def put(i: int, s: int) -> None:
        i += leaves
        least[i] = s
        while i > 1:
            i //= 2
            least[i] = min(least[2 * i], least[2 * i + 1])

    def soonest() -> tuple[int, int] | None:
        """The earliest (deadline, source) of those that wait in the tree: the deadline of the heaviest, and the first source that has it."""
        if least[1] == none:
            return None
        i, found = 1, none
        while i < leaves:
            i = 2 * i if least[2 * i] != none else 2 * i + 1
        deadline = -(total // rising[i - leaves])
        low, high = leaves, leaves + bisect_right(rising, -total // deadline)
        while low < high:
            if high & 1:
                high -= 1
                found = min(found, least[high])
            if low & 1:
                found = min(found, least[low])
                low += 1
            low, high = low // 2, high // 2
        return deadline, found

    while total:
        start, ran, waiting, ready, first = t, {}, [], [], soonest()
        while True:
            while waiting and waiting[0][0] <= t - start:
                release, s = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(ran[s] + 1) * total // weights[s]), s, release))
            if first and (not ready or first < ready[0][:2]):
                (deadline, s), release = first, 0
                put(place[s], none)
                first = soonest()
            else:
                deadline, s, release = heapq.heappop(ready)
            yield s, done[s], start + release, start + deadline
            t += 1
            done[s] += 1
            ran[s] = ran.get(s, 0) + 1
            if done[s] == blocks[s]:
                break
            heapq.heappush(waiting, (ran[s] * total // weights[s], s))
        total -= weights[s]
        for other in ran:
            if other != s:
                put(place[other], other)
    idle = [s for s, n in enumerate(blocks) if done[s] < n]
    for block in range(max((blocks[s] for s in idle), default=0)):
        for s in idle:
            if block < blocks[s]:
                yield s, block, t, t + 1
                t += 1


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int, int, int]]:
    """All ``slots``."""
    return list(slots(blocks, weights))


_TURN = pa.schema([(c, pa.int64()) for c in ("s", "block", "slot", "release", "deadline", "start")])


def _turns(groups: DataFrame, block_rows: int, here: bool) -> DataFrame:
    """The slots of the schedule of ``groups`` (s, n, weight), by s, and the place of each one's first row; worked out ``here`` or by a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("s", "n", "weight")))]
        out, start = [], 0
        for slot, (i, block, release, deadline) in enumerate(slots([-(-n // block_rows) for _, n, _ in given], whole([w for *_, w in given]))):
            out.append((given[i][0], block, slot, release, deadline, start))
            start += min(block_rows, given[i][1] - block * block_rows)
            if len(out) == SLOT_BATCH:
                yield pa.record_batch(list(zip(*out)), schema=_TURN)
                out = []
        if out:
            yield pa.record_batch(list(zip(*out)), schema=_TURN)

    if here:
        return groups.sparkSession.createDataFrame(pa.Table.from_batches(run(groups.orderBy("s").toArrow().to_batches()), _TURN))
    return settle(groups.repartition(1).sortWithinPartitions("s").mapInArrow(run, ", ".join(f"{c} long" for c in _TURN.names)), "mix-turns")


def _shares(mark: Column, parts: Column) -> Column:
    """Which of ``parts`` equal ranges of marks, from 0, a mark is in."""
    return F.floor(F.conv(F.substring(mark, 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("long")


def mixed(rows: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, block_rows: int = BLOCK_ROWS, prefix: str = "") -> DataFrame:
    """Every row of ``rows`` with its ``block``, ``slot``, ``release``, ``deadline`` and ``mix_position`` from 0.

    ``prefix`` goes before these names, for rows that have columns of the same names.
    """
    spark = rows.sparkSession
    name = F.col(source).cast("string")
    placed = rows.select(F.struct(*rows.columns).alias("row"), F.coalesce(name, F.lit("")).alias("name"), name.isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(*comparable(rows)).alias("rest"))
    known = placed.groupBy("name", "none").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        known = known.withColumn("weight", F.sqrt("n"))
    else:
        given = {k: float(w) for k, w in weights.items() if w is not None and math.isfinite(w) and w > 0}
        told = spark.createDataFrame([(k or "", k is None, w) for k, w in given.items()], "name string, none boolean, weight double")
        known = known.join(told, ["name", "none"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    known = settle(known, "mix-sources")

    own = known.filter("weight > 0")
    if MAX_SOURCES is not None:
        own = own.orderBy(F.desc("weight"), F.desc("none"), "name").limit(MAX_SOURCES)
    own = settle(own.orderBy(F.desc("none"), "name").select("name", "none", F.monotonically_increasing_id().alias("s")), "mix-own")
    found = known.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows"), F.sum(F.ceil(F.col("n") / block_rows)).alias("blocks")).first()
    full = max(BUCKET_ROWS, (found.rows or 0) // BUCKETS)
    has_weight = F.col("weight") > 0
    known = known.join(own, ["name", "none"], "left").withColumn("s", F.coalesce("s", F.when(has_weight, F.lit(SHARED)).otherwise(F.lit(IDLE))))
    known = settle(known.select("name", "none", "n", "weight", F.when(has_weight, F.col("weight")).otherwise(F.col("n")).alias("w"), "s", F.ceil(F.col("n") / full).alias("parts")), "mix-known")
    rest = not known.filter(F.col("s") >= SHARED).isEmpty()
    few = found.sources <= SENT_SOURCES and (found.blocks or 0) <= SLOTS
    turns = _turns(known.groupBy("s").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")), block_rows, few)
    if (found.blocks or 0) <= SLOTS:
        turns = F.broadcast(turns)

    known = known.drop("weight")
    mark = F.coalesce(F.md5(F.col("key").cast("string").cast("binary")), F.md5(F.concat(F.lit("none "), F.col("rest")).cast("binary")))
    if found.sources > SENT_SOURCES:
        placed = join_spread(placed.withColumn("mark", mark), known, ["name", "none"], "n", F.col("rest"), "inner")
    else:
        placed = placed.withColumn("mark", mark).join(F.broadcast(known), ["name", "none"])
    placed = placed.withColumn("bucket", _shares(F.col("mark"), F.col("parts")) + F.when(F.col("key").isNull(), F.col("parts")).otherwise(0))
    sizes = placed.groupBy("name", "none", "bucket").agg(F.count(F.lit(1)).alias("size"))
    ahead = Window.partitionBy("name", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "none", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0).cast("long")).alias("before"))
    inside = Window.partitionBy("name", "none", "bucket").orderBy("mark", "key", "rest")
    placed = placed.withColumn("own", F.row_number().over(inside)).join(sizes, ["name", "none", "bucket"])
    placed = placed.select("row", "s", "w", "mark", "key", "rest", (F.col("before") + F.col("own") - 1).alias("rank"))
    if rest:
        placed = _in_turn(placed, full)
    placed = placed.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long")).join(turns, ["s", "block"])
    placed = placed.withColumn("mix_position", F.col("start") + F.col("rank") % block_rows)
    return placed.select(*(F.col("row")[c].alias(c) for c in rows.columns), *(F.col(m).alias(prefix + m) for m in MADE))


def _in_turn(placed: DataFrame, full: int) -> DataFrame:
    """``placed`` with new ranks for the rows of sources that share a schedule: by turn, then at random."""
    several = F.col("s") >= SHARED
    step = F.floor(F.log2((F.col("rank") + 1) / F.col("w")) * STEPS).cast("int")
    shared = settle(placed.filter(several).withColumn("step", step), "mix-shared")
    sizes = shared.groupBy("s", "step").agg(F.ceil(F.count(F.lit(1)) / full).alias("cells"))  # at most STEPS for each power of two
    shared = shared.join(F.broadcast(sizes), ["s", "step"])
    shared = numbered(shared, ["s"], F.struct("step", _shares(F.col("mark"), F.col("cells"))), ["step", "mark", "key", "rest"], "place")
    shared = shared.select("row", "s", "w", "mark", "key", "rest", (F.col("place") - 1).alias("rank"))
    return placed.filter(~several).unionByName(shared)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


QUERIES = {"op7_mixing": op7_mixing}

ORACLES = {
    "op7_mixing": f"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
q AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS s, CAST((n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS} AS HUGEINT) AS blocks, CAST(sqrt(n) * 4503599627370496 AS HUGEINT) AS w FROM c),
l AS (SELECT list(blocks ORDER BY s) AS blocks, list(w ORDER BY s) AS w, CAST(sum(blocks) AS BIGINT) AS slots FROM q),
edf(t, t0, done, base, pick, block, release, deadline) AS (
  SELECT CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), list_transform(blocks, lambda x: CAST(0 AS HUGEINT)), list_transform(blocks, lambda x: CAST(0 AS HUGEINT)),
    CAST(NULL AS HUGEINT), CAST(NULL AS HUGEINT), CAST(NULL AS HUGEINT), CAST(NULL AS HUGEINT) FROM l
  UNION ALL
  SELECT t + 1, CASE WHEN last THEN t + 1 ELSE t0 END, after, CASE WHEN last THEN after ELSE base END, i, done[i], t0 + p.r, t0 + p.d
  FROM (SELECT *, list_transform(range(1, len(done) + 1), lambda k: done[k] + CAST(k = i AS HUGEINT)) AS after, done[i] + 1 = blocks[i] AS last
    FROM (SELECT *, CAST(p.i AS BIGINT) AS i
      FROM (SELECT *, list_min(list_filter(list_transform(list_filter(range(1, len(done) + 1), lambda k: done[k] < blocks[k]),
          lambda k: {{'d': ((done[k] - base[k] + 1) * whole + w[k] - 1) // w[k], 'i': CAST(k AS HUGEINT), 'r': (done[k] - base[k]) * whole // w[k]}}), lambda x: x.r <= t - t0)) AS p
        FROM (SELECT edf.*, l.blocks, l.w, CAST(list_sum(list_transform(list_filter(range(1, len(done) + 1), lambda k: done[k] < blocks[k]), lambda k: w[k])) AS HUGEINT) AS whole FROM edf, l WHERE t < slots))))),
turn AS (SELECT CAST(pick AS BIGINT) AS s, CAST(block AS BIGINT) AS block, CAST(t - 1 AS BIGINT) AS slot, CAST(release AS BIGINT) AS release, CAST(deadline AS BIGINT) AS deadline FROM edf WHERE pick IS NOT NULL),
d AS (
  SELECT doc_id, d.source, s, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank
  FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, turn.block, slot, release, deadline, row_number() OVER (ORDER BY slot, rank) - 1 AS mix_position
FROM d JOIN turn ON turn.s = d.s AND turn.block = d.rank // {BLOCK_ROWS}
"""
}
