"""Pfair mixing: the deviation bound, whole output, exhausted sources."""

import math
import random
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


@pytest.mark.parametrize("weights", [[1.0], [1.0, 1.0], [5.0, 3.0, 2.0], [0.61, 0.3, 0.05, 0.04], [100.0, 1, 1, 1, 1, 1], [0.9995, 0.0005], [1.0, 1e-5], [math.sqrt(n) for n in range(1000, 100_000, 500)], [0.5] + [0.0005] * 400])
def test_each_source_is_less_than_a_block_off_its_given_weight(weights):
    blocks = [4000] * len(weights)
    shares = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    ran = [0] * len(weights)
    for t, (s, block, release, deadline) in enumerate(mixing.schedule(blocks, mixing.whole(weights))[:4000]):
        assert block == ran[s] and release <= t < deadline
        ran[s] += 1
        if len(weights) < 10 or t % 50 == 0 or t < 100:
            assert all(abs(n - (t + 1) * f) < 1 for n, f in zip(ran, shares))


def test_shares_hold_again_after_each_source_that_runs_out():
    weights, blocks = [7, 2, 1, 0, 3], [40, 5, 900, 3, 60]
    order = mixing.schedule(blocks, weights)
    assert Counter(s for s, *_ in order) == dict(enumerate(blocks)) and [s for s, *_ in order[-3:]] == [3, 3, 3]
    start, ran, left = 0, Counter(), list(blocks)
    active = {s for s in range(5) if weights[s]}
    for t, (s, *_) in enumerate(order[:-3]):
        ran[s] += 1
        left[s] -= 1
        assert all(abs(ran[i] - Fraction((t + 1 - start) * weights[i], sum(weights[k] for k in active))) < 1 for i in active)
        if not left[s]:
            active.discard(s)
            start, ran = t + 1, Counter()


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    rows = [(i, f"s{i % 300}" if i % 3 else "hot") for i in range(6000)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000)) and sorted(r.mix_position for r in got) == list(range(6000))
    assert all(r.release <= r.slot < r.deadline for r in got)
    halves = [Counter(r.source for r in got if (r.mix_position < 2000) is first) for first in (True, False)]
    slots = {}
    for r in got:
        slots.setdefault(r.source, set()).add(r.slot)
    shared = [s for s in slots if s != "hot" and len(slots[s]) > 1]  # those scheduled alone have one block
    small = [halves[0][s] / 20 for s in shared]
    assert len(shared) == 181 and 0.2 < min(small) and max(small) < 0.9 and max(small) - min(small) < 0.3


def test_sources_without_weight_come_last(spark):
    rows = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(2000)] + [(9000, None)], "doc_id long, source string")
    got = sorted(mixing.mixed(rows, weights={"a": 1.0, "b": 0.0, "c": float("nan"), "e": 5.0}).collect(), key=lambda r: r.mix_position)
    assert {r.source for r in got[:500]} == {"a"} and len(got) == 2001 and [r.mix_position for r in got] == list(range(2001))
    for none in ({}, {"a": 0.0}):
        assert sorted(r.mix_position for r in mixing.mixed(rows, weights=none).collect()) == list(range(2001))


def test_columns_with_names_of_the_operator_stay(spark):
    names = ["s", "w", "n", "mark", "rank", "row", "rest", "name", "none", "bucket", "_s", "_mark"]
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), *(F.lit(i).alias(c) for i, c in enumerate(names)))
    got = mixing.mixed(rows).collect()
    assert len(got) == 50 and all(r[c] == i for r in got for i, c in enumerate(names))


def test_positions_are_whole_and_follow_the_slots(spark, write):
    rows = [(i, ["a", "b", None, "c", "a"][i % 5], "x") for i in range(4000)] + [(7, "b", "x")] * 5 + [(None, "c", "x")] * 3
    folder = write(spark.createDataFrame(rows, "doc_id long, source string, block string"), "documents")
    got = mixing.op7_mixing(spark, folder).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    order = sorted(got, key=lambda r: r.mix_position)
    assert [r.slot for r in order] == sorted(r.slot for r in order)
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert max(Counter((r.source, r.block) for r in got).values()) == mixing.BLOCK_ROWS


def test_given_weights_rule_the_mix_until_a_source_runs_out(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(4000)], "doc_id long, source string")
    got = sorted(mixing.mixed(rows, weights={"a": 3.0, "b": 1.0}).collect(), key=lambda r: r.mix_position)
    head = Counter(r.source for r in got[:2400])
    assert abs(head["a"] - 1800) <= mixing.BLOCK_ROWS and {r.source for r in got[2800:]} == {"b"}


def test_empty_table(spark, write):
    assert mixing.op7_mixing(spark, write(spark.createDataFrame([], "doc_id long, source string"), "documents")).collect() == []


def test_columns_without_an_order(spark):
    rows = spark.range(100).selectExpr("id AS doc_id", "'s' AS source", "map('k', id) AS more")
    got = mixing.mixed(rows).collect()
    assert sorted(r.mix_position for r in got) == list(range(100)) and all(r.more == {"k": r.doc_id} for r in got)


def plain_schedule(blocks, weights):
    """The rule of the docstring, each slot by a look at every source."""
    done, out, active = [0] * len(blocks), [], [s for s, n in enumerate(blocks) if n and weights[s]]
    while active:
        start, base, total = len(out), list(done), sum(weights[s] for s in active)
        while all(done[s] < blocks[s] for s in active):
            windows = [(-(-(done[s] - base[s] + 1) * total // weights[s]), s, (done[s] - base[s]) * total // weights[s]) for s in active]
            deadline, s, release = min(x for x in windows if x[2] <= len(out) - start)
            out.append((s, done[s], start + release, start + deadline))
            done[s] += 1
        active = [s for s in active if done[s] < blocks[s]]
    return out


def test_schedule_is_that_of_the_rule():
    draw = random.Random(7)
    for most_blocks, most_weight in ((1, 1), (1, 50), (3, 4), (30, 10), (30, 10**15)):
        for _ in range(20):
            n = draw.randint(0, 60)
            blocks, weights = [draw.randint(0, most_blocks) for _ in range(n)], [draw.randint(1, most_weight) for _ in range(n)]
            assert mixing.schedule(blocks, weights) == plain_schedule(blocks, weights)


def test_a_hundred_thousand_sources_start_anew_after_each():
    draw = random.Random(7)
    rows = [draw.randint(1, 40) for _ in range(100_000)] + [400_000]
    order = mixing.schedule([-(-n // 32) for n in rows], mixing.whole([math.sqrt(n) for n in rows]))  # a look at all sources after each would take hours
    assert Counter(s for s, *_ in order) == {s: -(-n // 32) for s, n in enumerate(rows)}


def equals_sql(folder, got):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = c.execute(f"SELECT doc_id, source, block, slot, release, deadline, mix_position FROM ({mixing.ORACLES['op7_mixing']}) ORDER BY mix_position").fetchall()
    return [tuple(r) for r in got.select("doc_id", "source", "block", "slot", "release", "deadline", "mix_position").orderBy("mix_position").collect()] == want


def test_more_sources_than_are_sent_are_each_scheduled_by_themselves(spark, write):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "é hot").otherwise(F.concat(F.lit("s"), F.col("id") % 2200)).alias("source"))
    folder = write(rows, "documents")
    got = mixing.op7_mixing(spark, folder)
    assert rows.select("source").distinct().count() > mixing.SENT_SOURCES == 1000
    assert equals_sql(folder, got)


def test_blocks_stay_as_small_where_the_schedule_is_long(spark, write, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 8)
    monkeypatch.setattr(mixing, "SLOT_BATCH", 7, raising=False)
    folder = write(spark.range(4000).select(F.when(F.col("id") % 11 > 0, F.floor(F.col("id") / 2) * 2).alias("doc_id"), (F.col("id") * F.col("id") % 7).cast("string").alias("source")), "documents")
    assert equals_sql(folder, mixing.op7_mixing(spark, folder))


def test_few_sources_start_no_python_on_executors(spark, monkeypatch):
    real, here = mixing.slots, []
    monkeypatch.setattr(mixing, "slots", lambda *of: here.append(of) or real(*of))
    rows = spark.range(300).selectExpr("id AS doc_id", "CAST(id % 3 AS STRING) AS source")
    assert mixing.mixed(rows).count() == 300 and len(here) == 1
