"""Sharding: whole and gapless shards, the growth law, shuffled buckets."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.llm import sharding
from lectern.llm.common import settle


def test_query_keeps_its_laws(spark, write):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7) + "x" * (i % 90), "slot") for i in range(3000)] + [(5, "again", "s")] * 3 + [(None, "no id", "s")]
    got = sharding.op10_sharding(spark, write(spark.createDataFrame(rows, "doc_id long, text string, shard string"), "documents")).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shard_of[r.doc_id].add(r.shard)
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 8)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    moved = sum(r.grown_shard == 8 for r in got) / len(got)
    assert 0.08 < moved < 0.14 and max(map(len, slots.values())) < 1.25 * min(map(len, slots.values()))


def test_whole_documents_move_and_the_query_reads_them_in_their_shards(spark, write, monkeypatch):
    rows = [(i, f"text {i}" if i % 9 else None, "en", i % 4, {"k": i}) for i in range(500)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, size long, more map<string,int>"), "documents")
    moved, real = [], sharding.sharded

    def sharded(*args, **kw):
        moved.append(real(*args, **kw))
        return moved[-1].withColumn("text", F.concat(F.lit("moved "), "text"))

    monkeypatch.setattr(sharding, "sharded", sharded)
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.op10_sharding(spark, folder).collect()}
    texts = {i: ("moved " + t if t else "").encode() for i, t, *_ in rows}
    assert got == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert Counter((r.doc_id, r.text, r.lang, r["size"], tuple(r.more.items())) for r in moved[0].collect()) == Counter((i, t, g, n, tuple(m.items())) for i, t, g, n, m in rows)


def expected(rows, shards, buckets, seed=sharding.SEED):
    """Shard and slot of (doc_id, size, text_crc32) rows, one bucket at a time, by the laws of the docstring."""
    spark_hash = lambda values: [r[0] for r in values.collect()]
    spark = rows.sparkSession
    listed = sorted(tuple(r) for r in rows.collect())
    frame = spark.createDataFrame(listed, rows.schema)
    scores = [spark_hash(frame.select(F.xxhash64("doc_id", F.lit(seed), F.lit(s)))) for s in range(shards)]
    spread = spark_hash(frame.select(F.pmod(F.xxhash64(F.xxhash64(*rows.columns), F.lit(0).cast("long"), F.lit(seed), F.lit("bucket")), F.lit(buckets))))
    members = defaultdict(list)
    for i, row in enumerate(listed):
        members[max(range(shards), key=lambda s: (scores[s][i], -s)), spread[i]].append(row)
    out, at = [], Counter()
    for shard, bucket in sorted(members):
        a = sorted(members[shard, bucket])
        draws = spark_hash(spark.createDataFrame([(shard, bucket, i) for i in range(len(a))], "shard int, bucket int, i int").select(F.xxhash64(F.lit(seed), "shard", "bucket", "i")))
        for i in range(len(a) - 1, 0, -1):
            j = draws[i] % (i + 1)
            a[i], a[j] = a[j], a[i]
        out += [(*row, shard, at[shard] + n) for n, row in enumerate(a)]
        at[shard] += len(a)
    return out


def test_shards_and_slots_equal_a_shuffle_of_each_bucket(spark):
    rows = settle(spark.range(1500).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("size"), F.crc32(F.col("id").cast("string")).alias("text_crc32")))
    total = rows.agg(F.sum(F.col("size") + sharding.RECORD_BYTES)).first()[0]
    want = sorted(expected(rows, 3, -(-total // (3 * 20_000))))
    for parts in (1, 7):
        got = sharding.sharded(settle(rows.repartition(parts)), "doc_id", "size", shards=3, bucket_bytes=20_000)
        assert sorted(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == want


def test_copies_of_one_row_fill_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    rows = settle(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(10).cast("long").alias("size")))
    got = sharding.sharded(rows, "doc_id", "size", shards=2).collect()
    shard = next(r.shard for r in got if r.doc_id == 7)
    slots = sorted(r.slot for r in got if r.shard == shard and r.doc_id == 7)
    assert len(got) == 3000 and len(slots) == 1001 and slots[-1] - slots[0] > 1200
    assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_very_long_texts(spark, write):
    rows = [(i, "long word " * 200_000 if i < 2 else "x" * i) for i in range(60)]
    got = sharding.op10_sharding(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}


def test_many_buckets_are_each_shuffled(spark):
    rows = settle(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("size"), F.repeat(F.lit("t"), 5).alias("text")))
    got = sharding.sharded(rows, "doc_id", "size", shards=2, bucket_bytes=20_000).collect()
    for s in (0, 1):
        order = [r.doc_id for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        rises = sum(a < b for a, b in zip(order, order[1:]))
        assert 0.4 < rises / len(order) < 0.6
        assert [r.slot for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)] == list(range(len(order)))


def test_empty_table(spark, write):
    assert sharding.op10_sharding(spark, write(spark.createDataFrame([], "doc_id long, text string"), "documents")).collect() == []


def test_columns_without_an_order(spark):
    rows = settle(spark.range(300).selectExpr("id AS doc_id", "10L AS size", "map('k', id) AS more", "array(map(1, 2)) AS deep"))
    for order in (None, "doc_id"):
        got = sharding.sharded(rows, "doc_id", "size", order=order)
        assert got.columns == ["doc_id", "size", "more", "deep", "shard", "slot"]
        assert sorted((r.doc_id, r.more, r.deep) for r in got.collect()) == [(i, {"k": i}, [{1: 2}]) for i in range(300)]
