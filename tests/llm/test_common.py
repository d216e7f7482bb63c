"""Joins on hot keys, components of stars, folders."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm.graph import connected_components, node_key


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("merge", [False, True])
def test_spread_join_equals_a_plain_join(spark, monkeypatch, how, merge):
    monkeypatch.setattr(common, "SPREAD", 10)
    keys = [("hot", 1)] * 300 + [(f"k{i % 200}", i % 3) for i in range(600)] + [(None, 1), ("none", None), ("absent", 9)]
    rows = spark.createDataFrame([(i, a, b, "own") for i, (a, b) in enumerate(keys)], "id long, a string, b long, _x string")
    counts = Counter(k for k in keys if None not in k and k[0] != "absent")
    facts = spark.createDataFrame([(a, b, n, n * 2 if n > 1 else None) for (a, b), n in counts.items()] + [("unused", 0, 0, 5)], "a string, b long, n long, value long")
    got = common.join_spread(rows, facts, ["a", "b"], "n", F.col("id"), how, merge)
    want = rows.join(facts, ["a", "b"], how).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_dealt_to_all_tasks(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    facts = common.settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in common.join_spread(rows, facts, ["k"], "n", F.xxhash64("id")).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(sizes) == 8 and max(sizes) < 1.2 * 40_000 / 8


def test_components_of_stars_and_chains(spark):
    star = [(0, i) for i in range(1, 4000)]
    chain = [(i, i + 1) for i in range(10_000, 10_300)]
    edges = spark.createDataFrame(star + chain + [(7, 7), (None, 3), (0, 1)], "src long, dst long")
    found = connected_components(edges)
    names = spark.range(11_000).select("id", node_key("id").alias("node"))
    groups = {}
    for r in names.join(found, "node").collect():
        groups.setdefault(r.root, set()).add(r.id)
    assert sorted(map(len, groups.values())) == [301, 4000]


def test_a_cluster_needs_a_named_folder():
    def session(master, named=None):
        conf = {"spark.checkpoint.dir": named} if named else {}
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)

    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    local = session("local[2]")
    assert common.shared_dir(local) == common.shared_dir(local) and common.shared_dir(local).startswith("file://")
    with pytest.raises(ValueError):
        common.shared_dir(session("spark://m:7077"))


def test_fresh_names():
    assert common.fresh(["a", "_Digest", "__digest"], "_digest") == "___digest"


def test_shares_never_vanish():
    for wanted, n in ((32, 10**12), (600, 7 * 10**8), (8192, 10**13), (5000, 10**10)):
        assert abs((common.limit63(wanted, n) + 1) / 2**63 * n / wanted - 1) < 1e-6
    assert common.limit63(10, 7) == common.limit63(10, 10) == 2**63 - 1 and common.limit63(10, 0) == 2**63 - 1


def test_salted_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD", 5)
    rows = common.settle(spark.range(500).selectExpr("IF(id % 3 = 0, 7, id % 50) AS k", "id"))
    facts = spark.range(200).selectExpr("IF(id < 20, 7, id) AS k", "id AS f")
    want = sorted((r.k, r.id, r.f) for r in rows.join(facts, "k").collect())
    joined = common.join_salted(rows, facts, ["k"], F.xxhash64("id"))
    assert joined.columns == ["k", "id", "f"] and sorted((r.k, r.id, r.f) for r in joined.collect()) == want


def test_a_table_is_small_by_rows_and_by_bytes(spark, monkeypatch):
    rows = spark.range(100).selectExpr("repeat('x', 100) AS t")
    assert common.is_small(rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 9999)
    assert not common.is_small(rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 99)
    assert not common.is_small(rows)
