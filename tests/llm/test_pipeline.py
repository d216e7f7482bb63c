"""The pipeline's stages, each held against what it must keep and drop."""

from collections import Counter

import pytest

import corpus_pipeline
from lectern.llm import quality
from lectern.llm.common import settle
from tests.llm.test_decontaminate import words
from tests.llm.test_simhash import components
from tests.llm.test_simhash import fingerprint as simhash_by_hand

SF = "/root/testdata/sf0.001"


def contaminated(text, items):
    """The rule of the contract, word by word."""
    w, hit = words(text), set()
    spans = {tuple(b[i : i + min(13, len(b))]) for _, body in items if (b := words(body)) for i in range(max(1, len(b) - 12))}
    for m in {len(s) for s in spans}:
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in spans:
                hit |= set(range(i, i + m))
    return 0 < len(hit) and 20 * len(hit) >= len(w)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, SF))
        ids, old = (sorted(r.doc_id for r in x.select("doc_id").collect()) for x in (docs, before))
        assert set(ids) <= set(old)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            good = [i for i in old if labels.get(i) == 1]
            assert len(set(good) & set(ids)) > 0.95 * len(good)
        elif name == "SimHash near-dedup":
            fps = {r.doc_id: simhash_by_hand(r.text) for r in before.collect()}
            group = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
            assert ids == sorted(i for i in fps if group[i] == i)
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert ids == sorted(r.doc_id for r in before.collect() if not contaminated(r.text, items))
        else:
            assert ids == old
        assert docs.columns == (columns + ["shard", "slot"] if name == "sharding" else columns)
    assert Counter(len({(r.shard, r.slot) for r in docs.collect()}) for _ in "x") == Counter([docs.count()])


def test_weights_of_the_mix_rule_the_slots_of_the_shards(spark, write, monkeypatch):
    rows = [(i, "word " * 20, "en", "ab"[i % 2], 100) for i in range(8000)]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for weights, share in (({"a": 9.0, "b": 1.0}, 0.9), ({"a": 1.0, "b": 9.0}, 0.1)):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights)
        got = corpus_pipeline.shard(spark, corpus_pipeline.mix_sources(spark, docs, folder), folder).collect()
        assert sorted(r.doc_id for r in got) == list(range(8000))
        for shard in range(8):
            slots = sorted((r.slot, r.source) for r in got if r.shard == shard)
            assert [s for s, _ in slots] == list(range(len(slots)))
            head = [s for _, s in slots[: len(slots) // 2]]
            assert abs(head.count("a") / len(head) - share) < 0.05


def test_clashing_columns(spark, write):
    names = ["shard", "slot", "block", "bucket", "digest", "_digest", "fp", "root", "score", "_q_score", "count", "mix_position", "mix_mix_position", "size", "_size", "_s", "_mark", "row", "record", "id", "_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for n in names:
        docs = docs.withColumn(n, docs.doc_id)
    folder = write(docs, "documents")
    write(spark.read.parquet(f"{SF}/labels.parquet"), "labels")
    write(spark.read.parquet(f"{SF}/benchmark.parquet"), "benchmark")
    got = corpus_pipeline.run(spark, folder)
    assert set(got.columns) == set(docs.columns)
    rows = got.collect()
    assert rows and all(r[n] == r.doc_id for r in rows for n in names if n not in ("shard", "slot"))


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)] * 2 + [(2, "", "en", "a", 0), (None, "text of some words", None, None, None)]])
def test_awkward_documents(spark, write, rows):
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "documents")
    write(spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    write(spark.createDataFrame([(1, None)], "item_id long, text string"), "benchmark")
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == ({1, None} if rows else set())
    assert quality.ACCEPT <= 1
