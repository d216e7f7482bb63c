"""Learned operators: held-out accuracy, and awkward rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    found = langid.op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r.n > 200 and r.right > 0.95
    assert found.filter("score < 0 or score > 1").isEmpty() and found.select("lang_pred").distinct().count() == 4


def gram_vector(text, idf):
    """The TF-IDF vector of a text, n-gram by n-gram."""
    data, out = bytearray(), [0] * langid.BUCKETS
    for b in text.encode():
        data.append(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32)
    for i in range(1, len(data)):
        if data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E:
            data[i] += 0x20
    for i in range(len(data) - 1):
        out[((1 << 24 | data[i] << 8 | data[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
        if i + 2 < len(data):
            out[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    v = np.array([math.sqrt(c) for c in out]) * idf
    return v / max(np.linalg.norm(v), 1e-9)


def test_language_equals_brute_force(spark, write):
    rnd = random.Random(7)
    words = {"en": "the and of cat dog house river É good", "de": "der und die das Hund Katze Haus Fluß gut", "fi": "ja on ei se että talo joki hyvä"}
    rows = [(i, " ".join(rnd.choices(words[k].split(), k=rnd.randint(3, 30))), k) for i, k in enumerate(rnd.choices(list(words), k=160))]
    train = [(t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    ones = np.ones(langid.BUCKETS)
    df = sum((gram_vector(t, ones) > 0).astype(float) for t, _ in train)
    idf = np.log((len(train) + 1) / (df + 1))
    centres, names = [], []
    for k in sorted(words):
        x = np.array([gram_vector(t, idf) for t, lang in train if lang == k])
        x = x[np.lexsort(x.T[:8])]
        c = [x.mean(axis=0)]  # mutually distant first centres, then spherical k-means
        while len(c) < langid.CENTROIDS:
            c.append(x[min(range(len(x)), key=lambda i: max(float(x[i] @ y) for y in c))])
        for _ in range(12):
            near = [max(range(len(c)), key=lambda j: float(v @ c[j])) for v in x]
            c = [sum(v for v, n in zip(x, near) if n == j) if j in near else c[j] for j in range(len(c))]
            c = [v / max(np.linalg.norm(v), 1e-9) for v in c]
        centres += c
        names += [k] * len(c)
    got = {r.doc_id: r for r in langid.op1_langid(spark, write(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "documents")).collect()}
    for i, t, _ in rows:
        cosines = [float(gram_vector(t, idf) @ c) for c in centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert abs(got[i].score - min(1, cosines[best])) < 1e-3
        assert got[i].lang_pred == names[best] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-3


def test_texts_far_from_all_centroids_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs.select("lang", "text", F.col("doc_id").alias("pick")))
    odd = spark.createDataFrame([(-1, "zzxq wvvk qqxz jjkw xxvq " * 20), (-2, "日本語のテキストです。" * 20), (-3, None)], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(odd, model, ("doc_id",)).collect())
    known = langid.predict(docs.filter(F.col("lang").isNotNull() & (F.length("text") > 200)), model, ("doc_id",))
    assert known.agg(F.avg(F.col("rejected").cast("int")).alias("share")).first().share < 0.03


def test_language_of_awkward_rows(spark, write):
    rows = [(i, "the cat and the dog " * 3, "en", "x") for i in range(40)] + [(100 + i, "der Hund und die Katze " * 3, "de", "x") for i in range(40)]
    rows += [(200, None, "en", None), (201, "", None, None), (202, "12 !? 34", "de", None), (203, "UND DIE KATZE", None, None), (None, "the dog", "en", None), (7, "the cat and the dog", "en", "x"), (204, "the dog " * 20_000, None, None)]
    got = {}
    for r in langid.op1_langid(spark, write(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), "documents")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[7]) == 2 and not got[None][0].held_out
    assert [got[i][0].lang_pred for i in (200, 201, 202, 203, 204)] == ["und", "und", "und", "de", "en"] and got[202][0].score == 0
    for empty in ([], [(1, "some words", None, "x")]):
        folder = write(spark.createDataFrame(empty, "doc_id long, text string, lang string, score string"), "documents")
        assert [r.lang_pred for r in langid.op1_langid(spark, folder).collect()] == ["und"] * len(empty)


def test_quality_views_equal_brute_force():
    texts = [None, "", "Plain words, here. And and again!", "x 1 22 %% a\tb\n", "é 日本 a a a", "Q" * 3000]
    got = quality.content_view(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        data = bytes(32 if 9 <= b <= 13 else 48 if 48 <= b <= 57 else b for b in (text or "").encode())
        counts = [0] * quality.BUCKETS
        for i in range(len(data) - 1):
            counts[((1 << 24 | data[i] << 8 | data[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 22] += 1
            if i + 2 < len(data):
                counts[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 22] += 1
        v = np.sqrt(counts)
        words = [w for w in data.split(b" ") if w]
        marked = [w for w in words if w[-1] < 128 and not chr(w[-1]).isalpha() and w[-1] != 48]
        shapes = [sum(a == b for a, b in zip(words, words[1:])), sum(len(w) == 1 for w in words), len(marked)]
        want = np.concatenate([v / max(np.linalg.norm(v), 1e-9), np.array(shapes) / max(len(words), 1)])
        assert np.abs(row - want).max() < 1e-5
    meta = quality.metadata_view(["web", None], [None, "de"], np.array([100, 0]), np.array([4, 1]))
    assert meta[0, zlib.crc32(b"web") % quality.SOURCES] == 1 and meta[1, quality.SOURCES + zlib.crc32(b"de") % quality.LANGS] == 1
    assert np.allclose(meta[:, -3:], [[math.log(101) / 10, math.log(5) / 5, math.log(26) / 10], [0, math.log(2) / 5, 0]])


def test_logistic_regression_is_at_its_optimum():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    y = (x[:, 0] - x[:, 1] + rng.standard_normal(400) > 0).astype(float)
    w = quality.logistic(x, y)
    p = 1 / (1 + np.exp(-quality.margin(x, w)))
    assert np.abs(x.T @ (p - y) + w[:-1]).max() < 0.05 and abs((p - y).sum()) < 0.05


def test_views_teach_each_other_and_scores_are_calibrated(monkeypatch):
    rng = np.random.default_rng(3)
    n, labelled = 4000, 80
    truth = rng.random(n) < 0.5
    views = tuple((np.where(truth, 1, -1)[:, None] * 0.45 + rng.standard_normal((n, 12))).astype(np.float32) for _ in range(2))
    rest = slice(labelled, None)
    known = truth[:labelled].astype(float), tuple(v[:labelled] for v in views)

    def ask(weights, turn):
        told = [{}, {}]
        for i in (0, 1):
            p = 1 / (1 + np.exp(-quality.margin(views[i][rest], weights[i])))
            for kind, sure in ((1.0, p >= quality.SURE), (0.0, 1 - p >= quality.SURE)):
                for m in rng.permutation(np.flatnonzero(sure))[: quality.PASSED_ON]:
                    told[1 - i][int(m)] = (kind, views[1 - i][rest][m])
        return told

    right = lambda model: [float(((s[rest] > 0.5) == truth[rest]).mean()) for s in quality._score(model, views)]
    taught = quality.cotrain(*known, ask)
    monkeypatch.setattr(quality, "ROUNDS", 0)
    alone = quality.cotrain(*known, ask)
    assert right(taught)[0] > right(alone)[0] and right(taught)[1] > right(alone)[1]
    assert right(taught)[2] > max(right(taught)[:2])  # the views together beat each one
    score = quality._score(taught, views)[2][rest]
    for lo, hi in ((0, 0.2), (0.2, 0.8), (0.8, 1)):
        band = (score >= lo) & (score < hi)
        if band.sum() > 200:
            assert abs(truth[rest][band].mean() - score[band].mean()) < 0.15


def test_quality_query_equals_the_model_fitted_on_all_rows_here(spark, write):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    folder = write(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), "documents")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    write(labels, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    bodies = [r.text or "" for r in docs]
    views = (quality.content_view(pa.array(bodies, pa.string())), quality.metadata_view([r.source for r in docs], [r.lang for r in docs], np.array([len(b) for b in bodies]), np.array([b.count("\n") + 1 for b in bodies])))
    fold = {r[0]: r[1] for r in spark.createDataFrame([(r.doc_id,) for r in docs], "i long").select("i", F.pmod(F.xxhash64("i", F.lit("fold")), F.lit(1_000_000))).collect()}
    order = sorted((i for i in range(len(docs)) if docs[i].doc_id in known), key=lambda i: (fold[docs[i].doc_id], known[docs[i].doc_id], views[0][i].tobytes()))
    pool = [i for i in range(len(docs)) if docs[i].doc_id not in known]
    marks = dict(spark.createDataFrame([(docs[i].doc_id, docs[i].text or "", docs[i].source, docs[i].lang) for i in pool], "i long, t string, s string, l string").select("i", F.xxhash64("i", "t", "s", "l")).collect())

    def ask(weights, turn):  # all that a view is sure of: there are fewer than PASSED_ON here
        told = [{}, {}]
        for i in (0, 1):
            p = 1 / (1 + np.exp(-quality.margin(views[i], weights[i])))
            for d in pool:
                if not 1 - quality.SURE < p[d] < quality.SURE:
                    told[1 - i][marks[docs[d].doc_id]] = (float(p[d] > 0.5), views[1 - i][d])
        assert all(sum(kind == k for kind, _ in t.values()) < quality.PASSED_ON for t in told for k in (0, 1))
        return told

    want = quality._score(quality.cotrain(np.array([known[docs[i].doc_id] for i in order], float), tuple(v[order] for v in views), ask), views)
    got = {r.doc_id: r for r in quality.op3_quality(spark, folder).collect()}
    for i, r in enumerate(docs):
        assert np.allclose([got[r.doc_id].p_content, got[r.doc_id].p_metadata, got[r.doc_id].score], [w[i] for w in want], atol=1e-3)
        assert got[r.doc_id].accepted == (got[r.doc_id].score >= quality.ACCEPT)


def test_pseudo_labels_come_from_a_bounded_share_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "PASSED_ON", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).select(F.col("doc_id").alias("_q_id"), *quality._inputs(docs, "text"))
    rows = docs.withColumn("_q_mark", F.xxhash64("_q_id", "_q_text", "_q_source", "_q_lang"))
    weights = [np.zeros(w + 1) for w in (quality.BUCKETS + quality.SHAPES, quality.SOURCES + quality.LANGS + 3)]
    assert quality.confident(rows, weights, 0) == [{}, {}]  # sure of none
    weights[0][-1], weights[1][-1] = 9, -9  # sure of all
    marks = {r._q_mark for r in rows.select("_q_mark").collect()}
    seen = []
    for turn in (0, 1):
        by_meta, by_content = quality.confident(rows, weights, turn)
        for told, kind, width in ((by_meta, 0.0, len(weights[0]) - 1), (by_content, 1.0, len(weights[1]) - 1)):
            assert 15 <= len(told) <= 75 and set(told) <= marks
            assert all(k == kind and v.shape == (width,) for k, v in told.values())
        seen.append(set(by_content))
        again = quality.confident(rows, weights, turn, [10**12] * 4)  # far fewer than expected: read once more
        assert [{m: k for m, (k, _) in told.items()} for told in again] == [{m: k for m, (k, _) in told.items()} for told in (by_meta, by_content)]
        assert all((again[1][m][1] == by_content[m][1]).all() for m in by_content)
    assert len(seen[0] & seen[1]) < 20  # each round draws anew


def test_quality_on_labels_not_used_for_fitting(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, labels.filter(fold == 0))
    r = quality.scored(docs, model, ["doc_id"]).select("row.*", "score").join(labels.filter(fold == 1), "doc_id").withColumn("ok", F.col("score") >= quality.ACCEPT)
    good, bad = (r.filter(f"quality = {q}").agg(F.avg(F.col("ok").cast("int")).alias("kept")).first().kept for q in (1, 0))
    assert good > 0.97 and bad < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)]])
def test_quality_of_awkward_rows(spark, write, labels):
    rows = [(1, "Good plain words here.", "en", "a"), (2, "x### y$$$ z%%%", None, None), (3, None, "en", "a"), (None, "", None, "b"), (3, None, "en", "a"), (4, "a " * 60_000, "en", "a")]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "documents")
    write(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "labels")
    got = quality.op3_quality(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    if len(labels) < 3:
        assert all(r.accepted and r.score == 1 for r in got)
    write(spark.createDataFrame([], "doc_id long, text string, lang string, source string"), "documents")
    assert quality.op3_quality(spark, folder).collect() == []
