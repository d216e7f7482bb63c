"""Decontamination against a brute-force reading of the contract."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import bytetext, common, decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        b = words(body)
        m = min(13, len(b))
        if item is None or not m:
            continue
        for window in {tuple(b[i : i + m]) for i in range(len(b) - m + 1)}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) == window:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


def test_query_equals_brute_force(spark, write):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "42", "日本"]
    draw = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rnd.choice([1, 3, 5, 12, 13, 14, 40])))) for i in range(12)] + [(11, "repeated item body " * 6), (99, None), (98, ""), (None, "w1"), (12, "lone")]
    docs = [None, "", "?!", "w1"]
    for _ in range(150):
        body = draw(rnd.choice([5, 30, 400]))
        for _ in range(rnd.randint(0, 2)):
            b = words(rnd.choice(items)[1])
            at, cut = rnd.randrange(len(body)), rnd.randint(0, 6)
            body[at:at] = b[cut:] if rnd.random() < 0.5 else b
        docs.append(rnd.choice([" ", ", ", "\n"]).join(body).upper())
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(4, docs[4], "x"), (5, docs[7], "x")]
    folder = write(spark.createDataFrame(rows, "doc_id long, text string, digest string"), "documents")
    write(spark.createDataFrame(items, "item_id long, text string"), "benchmark")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op4_decontaminate(spark, folder).collect())
    assert got == sorted((i, *expected(t, items)) for i, t, _ in rows)
    assert sum(r[-1] for r in got) > 20


@pytest.mark.parametrize("n", [12, 13, 14, 40, 700])
def test_selected_grams_are_those_smallest_in_a_window(n):
    rng = np.random.default_rng(n)
    hashes = rng.integers(0, 9 if n == 40 else 1 << 62, 3 * n).astype(np.uint64)
    text = np.repeat([0, 1, 2], [n, n // 3, 2 * n - n // 3])
    at, grams = decontaminate.selected(hashes, text)
    every = bytetext.gram_hashes(hashes, decontaminate.GRAM)
    want = set()
    for i in range(3 * n - 12):
        if text[i] == text[i + 12]:
            least = min(every[i : i + 9])
            want |= {j for j in range(i, i + 9) if every[j] == least}
    assert at.tolist() == sorted(want) and (grams == every[at]).all()


def test_every_shared_span_is_found_in_long_texts_and_common_passages(spark, write):
    rnd = random.Random(8)
    draw = lambda n: [f"t{rnd.randrange(5000)}" for _ in range(n)]
    passage = draw(30)
    items = [(i, " ".join(draw(10) + passage + draw(10))) for i in range(30)] + [(50 + i, " ".join(draw(60))) for i in range(30)]
    rows = []
    for i in range(90):
        body = draw(30_000 if i < 2 else 40)
        if i % 3 == 0:
            body[7:7] = passage
        for _ in range(20 if i < 2 else 1):
            w = words(items[30 + rnd.randrange(30)][1])
            cut, at = rnd.randrange(40), rnd.randrange(len(body))
            body[at:at] = w[cut : cut + rnd.choice([12, 13, 14, 25])]
        rows.append((i, " ".join(body)))
    folder = write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")
    write(spark.createDataFrame(items, "item_id long, text string"), "benchmark")
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")]
    index = {}
    for item, body in items:
        w = words(body)
        for i in range(len(w) - 12):
            index.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    want = {}
    for i, body in rows:
        w, hit, names = words(body), set(), set()
        for at in range(len(w) - 12):
            if found := index.get(tuple(w[at : at + 13])):
                hit |= set(range(at, at + 13))
                names |= found
        want[i] = (len(w), len(hit), sorted(names))
    for most, spread in ((200_000, 1000), (0, 1000), (0, 3)):  # the joins with a broadcast, with all keys salted, and with few
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "BROADCAST_ROWS", most)
            patch.setattr(common, "SPREAD", spread)
            got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(*tables).collect()}
        assert got == want


def test_bitmaps(spark):
    hashes = spark.range(1000).select(F.xxhash64("id").alias("h"))
    bitmap = decontaminate.bitmap_of(hashes)
    assert len(bitmap) * 8 == 1 << 14 and 0.04 < decontaminate.fill(bitmap) < 0.065
    assert decontaminate.fill(decontaminate.bitmap_of(hashes, 8)) > 0.9
    assert decontaminate._in(bitmap, np.array([r.h for r in hashes.collect()]).view(np.uint64)).all()


def test_empty_tables(spark, write):
    none = spark.createDataFrame([], "item_id long, text string")
    folder = write(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), "documents")
    write(none, "benchmark")
    assert [r.n_hit for r in decontaminate.op4_decontaminate(spark, folder).collect()] == [0]
    write(spark.createDataFrame([], "doc_id long, text string"), "documents")
    assert decontaminate.op4_decontaminate(spark, folder).collect() == []
