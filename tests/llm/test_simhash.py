"""SimHash against brute force: fingerprints, and components that no pair search may miss."""

import random
import re

import pytest
import xxhash

from lectern.llm import simhash


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, near):
    seen, out = set(), {}
    for n in sorted(nodes):
        if n in seen:
            continue
        todo, group = [n], {n}
        while todo:
            a = todo.pop()
            for b in nodes:
                if b not in group and near(a, b):
                    group.add(b)
                    todo.append(b)
        seen |= group
        out |= dict.fromkeys(group, min(group))
    return out


def test_query_equals_brute_force(spark, write):
    rnd = random.Random(3)
    vocabulary = ["the", "of", "Öl", "Thé", "naïve", "x", "word" * 12, "日本", "A", "nbsp here"]
    texts = [None, "", " \t\n", "one", "Two words", "three little words"]
    for _ in range(60):
        base = [rnd.choice(vocabulary) + str(rnd.randint(0, 400)) for _ in range(rnd.choice([40, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rnd.randrange(len(base))] = "edit" + str(rnd.randint(0, 9))
            texts.append("\n".join(base).upper() if rnd.random() < 0.3 else "  ".join(base))
    rows = [(i, t, "fp") for i, t in enumerate(texts)] + [(3, texts[3], "fp")]
    got = simhash.op9_simhash(spark, write(spark.createDataFrame(rows, "doc_id long, text string, fp string"), "documents")).collect()
    assert len(got) == len(rows)
    fps = {i: fingerprint(t) for i, t in enumerate(texts)}
    group = components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", group[r.doc_id])
    assert len(set(group.values())) < len(group) - 20


@pytest.mark.parametrize("pairwise", [0, 32])
def test_links_reach_all_within_two_bits(spark, pairwise):
    rnd = random.Random(9)
    fps = set()
    for _ in range(15):
        x = rnd.getrandbits(64)
        for _ in range(14):
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    edges = {tuple(r) for r in simhash.links(frame, pairwise).collect()}
    near = {signed(x): {signed(y) for y in fps if (x ^ y).bit_count() <= 2} for x in fps}
    assert all(b in near[a] for a, b in edges)
    linked = lambda a, b: (a, b) in edges or (b, a) in edges
    nodes = [signed(x) for x in fps]
    assert components(nodes, linked) == components(nodes, lambda a, b: b in near[a])


def test_one_row_stays_of_each_component(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "other words are here now"), (None, "null id text alone"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id, r.text) for r in simhash.keep_first(docs).collect())
    assert kept == [(False, 2, "a b c d e f"), (False, 7, None), (False, 9, "other words are here now"), (True, None, "null id text alone")]


def test_long_texts_and_copies_in_a_third_of_all_rows(spark, write):
    rnd = random.Random(2)
    long = " ".join(f"w{rnd.randrange(3000)}" for _ in range(40_000))
    rows = [(i, "the same boilerplate text again and again" if i % 3 == 0 else f"own words of row {i} " + str(rnd.random())) for i in range(3000)]
    rows += [(5000, long), (5001, long + " end"), (5002, "x" * 200_000), (5003, " " * 100_000)]
    got = {r.doc_id: r for r in simhash.op9_simhash(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), "documents")).collect()}
    assert len(got) == len(rows) and all(got[i].component_id == 0 for i in range(0, 3000, 3))
    for i in (5000, 5001, 5002, 5003, 1):
        assert got[i].fingerprint == f"{fingerprint(dict(rows)[i]):016x}"


def test_empty_table(spark, write):
    assert simhash.op9_simhash(spark, write(spark.createDataFrame([], "doc_id long, text string"), "documents")).collect() == []
