"""Embedding near duplicates against a comparison of all pairs."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import vectors


def brute(rows):
    ids, found = [i for i, _ in rows], {}
    sound = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, sound)]
    near = [{j for j in range(len(rows)) if j != i and sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in range(len(rows))]
    for i in range(len(rows)):
        todo, group = [i], {i}
        while todo:
            for b in near[todo.pop()] - group:
                group.add(b)
                todo.append(b)
        found.setdefault(i, (len(near[i]), min((ids[g] for g in group if ids[g] is not None), default=None)))
    return found


def rows_of(rng):
    base = rng.standard_normal((300, 16))
    rows = [base[i].tolist() for i in range(300)]
    for i in range(120):
        rows.append((base[i % 40] + rng.standard_normal(16) * 0.15).tolist())
    rows += [base[3].tolist()] * 4 + [(base[4] * 2).tolist()] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [float("inf"), 1.0], [1.0, 2.0], [2.0, 4.0], [1e-30] * 16]
    return [(i if i != 5 else None, v) for i, v in enumerate(rows)]


def test_query_equals_all_pairs(spark, write, monkeypatch):
    monkeypatch.setattr(vectors.forest, "__defaults__", (vectors.TREES, 64, vectors.SPILL))
    monkeypatch.setattr(vectors.trees_for, "__defaults__", (vectors.COSINE, 64, vectors.SPILL))
    rows = rows_of(np.random.default_rng(2))
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cls int")
    got = vectors.op8_embedding_neardup(spark, write(frame, "embeddings")).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    links = {r.vec_id: r.n_links for r in got}
    assert sum(links.values()) >= 0.9 * sum(n for n, _ in want.values()) and all(links[rows[i][0]] <= n for i, (n, _) in want.items())
    right = sum(next(r for r in got if r.vec_id == rows[i][0]).component_id == c for i, (_, c) in want.items())
    assert right >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_recall_of_small_leaves(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 32))
    copies = base[:300] + rng.standard_normal((300, 32)) * 0.12
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([base, copies]))], "vec_id long, embedding array<double>")
    classes = vectors.classes_of(frame, "embedding", "vec_id")
    ids = {r.cls: r.first for r in classes.select("cls", "first").collect()}
    got = {tuple(sorted((ids[a], ids[b]))) for a, b in vectors.links(classes, vectors.forest(classes, leaf=64)).collect()}
    unit = np.vstack([base, copies])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.9))}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_links_of_a_dense_group_are_whole(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    near = centre / np.linalg.norm(centre) + rng.standard_normal((1500, 64)) * 0.025
    rows = np.vstack([near, rng.standard_normal((3000, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert [got[i] for i in range(len(rows))] == want.tolist() and want[:1500].min() > 1000


def test_a_component_in_several_blocks_counts_alike(spark):
    rng = np.random.default_rng(6)
    rows = np.vstack([rng.standard_normal(16) + rng.standard_normal((70, 16)) * 0.2 for _ in range(3)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    classes = vectors.classes_of(frame, "embedding", "vec_id")
    members = classes.select((F.col("first") % 3).alias("fam"), "cls", (1 + F.col("first") % 2).alias("n"))
    small, large = ({r.cls: r.others for r in vectors.counted(members, classes, block=b).collect()} for b in (16, 512))
    assert small == large and len(small) == 210 and sum(small.values()) > 0


def test_recall_at_sixteen_levels(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((20_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((1000, 32))
    side -= (side * base[:1000]).sum(axis=1, keepdims=True) * base[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    rows = np.vstack([base, 0.901 * base[:1000] + np.sqrt(1 - 0.901**2) * side])  # lone pairs at the threshold
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    classes = vectors.classes_of(frame, "embedding", "vec_id")
    leaf = 2
    assert np.log(len(rows) / leaf) / -np.log(0.5 + vectors.SPILL) > 15
    leaves = vectors.settle(vectors.forest(classes, vectors.trees_for(len(rows), leaf=leaf), leaf=leaf))
    ids = {r.cls: r.first for r in classes.select("cls", "first").collect()}
    got = {tuple(sorted((ids[a], ids[b]))) for a, b in vectors.links(classes, leaves).collect()}
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(rows @ rows.T, 1) >= 0.9))}
    assert got <= near and len(got & {(i, 20_000 + i) for i in range(1000)}) >= 900


def test_a_dense_group_is_not_copied_over_and_over(spark):
    rng = np.random.default_rng(12)
    rows = np.vstack([rng.standard_normal(32) + rng.standard_normal((3000, 32)) * 0.1, rng.standard_normal((6000, 32))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    classes = vectors.classes_of(frame, "embedding", "vec_id")
    assert vectors.forest(classes, 1, leaf=64).count() < 4 * len(rows)


def test_deeper_forests_have_more_trees():
    assert vectors.trees_for(0) == vectors.trees_for(vectors.LEAF) == 1
    assert vectors.trees_for(vectors.LEAF + 1) == vectors.TREES < vectors.trees_for(1_000_000) < vectors.trees_for(60_000_000)


def test_empty_table(spark, write):
    assert vectors.op8_embedding_neardup(spark, write(spark.createDataFrame([], "vec_id long, embedding array<float>"), "embeddings")).collect() == []
