"""Whitening against a fit over all rows in plain numpy, with copies, unsound rows and components without variance."""

import math

import numpy as np
import pytest

from lectern.llm import whiten

KIND = "vec_id long, embedding array<float>, label string, n string"


def table_of(spark, vectors):
    return spark.createDataFrame([(i, v, "l", "clash") for i, v in vectors], KIND)


def sample(rows, width, seed=5):
    g = np.random.default_rng(seed)
    x = (g.standard_normal((rows, width)) * np.linspace(2, 0.5, width) @ np.linalg.qr(g.standard_normal((width, width)))[0]).astype(np.float32)
    x[rows // 2 : rows // 2 + rows // 3] = x[0]
    return x


def plain(x):
    """(n, deviations, eigenvalues falling, eigenvectors, centred) of all rows, one by one."""
    w = [[math.floor(64 * float(c)) + 1_000_000 for c in row] for row in x]
    n, sums = len(w), [sum(c) for c in zip(*w)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in w]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in w])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, deviation, values[::-1], vectors[:, ::-1], z


@pytest.mark.parametrize("width", [5, 48])
def test_query_equals_a_fit_over_all_rows(spark, write, width):
    x = sample(900, width)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2001, []), (2002, [None] * width), (2003, [float("nan")] * width), (2004, [math.inf] + [0.0] * (width - 1)), (2005, [1.0] * (width + 1))]
    got = whiten.op12_whitening(spark, write(table_of(spark, rows + bad).repartition(7), "embeddings"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviation, values, vectors, z = plain(x)
    top = min(width, 32)
    found = {(r.vec_id, r.component): r for r in got.collect()}
    assert set(found) == {(i, c) for i in range(n) for c in range(1, top + 1)}
    assert all(r.n == n and r.deviation == deviation[r.vec_id] for r in found.values())
    made = np.array([[found[i, c].whitened for c in range(1, top + 1)] for i in range(n)])
    want = z @ vectors[:, :top] / np.sqrt(values[:top])
    sign = np.sign((made * want).sum(axis=0))
    assert np.abs(made * sign - want).max() < 1e-9
    assert np.allclose([found[0, c].explained for c in range(1, top + 1)], values[:top] / values.sum(), rtol=1e-9)
    (error,) = {r.identity_error for r in found.values()}
    assert error < 1e-9 and np.abs(np.cov(made.T, bias=True) - np.eye(top)).max() < 1e-9


def test_fit_on_different_vectors(spark):
    x = sample(300, 4)
    _, model, _ = whiten.whitened(table_of(spark, [(i, v.tolist()) for i, v in enumerate(x)]), unit=True)
    distinct = np.unique(np.floor(64 * x.astype(float)), axis=0)
    assert model.n == len(distinct) and np.allclose(model.values, np.linalg.eigvalsh(np.cov(distinct.T, bias=True))[::-1])


def test_no_variance_huge_entries_null_and_repeated_ids(spark, write):
    rows = [(None, [1.0, 2.0])] * 3 + [(7, [1.0, 2.0])] * 2
    got = whiten.op12_whitening(spark, write(table_of(spark, rows), "embeddings")).collect()
    assert len(got) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(5, 0, 0.0, 0.0, 0.0)}
    rows = [(i, [float(i % 3), 3e38 if i == 4 else 0.5 * i, 1.0]) for i in range(9)]
    got = whiten.op12_whitening(spark, write(table_of(spark, rows), "embeddings")).collect()
    assert len(got) == 27 and all(math.isfinite(r.whitened) for r in got) and {r.deviation for r in got} == {None}


def test_sums_of_many_parts_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN", 2)
    x = sample(400, 3)
    frame = table_of(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    classes = whiten.classes_of(frame, "embedding").repartition(9)
    assert np.allclose(whiten.fit(classes).values, plain(x)[2])


def test_empty_table(spark, write):
    got = whiten.op12_whitening(spark, write(table_of(spark, []), "embeddings"))
    assert got.collect() == [] and got.columns[0] == "vec_id"
