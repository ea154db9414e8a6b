"""The cosine join and its clusters against all pairs."""

import numpy as np
import pytest

from penstock.operators import merges


def vectors(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dim))
    e = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, dim)) * 0.25
    e[:30] = e[30:60]  # equal vectors
    return e, rng.integers(0, 2, n)


def clusters(e, unit, threshold):
    """Root of each row by repeated passing on of the least."""
    with np.errstate(invalid="ignore"):
        u = np.nan_to_num(e / np.linalg.norm(e, axis=1, keepdims=True))
    near = (u @ u.T >= threshold) & (unit[:, None] == unit[None, :])
    np.fill_diagonal(near, True)
    root = np.arange(len(e))
    while True:
        new = np.where(near, root[None, :], len(e)).min(axis=1)
        if (new == root).all():
            return root
        root = new


@pytest.mark.parametrize(("threshold", "pivots", "block"), [(0.92, 16, 7), (0.8, 128, 2048), (0.97, 1, 40), (0.3, 8, 30)])
def test_no_pair_is_lost(spark, threshold, pivots, block):
    e, unit = vectors(int(threshold * 100) % 7)
    e[100] = 0
    rows = [(i, str(u), f"n{i}", 1 + i % 3, v.tolist()) for i, (v, u) in enumerate(zip(e, unit, strict=True))]
    df = spark.createDataFrame(rows, "id bigint, unit string, name string, n int, embedding array<double>").repartition(3)
    got = {r.id: (r.root, r.canonical) for r in merges.name_merges(df, threshold, pivots, block).collect()}
    root = clusters(e, unit, threshold)
    size = np.bincount(root, minlength=len(e))
    want = {}
    for i in range(len(e)):
        if size[root[i]] > 1:
            members = [rows[j] for j in np.flatnonzero(root == root[i])]
            want[i] = (int(root[i]), min(members, key=lambda r: (-r[3], len(r[2]), r[2]))[2])
    assert got == want and want


def test_odd_vectors(spark):
    rows = [(1, None, "a", 1, [1.0, 0.0]), (2, "", "bb", 1, [2.0, 0.0]), (3, "kg", "c", 1, [1.0, 0.0]), (4, "kg", "d", 1, None), (5, "kg", "e", 1, [0.0, 0.0]), (6, "kg", "f", 1, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "id bigint, unit string, name string, n int, embedding array<double>")
    assert sorted((r.id, r.canonical, r.root) for r in merges.name_merges(df).collect()) == [(1, "a", 1), (2, "a", 1), (3, "c", 3), (6, "c", 3)]
    assert merges.name_merges(df.where("id > 3 and id < 6")).count() == 0


def test_edges_are_as_few_as_nodes():
    hit = np.ones((50, 60), bool)
    assert len(merges._linked(hit)) == 109
    assert merges._linked(np.zeros((3, 4), bool)) == []
