"""Exact search by tiles against all distances; what the neighbour forest keeps on disk."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators.models import knn, lof, neighbours as nb
from aerolens.operators.models.ocsvm_dual import points_of
from aerolens.session import checkpoint_dir


@pytest.mark.parametrize("kind", ["normal", "ties", "narrow", "infinite"])
def test_tiles_give_the_result_of_a_full_search(monkeypatch, kind):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(900, 5)) * [100, 1, 1, 0.1, 0]
    if kind == "ties":
        X = rng.integers(0, 4, (900, 5)).astype(float)
    elif kind == "narrow":
        X = X + 1e9
    elif kind == "infinite":
        X[7, 2] = np.inf
    monkeypatch.setattr(knn, "TILE", 32)
    monkeypatch.setattr(knn, "QUERIES", 16)
    monkeypatch.setattr(knn, "CHUNK", 64)
    with np.errstate(invalid="ignore"):
        D = np.sqrt(sum((X[:, None, f] - X[None, :, f]) ** 2 for f in range(5)))
    for own in (np.arange(900), None):
        row, col, dist = knn.Reference(X).nearest(X, 7, own)
        for i in (0, 7, 13, 899):
            d = D[i].copy()
            if own is not None:
                d[i] = np.inf
            want = [j for j in np.lexsort((np.arange(900), d))[:7] if np.isfinite(d[j])]
            assert col[row == i].tolist() == want
            assert np.array_equal(dist[row == i], d[want])


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_more_trees_take_no_more_disk(spark):
    """every tree's points and all trees' pairs were on disk at once."""
    X = np.random.default_rng(4).normal(size=(4000, 4))
    frame = spark.createDataFrame([tuple(map(float, x)) for x in X], "f0 double, f1 double, f2 double, f3 double")
    points = nb.written(nb.with_ids(points_of(frame, ["f0", "f1", "f2", "f3"])))
    folder, kept = checkpoint_dir(spark), []
    for trees in (2, 8):
        before = _bytes(folder)
        found = nb.nearest(points, 5, trees=trees, leaf=60)
        assert found.groupBy("id").agg(F.sum("take").alias("n")).where("n <> 5").isEmpty()
        kept.append(_bytes(folder) - before)
    assert kept[1] < 2 * kept[0]


class _Spy:
    def __init__(self, B):
        self.B, self.rows = B, 0

    def __getitem__(self, at):
        self.rows += len(at)
        return self.B[at]


def test_lof_scores_leave_out_far_rows_and_equal_plain_scores():
    """every scored row was compared with the whole reference set."""
    rng = np.random.default_rng(6)
    R = (rng.normal(size=(40, 3)) * 1000)[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 3))
    X, k = R[:600] + rng.normal(size=(600, 3)) * 0.1, 10
    kd, lrd = rng.uniform(0.1, 1.0, len(R)), rng.uniform(0.5, 2.0, len(R))
    ref = knn.Reference(R)
    ref.B = spy = _Spy(ref.B)
    got = lof._scores(X, ref, kd, lrd, k)
    tiles = -(-len(X) // (knn.QUERIES // 2))
    assert spy.rows < 0.5 * tiles * len(R)
    D = np.sqrt(((X[:, None] - R[None]) ** 2).sum(-1))
    near = np.argsort(D, axis=1, kind="stable")[:, :k]
    reach = np.maximum(kd[near], np.take_along_axis(D, near, axis=1)).mean(axis=1)
    np.testing.assert_allclose(got, -(lrd[near].mean(axis=1) * (reach + 1e-10)), rtol=1e-9)
