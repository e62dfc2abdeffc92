"""Neighbours and outlier factors of all rows: against plain numpy, with repeats, ties, deep trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators.models import neighbours as nb
from aerolens.operators.models.ocsvm_dual import points_of

COLS = ["f0", "f1", "f2", "f3"]


def _frame(spark, X):
    return spark.createDataFrame([tuple(map(float, x)) for x in X], ", ".join(f"{c} double" for c in COLS))


def _plain_lof(X, k):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    k = min(k, len(X) - 1)
    order = np.argsort(D, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(D, order, axis=1)
    kd = dist[:, -1]
    lrd = 1.0 / (np.maximum(kd[order], dist).mean(axis=1) + 1e-10)
    return lrd[order].mean(axis=1) / lrd


def _lofs(out):
    return {tuple(r["x"]): r["lof"] for r in out.collect()}


@pytest.mark.parametrize("n,k", [(150, 10), (8, 20)])
def test_one_leaf_equals_plain(spark, n, k):
    X = np.random.default_rng(1).normal(size=(n, 4))
    got = _lofs(nb.outlier_factors(_frame(spark, X), COLS, k, trees=1, leaf=1000))
    assert len(got) == n
    np.testing.assert_allclose([got[tuple(x)] for x in X], _plain_lof(X, k), rtol=1e-9)


def test_repeated_rows_count_as_neighbours(spark):
    X = np.random.default_rng(2).normal(size=(60, 4))
    X = np.vstack([X, np.repeat(X[:1], 40, axis=0), np.repeat(X[1:2], 3, axis=0)])
    got = _lofs(nb.outlier_factors(_frame(spark, X), COLS, 6, trees=1, leaf=1000))
    assert len(got) == 60
    want = _plain_lof(X, 6)
    # rows whose neighbours lie at different distances have one right answer
    np.testing.assert_allclose([got[tuple(x)] for x in X], want, rtol=1e-6)


def test_leaves_are_bounded_and_whole(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(size=(600, 4)), [[1e9 + i * 1e-7, 0, 0, 0] for i in range(300)]])     # projections that tie
    points = nb.with_ids(points_of(_frame(spark, X), COLS))
    out = nb.leaves(points, trees=3, leaf=10).persist()
    assert out.groupBy("tree", "node").count().agg(F.max("count")).first()[0] <= 10
    n = points.count()
    assert [r["n"] for r in out.groupBy("tree").agg(F.countDistinct("id").alias("n")).collect()] == [n] * 3
    assert out.count() == 3 * n
    out.unpersist()


def test_recall_against_full_search(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(4, 4))[rng.integers(0, 4, 3000)] * 5 + rng.normal(size=(3000, 4))
    points = nb.with_ids(points_of(_frame(spark, X), COLS)).persist()
    queries = points.where(F.pmod(F.xxhash64("id"), F.lit(10)) == 0)
    exact = nb.nearest_exact(points, queries, 10, block=700).persist()
    # the full search itself, against numpy
    first = queries.orderBy("id").first()
    want = np.sort(np.sqrt(((X - np.array(first["x"])) ** 2).sum(-1)))[1:11]
    np.testing.assert_allclose(sorted(r["dist"] for r in exact.where(F.col("id") == first["id"]).collect()), want)
    r = nb.recall(nb.nearest(points, 10, trees=10, leaf=200), exact).first()
    assert r["n_points"] == queries.count() and r["n_true"] == 10 * r["n_points"] and r["recall"] >= 0.9
    assert nb.recall(exact, exact).first()["recall"] == 1.0


def test_too_few_rows(spark):
    df = _frame(spark, np.ones((1, 4)))
    for few in (df, df.limit(0)):
        with pytest.raises(ValueError, match="two rows"):
            nb.outlier_factors(few, COLS)
    same = nb.outlier_factors(_frame(spark, np.ones((30, 4))), COLS, 5).first()
    assert same["c"] == 30 and same["lof"] == pytest.approx(1.0)
