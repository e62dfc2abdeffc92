"""One-class SVM by its dual: against a plain projected gradient, the conditions on every row, repeats, persistence."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators.models import AnomalyDetector, ocsvm_dual
from aerolens.schema import FEATURE_NAMES

COLS = ["f0", "f1", "f2"]


def _projected(v, c, total):
    """The nearest weights with 0 <= a <= c and sum a = total (by bisection of the shift)."""
    lo, hi = v.min() - c.max() - 1, v.max() + 1
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, c).sum() > total else (lo, mid)
    return np.clip(v - hi, 0, c)


def _plain(X, c, nu, gamma, steps=2_000):
    K = np.exp(-gamma * ((X[:, None] - X[None]) ** 2).sum(-1))
    a = _projected(np.zeros(len(X)), c, nu * c.sum())
    rate = 1.0 / np.linalg.eigvalsh(K)[-1]
    for _ in range(steps):
        a = _projected(a - rate * (K @ a), c, nu * c.sum())
    return K, a


def _rows(n, seed=0, copies=0):
    X = np.random.default_rng(seed).normal(size=(n, 3)) * [3.0, 1.0, 0.2]
    return np.vstack([X, np.repeat(X[:1], copies, axis=0)]) if copies else X


def _frame(spark, X):
    return spark.createDataFrame([tuple(map(float, x)) for x in X], ", ".join(f"{c} double" for c in COLS)).repartition(4)


@pytest.mark.parametrize("nu,copies", [(0.05, 0), (0.3, 0), (0.2, 120)])
def test_objective_equals_plain_solution(spark, nu, copies):
    X = _rows(240, copies=copies)
    S, a, c, rho, gamma = ocsvm_dual.fit_dual(spark, _frame(spark, X), COLS, nu, part_points=40)
    assert gamma == pytest.approx(1.0 / (3 * X.var()))
    P, n = np.unique(X, axis=0, return_counts=True)
    K, want = _plain(P, n.astype(float), nu, gamma)
    got = ocsvm_dual.kernel(S, S, gamma)
    best, mine = 0.5 * want @ K @ want, 0.5 * a @ got @ a
    assert a.sum() == pytest.approx(nu * len(X)) and (a <= c).all()
    assert mine <= best * (1 + 1e-4) + 1e-3
    # the conditions on every row, by a kernel of its own
    f = np.exp(-gamma * ((X[:, None] - S[None]) ** 2).sum(-1)) @ a - rho
    weight = {s.tobytes(): (w, b) for s, w, b in zip(S, a, c)}
    for x, s in zip(X, f):
        w, b = weight.get(x.tobytes(), (0.0, 1))
        assert w >= b or s >= -0.002
        assert w <= 0 or s <= 0.002
    assert (f < -0.002).sum() <= nu * len(X)


def test_cascade_equals_one_part(spark):
    df = _frame(spark, _rows(500, seed=3))
    one = ocsvm_dual.fit_dual(spark, df, COLS, 0.1, part_points=1000)
    many = ocsvm_dual.fit_dual(spark, df, COLS, 0.1, part_points=20)
    X = _rows(200, seed=4)
    score = lambda m: ocsvm_dual.expansion(X, m[0], m[1], m[4]) - m[3]
    assert np.abs(score(one) - score(many)).max() < 0.01


def test_edges(spark):
    same = spark.createDataFrame([(1.0, 2.0, 3.0)] * 30, ", ".join(f"{c} double" for c in COLS))
    S, a, c, rho, gamma = ocsvm_dual.fit_dual(spark, same, COLS, 0.1)
    assert len(S) == 1 and a.sum() == pytest.approx(3.0) and c[0] == 30 and gamma == pytest.approx(0.5)
    S, a, c, _, _ = ocsvm_dual.fit_dual(spark, _frame(spark, _rows(12)), COLS, 1.0)        # every row at its bound
    assert len(S) == 12 and (a == c).all()
    with pytest.raises(ValueError, match="no training rows"):
        ocsvm_dual.fit_dual(spark, same.limit(0), COLS)
    with pytest.raises(ValueError, match="nu"):
        ocsvm_dual.fit_dual(spark, same, COLS, 0.0)


def test_detector_ranks_outliers_and_reloads(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, *map(float, rng.normal(size=len(FEATURE_NAMES)))) for i in range(300)]
    rows += [(1000 + i, 1, *map(float, 8.0 + rng.normal(size=len(FEATURE_NAMES)))) for i in range(10)]
    df = spark.createDataFrame(rows, "_ord long, label int, " + ", ".join(f"{c} double" for c in FEATURE_NAMES))
    det = AnomalyDetector("one_class_svm").fit(df)
    out = det.predict(df)
    low, high = out.groupBy("label").agg(F.max("ml_score").alias("hi"), F.min("ml_score").alias("lo")).orderBy("label").collect()
    assert high["hi"] < low["lo"]
    path = tempfile.mkdtemp(prefix="aerolens-dual-")
    det.save(spark, path)
    again = AnomalyDetector.load(spark, path).predict(df)
    both = out.select("_ord", "ml_score").join(again.select("_ord", F.col("ml_score").alias("s2")), "_ord")
    assert both.where(F.abs(F.col("ml_score") - F.col("s2")) > 1e-9).count() == 0
