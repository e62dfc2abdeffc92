"""Histogram boosting against a plain version in Python, and block by block against one block."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators.models import boosting as bo

COLS = ["f0", "f1", "f2"]


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.5, size=n)) > 0.7).astype(int)
    rows = [(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_idx bigint, label int, f0 double, f1 double, f2 double"), x, y


def plain_boosting(x, y, cuts, s):
    """All rows, all features: every (feature, cut) of every node tried by itself, gradients in 2**-20."""
    margin, trees = [0.0] * len(y), []
    for _ in range(s.rounds):
        g, h = [], []
        for m, t in zip(margin, y):
            p = 1 / (1 + math.exp(-m))
            w = s.positive_weight if t else 1.0
            g.append(round((p - t) * w * 2**20))
            h.append(round(p * (1 - p) * w * 2**20))
        tree = {}

        def score(rows):
            a, b = sum(g[i] for i in rows) / 2**20, sum(h[i] for i in rows) / 2**20
            return a * a / (b + s.l2), a, b

        def build(name, rows, depth):
            whole, a, b = score(rows)
            best = None
            if depth < s.depth:
                for f in range(x.shape[1]):
                    for k, c in enumerate(cuts[f]):
                        left = [i for i in rows if x[i, f] <= c]
                        right = [i for i in rows if x[i, f] > c]
                        (u, _, hu), (v, _, hv) = score(left), score(right)
                        gain = u + v - whole
                        if hu >= s.min_hessian and hv >= s.min_hessian and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, float(c), left, right)
            if best is None or best[0] <= 1e-6:
                tree[name] = -s.rate * a / (b + s.l2)
                for i in rows:
                    margin[i] += tree[name]
                return
            tree[name] = best[1:3]
            build(name + "l", best[3], depth + 1)
            build(name + "r", best[4], depth + 1)

        build("", list(range(len(y))), 0)
        trees.append(tree)
    return margin, trees


def named(tree):
    feature, threshold, left, right, value = tree
    out = {}

    def walk(node, name):
        if feature[node] < 0:
            out[name] = float(value[node])
            return
        out[name] = (int(feature[node]), float(threshold[node]))
        walk(left[node], name + "l")
        walk(right[node], name + "r")

    walk(0, "")
    return out


def test_splits_equal_a_plain_version(spark):
    df, x, y = table(spark, 150)
    s = bo.Settings(rounds=4, depth=3, rate=0.3, subsample=1.0, colsample=1.0, positive_weight=2.0, bins=12)
    cuts = bo.quantile_cuts(df, COLS, s.bins)
    trees = bo.fit_boosting(df.repartition(3), COLS, s)
    margin, want = plain_boosting(x, y, cuts, s)
    for t, w in zip(trees, want):
        got = named(t)
        assert got.keys() == w.keys()
        for k in w:
            assert got[k] == pytest.approx(w[k], abs=1e-9)
    assert np.allclose(bo.margins(x, trees), margin)
    score = df.withColumn("s", bo.score_column(spark, trees, COLS)).orderBy("row_idx").toPandas()["s"]
    assert np.allclose(score, 1 / (1 + np.exp(-np.array(margin))))


def test_blocks_give_the_same_trees(spark, monkeypatch):
    """Levels exchanged between many blocks, margins renewed: the trees of one block, sampled rows and features included."""
    df, x, y = table(spark, 3000, seed=5)
    s = bo.Settings(rounds=12, depth=4, rate=0.1, positive_weight=1.7)
    one = bo.fit_boosting(df, COLS, s)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 400)
    many = bo.fit_boosting(df.repartition(5), COLS, s)
    assert len(one) == len(many) == 12
    for a, b in zip(one, many):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))
    p = 1 / (1 + np.exp(-bo.margins(x, one)))
    assert ((p > 0.5) == (y == 1)).mean() > 0.8


def test_edges(spark):
    df, _, _ = table(spark, 60)
    s = bo.Settings(rounds=3, depth=3)
    odd = df.withColumn("f1", F.when(F.col("row_idx") % 3 == 0, F.lit(float("nan"))).when(F.col("row_idx") % 3 == 1, F.lit(None)).otherwise(F.col("f1")))
    odd = odd.withColumn("f2", F.when(F.col("row_idx") == 4, F.lit(float("inf"))).otherwise(F.lit(1.0)))
    trees = bo.fit_boosting(odd, COLS, s)
    scores = odd.withColumn("s", bo.score_column(spark, trees, COLS)).agg(F.count_if(F.col("s").between(0, 1)), F.count_if(F.isnan("s"))).first()
    assert tuple(scores) == (60, 0)
    same = bo.fit_boosting(df.where("label = 0"), COLS, s)
    assert all(len(t[0]) == 1 for t in same)
    assert bo.fit_boosting(df.limit(0), COLS, s) == [] and bo.margins(np.zeros((2, 3)), []).tolist() == [0, 0]


def test_a_table_of_several_blocks_is_boosted_by_one_task(spark, monkeypatch):
    """a job for each of 2,400 levels took most of the comparison; the trees are those of the exchange."""
    df, _, _ = table(spark, 3000, seed=6)
    s = bo.Settings(rounds=12, depth=5, rate=0.1, positive_weight=1.7)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 400)
    tracker, group = spark.sparkContext.statusTracker(), "boosting-one-task"
    spark.sparkContext.setJobGroup(group, group)
    one = bo.fit_boosting(df.repartition(5), COLS, s)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs < s.rounds
    monkeypatch.setattr(bo, "LOCAL_ROWS", 2999)
    many = bo.fit_boosting(df.repartition(5), COLS, s)
    assert len(one) == len(many) == 12
    for a, b in zip(one, many):
        assert all(np.array_equal(u, v) for u, v in zip(a, b))
