"""Random forest: splits against a plain search, nodes split by jobs against nodes finished by tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators.models import boosting as bo, forest as fo

COLS = ["f0", "f1", "f2"]


def table(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.5, size=n)) > 0.7).astype(int)
    rows = [(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_idx bigint, label int, f0 double, f1 double, f2 double"), x, y


def gini(y, w, s):
    a, b = w[y == 0].sum() * s.weights[0], w[y == 1].sum() * s.weights[1]
    return (a + b) - (a * a + b * b) / (a + b) if a + b else 0.0


def test_subtree_takes_the_best_split_of_every_node():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (400, 3)).astype(np.uint8)
    y = (x[:, 0] + rng.integers(0, 5, 400) > 6).astype(np.uint8)
    w = rng.integers(1, 4, 400).astype(np.uint8)
    s = fo.Settings(trees=2, depth=4, min_leaf=15, weights=(0.7, 2.0), max_features="all", bins=8)
    feature, cut, left, value = fo.subtree(x, y, w, 0, 1, 0, s)
    assert len(feature) > 7

    def check(node, rows, depth):
        a, b = w[rows][y[rows] == 0].sum() * 0.7, w[rows][y[rows] == 1].sum() * 2.0
        assert value[node] == pytest.approx(b / (a + b))
        best = 0.0
        for f in range(3):
            for c in range(7):
                go = x[rows, f] <= c
                low, high = rows[go], rows[~go]
                if w[low].sum() >= 15 and w[high].sum() >= 15:
                    best = max(best, gini(y[rows], w[rows], s) - gini(y[low], w[low], s) - gini(y[high], w[high], s))
        if feature[node] < 0:
            assert depth == 4 or best < 1e-9
            return
        go = x[rows, feature[node]] <= cut[node]
        low, high = rows[go], rows[~go]
        assert min(w[low].sum(), w[high].sum()) >= 15
        assert gini(y[rows], w[rows], s) - gini(y[low], w[low], s) - gini(y[high], w[high], s) == pytest.approx(best)
        check(left[node], low, depth + 1)
        check(left[node] + 1, high, depth + 1)

    check(0, np.arange(400), 0)


def test_nodes_of_jobs_and_of_tasks_give_the_same_forest(spark, monkeypatch):
    df, x, y = table(spark, 3000)
    s = fo.Settings(trees=6, depth=7, min_leaf=5, weights=(0.8, 1.4))
    one = fo.scores(x, fo.joined(fo.fit_trees(df, COLS, s)))
    monkeypatch.setattr(fo, "LOCAL_ROWS", 300)        # nodes above are split by jobs
    monkeypatch.setattr(fo, "PAIRS", 3000 * 4)        # four trees a pass, then two
    monkeypatch.setattr(bo, "BLOCK_ROWS", 700)
    many = fo.scores(x, fo.joined(fo.fit_trees(df.repartition(5), COLS, s)))
    assert (one == many).all()
    assert one[y == 1].mean() > one[y == 0].mean() + 0.4


def test_scores_follow_the_tables_of_the_trees(spark):
    df, x, _ = table(spark, 500)
    trees = fo.fit_trees(df, COLS, fo.Settings(trees=3, depth=5, min_leaf=3))
    again = fo.trees_of([dict(zip(("tree_id", "feature", "threshold", "left", "value"), r)) for r in fo.tree_rows(trees)])
    want = np.zeros(len(x))
    for feature, threshold, left, value in again:
        for k, v in enumerate(x):
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(v[feature[node]] > threshold[node])
            want[k] += value[node]
    got = [r["s"] for r in df.withColumn("s", fo.score_column(spark, trees, COLS)).orderBy("row_idx").collect()]
    assert np.allclose(got, want / 3, atol=1e-12)


def test_one_class_missing_values_and_no_rows(spark):
    rows = [(i, 0, None if i % 3 else float(i), float("nan"), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "row_idx bigint, label int, f0 double, f1 double, f2 double")
    trees = fo.fit_trees(df, COLS, fo.Settings(trees=2, min_leaf=2))
    assert df.select(fo.score_column(spark, trees, COLS).alias("s")).where("s <> 0").count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        fo.fit_trees(df.where(F.lit(False)), COLS, fo.Settings())
    assert [fo.columns_a_node(h, 20, 200) for h in ("sqrt", "log2", "onethird", "all", 7, 0.5)] == [5, 5, 7, 20, 7, 10]
