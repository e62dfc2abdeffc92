"""Work that grows with the table is done once, with the same results."""

from __future__ import annotations

import numpy as np
import pandas as pd

from aerolens.operators.models import boosting as bo, neighbours as nb, ocsvm_dual as du
from aerolens.plans import q_models
from tests.conftest import SF_SMALL


def test_kernel_by_products_equals_differences_without_their_loop(monkeypatch):
    rng = np.random.default_rng(5)
    X, Y = rng.normal(size=(300, 20)) * 50 + 1e4, rng.normal(size=(200, 20)) * 50 + 1e4
    Y[:20] = X[:20]
    want = np.exp(-1e-5 * ((X[:, None] - Y[None]) ** 2).sum(axis=2))
    by, calls = du._by_differences, []
    monkeypatch.setattr(du, "_by_differences", lambda a, b: calls.append(len(a)) or by(a, b))
    assert np.abs(du.kernel(X, Y, 1e-5) - want).max() < 1e-10 and not calls
    X[:3], Y[:3] = X[:3] + 1e12, Y[:3] + 1e12            # products would be off here
    want = np.exp(-1e-5 * ((X[:, None] - Y[None]) ** 2).sum(axis=2))
    assert np.abs(du.kernel(X, Y, 1e-5) - want).max() < 1e-9 and calls


def test_boosting_sums_only_one_of_two_sisters():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 16, (4000, 5)).astype(np.uint8), rng.integers(0, 2, 4000).astype(np.uint8)
    y[x[:, 0] + x[:, 1] > 17] = 1
    h = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    block = bo.Block((x.tobytes(), y.tobytes(), h.tobytes(), np.zeros(4000).tobytes()), 5)
    s, asked = bo.Settings(depth=5, bins=16), []

    def exchange(tree, nodes, columns):
        asked.append(len(nodes))
        return bo.sums(block, tree, nodes, columns, 0, s)

    tree = bo.grow(exchange, 5, 0, s)
    assert asked[0] == 1 and all(n <= 2 ** d // 2 for d, n in enumerate(asked) if d)
    # every leaf's value follows from its own rows
    node, taken = tree.nodes_of(x), bo._sampled(h, s.subsample, s.seed * 1_000_003)
    for n in np.unique(node):
        mine = (node == n) & taken
        g, hess = np.round((0.5 - y[mine]) * 2**20).sum() / 2**20, 0.25 * mine.sum()
        assert abs(tree.value[n] + s.rate * g / (hess + s.l2)) < 1e-9


def test_neighbour_recall_builds_one_forest(spark, monkeypatch):
    real, calls = nb.leaves, []
    monkeypatch.setattr(nb, "leaves", lambda *a, **k: calls.append(1) or real(*a, **k))
    row = q_models.m7_neighbour_recall(spark, SF_SMALL).first()
    assert len(calls) == 1 and row["n_without_factor"] == 0 and row["recall_fits"]


def test_nearest_keeps_ties_and_skips_the_point_itself():
    rng = np.random.default_rng(1)
    X = rng.integers(0, 3, (150, 4)).astype(float)
    p = pd.DataFrame({"id": [f"{i:03d}" for i in rng.permutation(150)], "x": list(X), "c": 1})
    got = nb._nearest(p, p, 7)
    for i, x in zip(p["id"], p["x"]):
        d = sorted((float(np.sqrt(((x - z) ** 2).sum())), j) for j, z in zip(p["id"], p["x"]) if j != i)[:7]
        assert [(round(a, 9), b) for a, b in d] == [(round(a, 9), b) for a, b in got[got["id"] == i][["dist", "nbr"]].itertuples(index=False)]
