"""Walks of many rows, sums of a round and quantiles of large tables against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from aerolens.operators.models import boosting as bo, forest as fo


def _tree(rng, n_features, depth, bins, share=0.9):
    t, last = bo.Tree(), [0]
    for d in range(depth):
        last = [c for n in last if d == 0 or rng.random() < share for c in t.split(n, int(rng.integers(n_features)), int(rng.integers(bins)))]
    t.value = [float(v) for v in rng.normal(size=len(t.feature))]
    return t


@pytest.mark.parametrize("depth", [0, 1, 4, 8, 13])
def test_ends_are_those_of_a_walk_row_by_row(depth):
    """A level looked all rows up node by node from the root on."""
    rng = np.random.default_rng(depth)
    x, t = rng.integers(0, 16, (700, 6)).astype(np.uint8), _tree(rng, 6, depth, 16)
    assert np.array_equal(t.ends(np.ascontiguousarray(x.T)), t.nodes_of(x))


@pytest.mark.parametrize("many", [5, 400])
def test_scores_are_those_of_the_thresholds(many):
    rng = np.random.default_rng(many)
    x, trees = np.round(rng.normal(size=(300, 4)), 2), []
    for _ in range(many):
        t = _tree(rng, 4, 7, 9)
        cut = np.round(rng.normal(size=len(t.feature)), 2)
        cut[rng.random(len(cut)) < 0.02] = np.inf
        trees.append(tuple(np.array(c) for c in (t.feature, cut, t.left, t.right, t.value)))
    x[3, 1], x[4, 2] = np.inf, -np.inf
    want = np.zeros(len(x))
    for feature, cut, left, right, value in trees:
        for i, v in enumerate(x):
            n = 0
            while feature[n] >= 0:
                n = left[n] if v[feature[n]] <= cut[n] else right[n]
            want[i] += value[n]
    assert np.allclose(bo.margins(x, trees), want, atol=1e-9)


def test_gradients_are_worked_out_once_a_round(monkeypatch):
    """Every level of a tree worked out gradients and samples of all rows again."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 16, (2000, 5)).astype(np.uint8), rng.integers(0, 2, 2000).astype(np.uint8)
    h, s, t = rng.integers(0, 1 << 62, 2000).astype(np.uint64), bo.Settings(bins=16, positive_weight=3.0), _tree(rng, 5, 4, 16, 1.0)
    row = tuple(bytearray(a.tobytes()) for a in (x, y, h, rng.normal(size=2000)))
    nodes, columns = [n for n in range(len(t.feature)) if t.feature[n] < 0], np.array([0, 2, 4])
    want = bo.sums(bo.Block(row, 5), t, nodes, columns, 6, s)
    ready = list(bo._renewed(bo._begun([row], 5), None, 6, 5, s))
    monkeypatch.setattr(bo, "_gradients", None)
    monkeypatch.setattr(bo, "_sampled", None)
    got, = bo._level(ready, t, nodes, columns, 5, s)
    assert np.array_equal(got, want) and got.any()


def test_quantiles_of_summaries(monkeypatch):
    """A digest of every column and partition took longer than the blocks."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=5000), rng.integers(0, 3, 5000).astype(float)])
    monkeypatch.setattr(bo, "SUMMED", 900)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], ["a", "b"]) for part in np.array_split(x, 11)]
    for ranks in (50, 10_000):
        monkeypatch.setattr(bo, "RANKS", ranks)
        found = [r for b in bo._summaries(iter(batches)) for r in b.to_pylist()]
        for f in (0, 1):
            mine = [r for r in found if r["f"] == f]
            v, n = np.frombuffer(b"".join(r["v"] for r in mine)), np.frombuffer(b"".join(r["n"] for r in mine), np.int64)
            assert n.sum() == 5000 and max(len(r["v"]) // 8 for r in mine) <= ranks
            order = np.argsort(v, kind="stable")
            for share in (0.1, 0.5, 0.93):
                q = v[order][np.searchsorted(np.cumsum(n[order]), share * 5000)]
                below, up_to = (x[:, f] < q).mean(), (x[:, f] <= q).mean()
                assert below - 1.0 / ranks <= share <= up_to + 1.0 / ranks


@pytest.mark.parametrize("bins", [16, 200])
def test_counts_of_large_and_small_nodes(monkeypatch, bins):
    """Counts of rows in the order of their nodes, large nodes by themselves."""
    rng = np.random.default_rng(5)
    x, y, w = rng.integers(0, bins, (3000, 4)).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.uint8), rng.integers(1, 4, 3000)
    slot, columns = np.minimum(rng.geometric(0.4, 3000) - 1, 5), np.array([sorted(rng.permutation(4)[:2]) for _ in range(6)])
    monkeypatch.setattr(fo, "MANY", 300)
    order, starts = fo.by_node(slot, 6)
    got = fo.counts(fo.coded(x, y, bins), w[order].astype(float), order, starts, columns, bins)
    want = np.zeros((6, 2, bins, 2), np.int64)
    for i in range(3000):
        for j in range(2):
            want[slot[i], j, x[i, columns[slot[i], j]], y[i]] += w[i]
    assert np.array_equal(got, want)
