"""op7 against brute force in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from aerolens.llm import op7_topk as tk

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    v = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(x)) for x in e]
        v[i] = min(v.get(i, q), q)
    out = []
    for i in v:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[i], w)), j) for j, w in v.items() if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 40)])
def test_equals_brute_force(spark, blocks):
    rng = random.Random(1)
    rows = [(i, [f32(rng.gauss(0, 0.15)) for _ in range(40)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]                      # ties: one vector many times
    rows += [(2000, None), (2050, [None, 1.0]), (2100, [float("nan")]), (2150, [float("inf")]), (2200, []), (2201, [1.5]), (None, [1.0]),
             (3, rows[3][1]), (50, [f32(9.0)] * 40)]                        # repeated ids
    df = spark.createDataFrame([(i, e, "x") for i, e in rows], SCHEMA)
    got = sorted(map(tuple, tk.top_k(df, query_block=blocks[0], candidate_block=blocks[1]).collect()))
    assert got == brute(rows)


def test_huge_components(spark):
    rows = [(0, [f32(3e6), 1.0]), (1, [f32(3e6), 2.0]), (2, [f32(-3e6), 5.0]), (3, [0.0, f32(3e7)])]
    got = sorted(map(tuple, tk.top_k(spark.createDataFrame([(i, e, "x") for i, e in rows], SCHEMA)).collect()))
    assert got == brute(rows)


def test_pruning_drops_candidates_and_keeps_the_best():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 3, (3000, 64)) * np.exp(-np.arange(64) / 8))
    q = np.floor(rng.normal(0, 3, (20, 64)) * np.exp(-np.arange(64) / 8))
    got = tk.top_of_block(q, np.arange(20) - 100, x, np.arange(3000), 5)
    s = q @ x.T
    assert [g[2] for g in got] == [int(v) for row in s for v in np.sort(row)[::-1][:5]]


def test_empty_table(spark):
    assert tk.top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert tk.top_k(spark.createDataFrame([(50, [1.0], "x")], SCHEMA)).collect() == []
