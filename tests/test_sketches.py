"""Mergeable quantile sketches: rank error, retried batches, small and empty keys."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import sketches as sk


def test_rank_error_over_batches(spark):
    rng = np.random.default_rng(7)
    v = rng.lognormal(size=40_000)
    df = spark.createDataFrame([(i % 8, float(x)) for i, x in enumerate(v)], "b int, v double").persist()
    path = tempfile.mkdtemp(prefix="aerolens-sketch-")
    for i in (0, 1, 2, 3, 3, 4, 5, 6, 7, 0):                     # two batches run again
        sk.store_batch(df.where(F.col("b") == i), "v", path, i, k=400)
        if i == 1:                                               # up to date after every batch
            assert sk.read_merged(spark, path).first()["n"] == 10_000
    m = sk.read_merged(spark, path)
    assert m.first()["n"] == len(v)
    for q in (0.02, 0.5, 0.9):
        got = sk.quantile(m, q).first()["quantile"]
        assert abs((v <= got).mean() - q) <= 2 * sk.rank_error(400)
    df.unpersist()


def test_small_missing_and_empty_keys(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None), ("b", float("nan")), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["quantile"]) for r in sk.quantile(sk.sketch(df, "v", ["g"]), 0.5).collect()}
    assert got == {"a": (3, 2.0), "b": (0, None), None: (1, 5.0)}
    whole = sk.merge(sk.sketch(df, "v", ["g"]))
    assert sk.quantile(whole, 1.0).first()["quantile"] == 5.0
    assert sk.quantile(sk.sketch(df.limit(0), "v"), 0.5).first()["quantile"] is None
    with pytest.raises(ValueError):
        sk.quantile(whole, 1.5)
