"""Isolation forest as a Spark job (M6; Liu, Ting, Zhou 2008).

Training: each tree needs ``psi`` = min(max_samples, n) random clean rows.
Rows are drawn by seeded hashes (no driver sampling), about 2 psi candidates
per tree: from a large table a row is kept with a small probability and sent
to one hashed tree, from a small one every pair of row and tree is drawn by
itself (all pairs if the table has at most 2 psi rows).  Per tree exactly the
``psi`` candidates with the smallest hash are kept, all different rows.  Trees are grown in
parallel with ``groupBy(tree_id).applyInPandas`` (one small group per tree).

Scoring: the forest (n_trees x at most 2 psi - 1 nodes, bounded by the two
parameters) is broadcast and a vectorised pandas UDF walks all trees over
Arrow batches.  score = -2 ** (-E[h(x)] / c(psi)); lower = more anomalous.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from aerolens.operators.models.sampling import row_hash
from aerolens.session import ship_package

EULER_GAMMA = 0.5772156649015329
TREE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("size", T.ArrayType(T.IntegerType())),
])


def average_path_length(n) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    feature, threshold, left, right, size = [], [], [], [], []

    def new(n):
        feature.append(-1); threshold.append(0.0); left.append(-1); right.append(-1); size.append(n)
        return len(feature) - 1

    root = new(len(X))
    stack = [(root, np.arange(len(X)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if depth >= max_depth or len(idx) <= 1:
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        # random feature among the non-constant ones, uniform split point
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= thr
        li, ri = idx[go_left], idx[~go_left]
        if li.size == 0 or ri.size == 0:
            continue
        ln, rn = new(li.size), new(ri.size)
        feature[node], threshold[node], left[node], right[node] = f, thr, ln, rn
        stack.append((ln, li, depth + 1))
        stack.append((rn, ri, depth + 1))
    return feature, threshold, left, right, size


def fit_forest(train: DataFrame, feature_cols, n_trees: int = 150, max_samples: int = 256,
               seed: int = 42, sample_only: bool = False) -> tuple[DataFrame, int]:
    """Returns (trees DataFrame with TREE_SCHEMA, psi); with ``sample_only`` the drawn rows instead."""
    ship_package(train.sparkSession)
    n = train.count()
    if n == 0:
        raise ValueError("no training rows for isolation_forest")
    psi = int(min(max_samples, n))
    scale = float(1 << 30)
    h = row_hash(train, seed)
    u = lambda c: F.pmod(c, F.lit(1 << 30)).cast("double") / F.lit(scale)
    feats = F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("x")
    rows = train.select(h.alias("_h"), feats)
    if n > 4 * psi * n_trees:
        kept = rows.filter(u(F.col("_h")) < F.lit(2.0 * psi * n_trees / n))
        trees = F.array(F.pmod(F.xxhash64(F.col("_h"), F.lit(seed + 1)), F.lit(n_trees)).cast("int"))
    else:
        kept, p = rows, min(1.0, 2.0 * psi / n)
        trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                         lambda j: F.lit(p >= 1.0) | (u(F.xxhash64(F.col("_h"), j, F.lit(seed + 1))) < F.lit(p)))
    cand = kept.select("x", F.explode(trees).alias("tree_id"), "_h") \
        .withColumn("_rk", F.xxhash64(F.col("_h"), F.col("tree_id"), F.lit(seed + 2)))
    w = Window.partitionBy("tree_id").orderBy("_rk", "_h")
    chosen = cand.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= psi)
    if sample_only:
        return chosen.select("tree_id", "_h"), psi
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        X = np.vstack(pdf["x"].to_numpy()).astype(float)
        rng = np.random.default_rng([seed, tid])
        fe, th, le, ri, sz = _grow(X, rng, max_depth)
        return pd.DataFrame({"tree_id": [tid], "feature": [fe], "threshold": [th],
                             "left": [le], "right": [ri], "size": [sz]})

    forest = chosen.select("tree_id", "x").groupBy("tree_id").applyInPandas(build, TREE_SCHEMA)
    return forest, psi


def forest_arrays(forest: DataFrame) -> list[tuple]:
    """Trees as numpy arrays (bounded: n_trees x < 2 psi nodes)."""
    out = []
    for r in forest.orderBy("tree_id").collect():
        out.append((np.array(r["feature"], dtype=np.int64), np.array(r["threshold"], dtype=float),
                    np.array(r["left"], dtype=np.int64), np.array(r["right"], dtype=np.int64),
                    np.array(r["size"], dtype=float)))
    return out


def path_lengths(X: np.ndarray, trees) -> np.ndarray:
    m = X.shape[0]
    total = np.zeros(m)
    rows = np.arange(m)
    for fe, th, le, ri, sz in trees:
        node = np.zeros(m, dtype=np.int64)
        depth = np.zeros(m)
        while True:
            f = fe[node]
            inner = f >= 0
            if not inner.any():
                break
            x = X[rows, np.maximum(f, 0)]
            nxt = np.where(x <= th[node], le[node], ri[node])
            node = np.where(inner, nxt, node)
            depth += inner
        total += depth + average_path_length(sz[node])
    return total / max(len(trees), 1)


def score_column(spark, trees, psi: int, feature_cols) -> F.Column:
    ship_package(spark)
    bc = spark.sparkContext.broadcast((trees, psi))

    @F.pandas_udf(T.DoubleType())
    def iforest_score(*cols: pd.Series) -> pd.Series:
        tr, ps = bc.value
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        h = path_lengths(X, tr)
        cpsi = float(average_path_length([ps])[0]) or 1.0
        return pd.Series(-np.power(2.0, -h / cpsi))

    return iforest_score(*[F.col(c).cast("double") for c in feature_cols])
