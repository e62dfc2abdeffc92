"""One-class SVM, approximated (M8; Schoelkopf et al. 2001, Rahimi & Recht 2007).

The RBF kernel (gamma 'scale' = 1 / (d * var(X))) is replaced by ``D``
random Fourier features; the linear one-class objective

    min_w,rho  1/2 |w|^2 + 1/(nu n) sum max(0, rho - w.z_i) - rho

is solved by subgradient descent whose sums are distributed Spark
aggregations: the sample is dealt over at most PARTS tasks, each returns one partial sum.
Only (W, b, w, rho) — D x (d + 2) numbers — is the model.  The training
set is the capped sample of clean rows.  score = w.z(x) - rho; lower =
more anomalous.  An approximation: rankings, not values, match an exact SVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from aerolens.session import ship_package


PARTS = 32              # most tasks of a gradient pass, and so partial sums that come back
ROWS_PER_PART = 1500


def _rff(X, W, b):
    D = W.shape[1]
    return np.sqrt(2.0 / D) * np.cos(X @ W + b)


def fit_ocsvm(spark, train: DataFrame, feature_cols, nu: float = 0.05, gamma="scale",
              n_components: int = 256, iters: int = 80, lr: float = 1.0, seed: int = 42):
    ship_package(spark)
    d = len(feature_cols)
    x = train.select(F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("x")).persist()
    st = x.select(F.explode("x").alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("m"),
                                                  F.var_pop("v").alias("var")).first()
    if not st["n"]:
        raise ValueError("no training rows for one_class_svm")
    n = st["n"] // d
    sample, x = x, x.repartition(max(1, min(PARTS, n // ROWS_PER_PART))).persist()
    if gamma == "scale":
        gamma = 1.0 / (d * st["var"]) if st["var"] and st["var"] > 0 else 1.0
    elif gamma == "auto":
        gamma = 1.0 / d
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, n_components))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_components)
    w = np.zeros(n_components)
    rho = 0.0
    schema = T.StructType([T.StructField("g", T.ArrayType(T.DoubleType())),
                           T.StructField("c", T.LongType())])
    for t in range(1, iters + 1):
        bc = spark.sparkContext.broadcast((W, b, w, rho))

        def part(it, bc=bc):
            WW, bb, ww, rr = bc.value
            g = np.zeros(WW.shape[1])
            c = 0
            for pdf in it:
                if len(pdf) == 0:
                    continue
                Z = _rff(np.vstack(pdf["x"].to_numpy()), WW, bb)
                v = (Z @ ww) < rr
                g += Z[v].sum(axis=0)
                c += int(v.sum())
            yield pd.DataFrame({"g": [g.tolist()], "c": [c]})

        parts = x.mapInPandas(part, schema).collect()
        bc.unpersist()
        g = np.sum([np.array(r["g"]) for r in parts], axis=0)
        c = sum(r["c"] for r in parts)
        eta = lr / np.sqrt(t)
        w = w - eta * (w - g / (nu * n))
        rho = rho - eta * (c / (nu * n) - 1.0)
    x.unpersist()
    sample.unpersist()
    return W, b, w, float(rho)


def score_column(spark, W, b, w, rho, feature_cols) -> F.Column:
    ship_package(spark)
    bc = spark.sparkContext.broadcast((W, b, w, rho))

    @F.pandas_udf(T.DoubleType())
    def ocsvm_score(*cols: pd.Series) -> pd.Series:
        WW, bb, ww, rr = bc.value
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(_rff(X, WW, bb) @ ww - rr)

    return ocsvm_score(*[F.col(c).cast("double") for c in feature_cols])
