"""Local outlier factor, novelty mode (M7; Breunig et al. 2000).

The reference set is a capped repeatable sample of clean rows (50k by
default; a cap is required).  Its neighbours are found in blocks: every task
holds one block of query rows and one of reference rows, and the k nearest of
each row are merged per row.  k-distances and local reachability densities
are columns of a DataFrame, made by joins on the neighbour ids.  The finished
model (rows, k-distance, density) is bounded by the cap and broadcast for
scoring, an exact search (``knn``) for SCORED rows at a time, whose tiles are the
tighter the more there are.  score = -mean(lrd(o) / lrd(x)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from aerolens.operators.models import knn
from aerolens.session import ship_package

BLOCK = 4096     # reference rows per block
SCORED = 1 << 16 # rows scored at once


def model_table(ref: DataFrame, feature_cols, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(id, x, kdist, lrd) of the reference rows ``ref``."""
    spark = ref.sparkSession
    ship_package(spark)
    x = F.array(*[F.col(c).cast("double") for c in feature_cols])
    rows = ref.select(x.alias("x")).withColumn("id", F.monotonically_increasing_id()).persist()
    m = rows.count()
    if m < 2:
        raise ValueError("LOF needs at least two reference rows")
    k, blocks = min(k, m - 1), -(-m // block)
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    side = lambda q, r, is_q: rows.select(q.alias("qb"), r.alias("rb"), F.lit(is_q).alias("q"), "id", "x")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = side(mine, every, True).union(side(every, mine, False))
    schema = "id long, nbr long, dist double"

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["q"]], pdf[~pdf["q"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"id": [], "nbr": [], "dist": []})
        r = r.sort_values("id")
        ids, rid = q["id"].to_numpy(), r["id"].to_numpy()
        row, col, dist = knn.Reference(np.vstack(r["x"].to_numpy())).nearest(np.vstack(q["x"].to_numpy()), k, pd.Index(rid).get_indexer(ids))
        return pd.DataFrame({"id": ids[row], "nbr": rid[col], "dist": dist})

    found = both.groupBy("qb", "rb").applyInPandas(near, schema)     # at most two blocks of rows a group
    nearest = Window.partitionBy("id").orderBy("dist", "nbr")
    near_k = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).persist()
    kdist = near_k.groupBy("id").agg(F.max("dist").alias("kdist"))
    reach = near_k.join(kdist.select(F.col("id").alias("nbr"), F.col("kdist").alias("kd")), "nbr")
    lrd = reach.groupBy("id").agg((1.0 / (F.avg(F.greatest("kd", "dist")) + 1e-10)).alias("lrd"))
    return rows.join(kdist, "id").join(lrd, "id").select("id", "x", "kdist", "lrd")


def fit_lof(spark, ref: DataFrame, feature_cols, k: int = 20):
    """Returns model arrays (R, k_distance, lrd, k), bounded by the sample's cap."""
    rows = model_table(ref, feature_cols, k).orderBy("id").collect()
    return (np.array([r["x"] for r in rows], dtype=float), np.array([r["kdist"] for r in rows]),
            np.array([r["lrd"] for r in rows]), min(k, len(rows) - 1))


def _scores(X: np.ndarray, reference: knn.Reference, kd: np.ndarray, lrd: np.ndarray, k: int) -> np.ndarray:
    row, col, dist = reference.nearest(X, k)
    n = np.bincount(row, minlength=len(X)).astype(float)
    with np.errstate(invalid="ignore"):                # a row with a value that is no number has no score
        own = 1.0 / (np.bincount(row, np.maximum(kd[col], dist), len(X)) / n + 1e-10)
        return -np.bincount(row, lrd[col], len(X)) / n / own


def score_column(spark, R, kd, lrd, k: int, feature_cols) -> F.Column:
    ship_package(spark)
    bc = spark.sparkContext.broadcast((knn.Reference(R), kd, lrd, min(k, len(R))))

    @F.pandas_udf(T.DoubleType())
    def lof_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        def scored(held):
            out = _scores(np.concatenate(held), *bc.value)
            for part in np.split(out, np.cumsum([len(h) for h in held])[:-1]):
                yield pd.Series(part)

        held = []
        for cols in batches:
            held.append(np.column_stack([c.to_numpy(dtype=float) for c in cols]))
            if sum(map(len, held)) >= SCORED:
                yield from scored(held)
                held = []
        if held:
            yield from scored(held)

    return lof_score(*[F.col(c).cast("double") for c in feature_cols])
