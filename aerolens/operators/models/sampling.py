"""Repeatable subsampling and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_hash(df: DataFrame, seed: int, cols=None) -> F.Column:
    """Deterministic per-row hash (independent of partitioning)."""
    cols = cols or [c for c in ("replicate", "case_id", "row_idx", "_ord") if c in df.columns]
    if not cols:
        cols = df.columns
    return F.xxhash64(*[F.col(c) for c in cols], F.lit(int(seed)))


def subsample(df: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if fewer).

    The rows with the ``n`` smallest seeded hashes, so the same rows come back
    on every run and after any recomputation.  The n-th hash is found from a
    histogram of the upper hash bits and the hashes of one of its 65,536
    bins; the rows themselves are filtered where they are and keep their
    partitions.  Rows that tie at the n-th hash (repeated keys) are cut off in
    any order.
    """
    if not n:
        return df
    n = int(n)
    total = df.count()
    if total <= n:
        return df
    hashed = df.withColumn("_h", row_hash(df, seed))
    upper = F.shiftright("_h", 48)
    left = n
    for r in hashed.groupBy(upper.alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect():
        if r["c"] >= left:
            break
        left -= r["c"]
    # the ``left`` smallest hashes of bin b: about n / 65,536 of them
    low = [x[0] for x in hashed.where(upper == r["b"]).select("_h").orderBy("_h").limit(left).collect()]
    cut = low[-1]
    sure = hashed.where(F.col("_h") < F.lit(cut)).drop("_h")
    at_cut = low.count(cut)
    return sure.union(hashed.where(F.col("_h") == F.lit(cut)).limit(at_cut).drop("_h"))


def class_weights(df: DataFrame, label_col: str = "label", mode: str = "balanced") -> dict:
    """Balanced weights n / (2 n_c), or 'pos_ratio' (neg/pos on positives).

    One tiny aggregate (two rows) is read on the driver.
    """
    counts = {r[label_col]: r["n"] for r in
              df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()
              if r[label_col] is not None}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if mode == "balanced":
        tot = n0 + n1
        return {0: tot / (2.0 * n0) if n0 else 1.0, 1: tot / (2.0 * n1) if n1 else 1.0}
    if mode == "pos_ratio":
        return {0: 1.0, 1: (n0 / n1) if n1 else 1.0}
    if mode in (None, "none"):
        return {0: 1.0, 1: 1.0}
    raise ValueError(f"unknown weight mode {mode}")


def weight_column(weights: dict, label_col: str = "label") -> F.Column:
    return F.when(F.col(label_col) == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))


def class_weight_table(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A17 as a table: label, n, balanced weight n/(2 n_c), neg/pos weight."""
    from pyspark.sql import Window
    c = (df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
           .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(F.lit(1))          # at most two rows (label 0 / 1)
    tot = F.sum("n").over(w)
    n0 = F.sum(F.when(F.col(label_col) == 0, F.col("n"))).over(w)
    n1 = F.sum(F.when(F.col(label_col) == 1, F.col("n"))).over(w)
    return c.select(label_col, "n",
                    (tot.cast("double") / (F.lit(2.0) * F.col("n"))).alias("w_balanced"),
                    F.when(F.col(label_col) == 1,
                           F.when(n1 > 0, n0.cast("double") / n1).otherwise(F.lit(1.0)))
                     .otherwise(F.lit(1.0)).alias("w_pos_ratio"))
