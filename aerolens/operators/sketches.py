"""Quantiles that are kept up to date batch by batch (A3, A16): mergeable KLL sketches beside the rows.

The exact percentile reads all scores again whenever rows are added.  Here each
batch leaves one small sketch per key (Karnin, Lang, Liberty 2016), and the
sketches of all batches are merged when a quantile is asked for.  A batch that
runs again replaces its own sketches, so retries count once.

The rank of an answer differs from the exact one by at most ``rank_error(k)``
of the rows with 99 % confidence, however many batches are merged; a key of
fewer than k values is answered exactly.  Missing and NaN values are left out,
and a key without values has a NULL quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DEFAULT_K = 1600         # 0.3 % of rank; a sketch then takes some 40 KB at most


def rank_error(k: int = DEFAULT_K) -> float:
    """Error of a rank as a share of the rows, at 99 % confidence (the sketch's published fit)."""
    return 2.296 / k ** 0.9021


def sketch(df: DataFrame, value_col: str, keys=(), k: int = DEFAULT_K) -> DataFrame:
    """(keys, n, sketch) of the values; partial sketches are merged, so a hot key is no hot task."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.kll_sketch_agg_double(v, F.lit(int(k))).alias("sketch"))


def merge(sketches: DataFrame, keys=()) -> DataFrame:
    """One sketch per key of all those in ``sketches``."""
    return sketches.where(F.col("n") > 0).groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def store_batch(df: DataFrame, value_col: str, path: str, batch_id: int, keys=(), k: int = DEFAULT_K) -> None:
    """Write the sketches of one batch below ``path``; the same batch again takes their place.

    Fits ``foreachBatch``: ``lambda d, i: store_batch(d, "ml_score", path, i)``.
    """
    sketch(df, value_col, keys, k).write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")


def read_merged(spark: SparkSession, path: str, keys=()) -> DataFrame:
    """The merged sketches of all stored batches."""
    return merge(spark.read.parquet(path), keys)


def quantile(sketches: DataFrame, q: float, name: str = "quantile") -> DataFrame:
    """Adds the value at rank share ``q`` (0 to 1)."""
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"q must be between 0 and 1, not {q}")
    return sketches.withColumn(name, F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))))
