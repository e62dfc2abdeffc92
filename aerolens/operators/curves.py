"""Score curves and thresholds.

All of them need, for each distinct score s, the number of positives and
negatives scoring at most s.  That prefix sum is computed without a global
window (which would pull every row into one task):

1. ``groupBy(score)`` -> distinct scores with (pos, neg) counts;
2. range buckets from approximate quantiles of the distinct scores
   (``percentile_approx`` -> cut points -> ``Bucketizer``, binary search in
   the JVM); the number of buckets grows with the number of distinct scores;
3. running sums inside each bucket (a window partitioned by bucket);
4. per-bucket totals (one row per bucket) -> exclusive prefix -> broadcast
   join back (its size is the bucket count, a bound we choose).

The result is exact; the quantiles only balance the work.  Building the
table reads the input twice (cut points, then the sums): persist a scored
input that is expensive to recompute.

Direction ``high``: alert when score >= t (supervised probabilities);
``low``: alert when score <= t (unsupervised scores, low = anomalous).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from aerolens.schema import F1_EPS

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 100_000
CUT_GRID = 1024        # cut points fetched with the count (finer grids on demand)


def score_table(df: DataFrame, score_col: str, label_col: str = "label",
                direction: str = "high", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per distinct score: threshold, pos, neg, tp, fp, P, N.

    tp / fp = positives / negatives that alert at this threshold (score >= t
    for ``high``, score <= t for ``low``).  Rows with a missing label or
    score are ignored.
    """
    if direction not in ("high", "low"):
        raise ValueError(f"direction must be 'high' or 'low', got {direction!r}")
    sign = 1.0 if direction == "high" else -1.0
    sc = F.nanvl(F.col(score_col).cast("double"), F.lit(None).cast("double"))
    lab = F.col(label_col)
    g = (df.filter(lab.isNotNull() & sc.isNotNull())
           .groupBy((sc * F.lit(sign)).alias("_s"))
           .agg(F.count_if(lab == 1).alias("pos"), F.count_if(lab == 0).alias("neg")))
    g = _with_prefix(g, rows_per_bucket)
    # alerting at s (in the signed space, value >= s): everything not below s
    return g.select(
        (F.col("_s") * F.lit(sign)).alias("threshold"), "pos", "neg",
        (F.col("P") - F.col("pos_le") + F.col("pos")).alias("tp"),
        (F.col("N") - F.col("neg_le") + F.col("neg")).alias("fp"),
        "P", "N", "pos_le", "neg_le")


def _with_prefix(g: DataFrame, rows_per_bucket: int, keys=()) -> DataFrame:
    """Add pos_le / neg_le (inclusive prefix in ``_s`` order) and totals P, N.

    With ``keys`` the prefix restarts per key (e.g. per flight): buckets come
    from global cut points, running sums run per (key, bucket), and the
    per-key bucket offsets are a keyed table joined back (AQE chooses the
    join); a key with many distinct values spreads over many buckets.
    """
    keys = list(keys)
    # one action: row count of the distinct-value table + candidate cut points
    # (no cache is left behind; persist an expensive scored input upstream)
    probs = [i / CUT_GRID for i in range(1, CUT_GRID)]
    st = g.agg(F.count(F.lit(1)).alias("n"),
               F.percentile_approx("_s", probs, 10_000).alias("c")).first()
    n = st["n"]
    buckets = max(1, min(MAX_BUCKETS, math.ceil(n / max(1, rows_per_bucket))))
    if buckets > 1:
        grid = st["c"] or []
        if buckets >= CUT_GRID:
            probs = [i / buckets for i in range(1, buckets)]
            grid = g.agg(F.percentile_approx("_s", probs, 10_000).alias("c")).first()["c"] or []
        else:
            step = len(grid) / buckets
            grid = [grid[min(len(grid) - 1, int(round(i * step)) - 1)] for i in range(1, buckets)]
        splits = [-math.inf] + sorted(set(float(c) for c in grid)) + [math.inf]
        g = g.withColumn("_sb", F.coalesce(F.col("_s"), F.lit(-math.inf)))
        g = Bucketizer(splits=splits, inputCol="_sb", outputCol="_bk").transform(g).drop("_sb")
    else:
        g = g.withColumn("_bk", F.lit(0.0))
    wb = Window.partitionBy(*keys, "_bk").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumns({"_pin": F.sum("pos").over(wb), "_nin": F.sum("neg").over(wb)})
    tot = g.groupBy(*keys, "_bk").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wt = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*(keys or [F.lit(1)]))
    off = tot.select(*[F.col(k).alias("_k_" + k) for k in keys], F.col("_bk").alias("_k_bk"),
                     F.coalesce(F.sum("_bp").over(wt), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(wt), F.lit(0)).alias("_on"),
                     F.sum("_bp").over(wall).alias("P"), F.sum("_bn").over(wall).alias("N"))
    cond = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys] + [F.col("_bk") == F.col("_k_bk")]
    if not keys:
        # the bucket table has at most MAX_BUCKETS rows: a single-partition
        # window and a broadcast are bounded by construction
        off = F.broadcast(off)
    g = g.join(off, cond)
    return g.select(*keys, "_s", "pos", "neg", (F.col("_op") + F.col("_pin")).alias("pos_le"),
                    (F.col("_on") + F.col("_nin")).alias("neg_le"), "P", "N")


def _ratio(a, b):
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def roc_curve(df: DataFrame, score_col: str, label_col: str = "label",
              direction: str = "high", start: bool = True, **kw) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; with ``start`` also
    the point (0, 0) where nothing is flagged, its threshold NULL."""
    t = score_table(df, score_col, label_col, direction, **kw)
    points = t.select("threshold", _ratio(F.col("fp"), F.col("N")).alias("fpr"),
                      _ratio(F.col("tp"), F.col("P")).alias("tpr"))
    if not start:
        return points
    origin = df.sparkSession.range(1).select(F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def roc_auc(df: DataFrame, score_col: str, label_col: str = "label",
            direction: str = "high", **kw) -> DataFrame:
    """Area under ROC (ties count one half), one row ``auc``.

    AUC = sum over scores of neg(s) * (positives ranked above s + pos(s)/2) / (P N).
    """
    t = score_table(df, score_col, label_col, direction, **kw)
    above = F.col("P") - F.col("pos_le")             # positives strictly beyond s
    a = t.agg(F.sum(F.col("neg") * (above.cast("double") + F.col("pos") / F.lit(2.0))).alias("u"),
              F.first("P").alias("P"), F.first("N").alias("N"))
    return a.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                           F.col("u") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))


def pr_curve(df: DataFrame, score_col: str, label_col: str = "label",
             direction: str = "high", **kw) -> DataFrame:
    """A14 curve: (threshold, precision, recall, f1) for every distinct score.

    recall = 1 everywhere when there is no positive (like the reference's
    library); f1 = 2PR / (P + R + 1e-12).
    """
    t = score_table(df, score_col, label_col, direction, **kw)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P").cast("double"))
    f1 = F.lit(2.0) * p * r / (p + r + F.lit(F1_EPS))
    return t.select("threshold", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def max_f1_threshold(df: DataFrame, score_col: str, label_col: str = "label",
                     direction: str = "high", default: float = 0.5, **kw) -> DataFrame:
    """Threshold of maximal F1; ties -> the lowest threshold (first in
    ascending order).  No threshold at all -> ``default`` (0.5)."""
    c = pr_curve(df, score_col, label_col, direction, **kw)
    key = F.struct(F.col("f1"), -F.col("threshold"))
    best = c.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"), key).alias("b"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(float(default))).alias("threshold"),
                       F.col("b.f1").alias("f1"), F.col("b.precision").alias("precision"),
                       F.col("b.recall").alias("recall"))


def average_precision(df: DataFrame, score_col: str, label_col: str = "label",
                      direction: str = "high", **kw) -> DataFrame:
    """AP = sum over thresholds of (recall step) * precision, one row ``ap``."""
    t = score_table(df, score_col, label_col, direction, **kw)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    a = t.agg(F.sum(F.col("pos") * p).alias("s"), F.first("P").alias("P"))
    return a.select(F.when(F.col("P") > 0, F.col("s") / F.col("P")).otherwise(F.lit(0.0)).alias("ap"))


def percentile_threshold(df: DataFrame, score_col: str, percent: float = 2.0,
                         exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """The ``percent``-th percentile of the scores (linear interpolation).

    ``exact=True`` finds the two order statistics through the distributed
    prefix table (no value buffer per group) and also returns the minimum
    and maximum (``min_value``, ``max_value``); ``exact=False`` uses
    ``percentile_approx``.
    """
    q = float(percent) / 100.0
    sc = F.nanvl(F.col(score_col).cast("double"), F.lit(None).cast("double"))
    if not exact:
        return df.agg(F.percentile_approx(sc, q, accuracy).cast("double").alias("threshold"))
    g = df.filter(sc.isNotNull()).groupBy(sc.alias("_s")).agg(
        F.count(F.lit(1)).alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    t = _with_prefix(g, ROWS_PER_BUCKET)
    # order statistics are 0-based ranks; score s covers ranks [pos_le-pos, pos_le)
    k = F.lit(q) * (F.col("P") - F.lit(1)).cast("double")
    lo, hi = F.floor(k), F.ceil(k)
    cover = lambda r: (F.col("pos_le") - F.col("pos") <= r) & (r < F.col("pos_le"))
    a = t.agg(F.max(F.when(cover(lo), F.col("_s"))).alias("vlo"),
              F.max(F.when(cover(hi), F.col("_s"))).alias("vhi"),
              F.max(k - lo).alias("frac"),
              F.min("_s").alias("min_value"), F.max("_s").alias("max_value"))
    return a.select((F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("threshold"),
                    "min_value", "max_value")


def curve_summary(df: DataFrame, score_col: str, label_col: str = "label",
                  direction: str = "high", **kw) -> DataFrame:
    """AUC, average precision and the max-F1 threshold from ONE score table
    (one prefix-sum pass instead of one per metric); one row."""
    t = score_table(df, score_col, label_col, direction, **kw)
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.when(F.col("P") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("P").cast("double"))
    f1 = F.lit(2.0) * p * r / (p + r + F.lit(F1_EPS))
    above = F.col("P") - F.col("pos_le")
    c = t.select("threshold", "pos", "neg", "P", "N", above.alias("above"), p.alias("prec"),
                 f1.alias("f1"))
    a = c.agg(F.sum(F.col("neg") * (F.col("above").cast("double") + F.col("pos") / F.lit(2.0))).alias("u"),
              F.sum(F.col("pos") * F.col("prec")).alias("ap_s"),
              F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"),
              F.first("P").alias("P"), F.first("N").alias("N"))
    return a.select(
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.col("u") / (F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.when(F.col("P") > 0, F.col("ap_s") / F.col("P")).otherwise(F.lit(0.0)).alias("ap"),
        F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("max_f1_threshold"),
        F.col("b.f1").alias("max_f1"))


def grouped_percentile(df: DataFrame, keys, value_col: str, percent: float = 50.0,
                       out_col: str = "percentile",
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact per-group percentile (linear interpolation), one row per group.

    Built on the keyed prefix table, so a group with a huge number of
    distinct values is spread over many buckets instead of one buffer.  A
    group with no value gives NULL (it still has a row).
    """
    keys = list(keys)
    q = float(percent) / 100.0
    sc = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    g = df.groupBy(*keys, sc.alias("_s")).agg(
        F.count(sc).alias("pos"), F.lit(0).cast("bigint").alias("neg"))
    t = _with_prefix(g, rows_per_bucket, keys)
    k = F.lit(q) * (F.col("P") - F.lit(1)).cast("double")
    lo, hi = F.floor(k), F.ceil(k)
    cover = lambda r: (F.col("pos") > 0) & (F.col("pos_le") - F.col("pos") <= r) & (r < F.col("pos_le"))
    a = t.groupBy(*keys).agg(F.max(F.when(cover(lo), F.col("_s"))).alias("vlo"),
                             F.max(F.when(cover(hi), F.col("_s"))).alias("vhi"),
                             F.max(k - lo).alias("frac"))
    return a.select(*keys, (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias(out_col))
