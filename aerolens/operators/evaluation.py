"""Labelled evaluation.

Everything that depends on (layer alert, label, tamper_type, profile) is
derived from one small cube: a single scan with partial aggregation,
``groupBy(tamper_type, profile, label)`` with per-layer hit counts.  Global,
per-scenario and per-profile tables are then cheap aggregates of the cube
(at most a few hundred rows), whatever the input size.

Ratios: precision = TP/(TP+FP), recall = TP/(TP+FN), F1 = 2PR/(P+R); 0 when
undefined.  Rows with a missing label are not counted in confusion counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from aerolens.schema import DEFAULT_FLIGHT_KEYS, LAYER_COLUMNS, PROFILES, ORDER_COLUMNS

DEFAULT_LAYERS = dict(LAYER_COLUMNS)   # alert column -> display name


def _layers(df: DataFrame, layers: Mapping[str, str] | None) -> dict[str, str]:
    if layers is None:
        layers = {c: n for c, n in DEFAULT_LAYERS.items() if c in df.columns}
    missing = [c for c in layers if c not in df.columns]
    if missing:
        raise ValueError(f"Missing alert columns: {missing}")
    if not layers:
        raise ValueError("No layer columns to evaluate")
    return dict(layers)


def _hit(col: str) -> Column:
    return F.coalesce(F.col(col).cast("boolean"), F.lit(False)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ cube
def evaluation_cube(df: DataFrame, layers: Mapping[str, str] | None = None) -> DataFrame:
    """(tamper_type, profile, label, n, hits_<col>...) — one pass, tiny output."""
    lay = _layers(df, layers)
    aggs = [F.count(F.lit(1)).alias("n")] + \
        [F.sum(_hit(c)).cast("bigint").alias(f"hits_{c}") for c in lay]
    return df.groupBy("tamper_type", "profile", "label").agg(*aggs)


def confusion(df: DataFrame, alert_col: str) -> DataFrame:
    """One row TP, FP, TN, FN, precision, recall, f1 for one alert column."""
    a = _hit(alert_col) == 1
    lab = F.col("label")
    c = df.agg(
        F.count_if(a & (lab == 1)).alias("TP"), F.count_if(a & (lab == 0)).alias("FP"),
        F.count_if(~a & (lab == 0)).alias("TN"), F.count_if(~a & (lab == 1)).alias("FN"))
    p = safe_div(F.col("TP"), F.col("TP") + F.col("FP"))
    r = safe_div(F.col("TP"), F.col("TP") + F.col("FN"))
    return c.select("TP", "FP", "TN", "FN", p.alias("precision"), r.alias("recall"),
                    f1_of(p, r).alias("f1"))


def global_metrics(df: DataFrame, layers: Mapping[str, str] | None = None,
                   cube: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """One row per layer: layer, TP, FP, FN, TN, precision, recall, F1."""
    lay = _layers(df, layers)
    cube = evaluation_cube(df, lay) if cube is None else cube
    lab = F.col("label")
    aggs = []
    for c in lay:
        h, n = F.col(f"hits_{c}"), F.col("n")
        aggs += [F.sum(F.when(lab == 1, h).otherwise(0)).alias(f"tp_{c}"),
                 F.sum(F.when(lab == 0, h).otherwise(0)).alias(f"fp_{c}"),
                 F.sum(F.when(lab == 1, n - h).otherwise(0)).alias(f"fn_{c}"),
                 F.sum(F.when(lab == 0, n - h).otherwise(0)).alias(f"tn_{c}")]
    tot = cube.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("_i"), F.lit(name).alias("layer"),
                     F.coalesce(F.col(f"tp_{c}"), F.lit(0)).cast("bigint").alias("TP"),
                     F.coalesce(F.col(f"fp_{c}"), F.lit(0)).cast("bigint").alias("FP"),
                     F.coalesce(F.col(f"fn_{c}"), F.lit(0)).cast("bigint").alias("FN"),
                     F.coalesce(F.col(f"tn_{c}"), F.lit(0)).cast("bigint").alias("TN"))
            for i, (c, name) in enumerate(lay.items())]
    out = tot.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    p = safe_div(F.col("TP"), F.col("TP") + F.col("FP"))
    r = safe_div(F.col("TP"), F.col("TP") + F.col("FN"))
    f = f1_of(p, r)
    if digits is not None:
        p, r, f = (F.bround(x, digits) for x in (p, r, f))
    return out.select("_i", "layer", "TP", "FP", "FN", "TN", p.alias("precision"),
                      r.alias("recall"), f.alias("F1")).orderBy("_i").drop("_i")


def rate_text(d: Column, n: Column) -> Column:
    """'d/n (p%)' with p rounded half-even like Python's format."""
    pct = F.bround(F.lit(100.0) * d.cast("double") / n.cast("double"), 0).cast("bigint")
    return F.concat(d.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("),
                    pct.cast("string"), F.lit("%)"))


def _per_group(cube: DataFrame, lay: dict, key: str) -> DataFrame:
    aggs = [F.sum("n").cast("bigint").alias("n")] + \
        [F.sum(f"hits_{c}").cast("bigint").alias(f"{c}_hits") for c in lay]
    g = cube.groupBy(key).agg(*aggs)
    cols = [key, "n"]
    for c in lay:
        cols += [F.col(f"{c}_hits"), safe_div(F.col(f"{c}_hits"), F.col("n")).alias(f"{c}_rate"),
                 rate_text(F.col(f"{c}_hits"), F.col("n")).alias(f"{c}_text")]
    return g.select(*cols)


def per_scenario(df: DataFrame, layers: Mapping[str, str] | None = None,
                 cube: DataFrame | None = None) -> DataFrame:
    """Detection rate per tamper_type other than 'normal' (all labels)."""
    lay = _layers(df, layers)
    cube = evaluation_cube(df, lay) if cube is None else cube
    sub = cube.filter(F.col("tamper_type") != "normal")
    return _per_group(sub, lay, "tamper_type").orderBy("tamper_type")


def per_profile(df: DataFrame, layers: Mapping[str, str] | None = None,
                cube: DataFrame | None = None, profiles=PROFILES) -> DataFrame:
    """A10: recall per profile on label = 1, fixed profile order, empty skipped."""
    lay = _layers(df, layers)
    cube = evaluation_cube(df, lay) if cube is None else cube
    sub = cube.filter((F.col("label") == 1) & F.col("profile").isin(list(profiles)))
    order = F.array_position(F.array(*[F.lit(p) for p in profiles]), F.col("profile"))
    return _per_group(sub, lay, "profile").orderBy(order)


def full_evaluation(df: DataFrame, layers: Mapping[str, str] | None = None):
    """(global, per_scenario, per_profile) from one cached cube."""
    lay = _layers(df, layers)
    cube = evaluation_cube(df, lay).cache()
    return (global_metrics(df, lay, cube), per_scenario(df, lay, cube),
            per_profile(df, lay, cube))


def operating_points(df: DataFrame, layers: Mapping[str, str] | None = None) -> DataFrame:
    """(layer, fpr, tpr) of binary layers."""
    g = global_metrics(df, layers)
    return g.select("layer", safe_div(F.col("FP"), F.col("FP") + F.col("TN")).alias("fpr"),
                    safe_div(F.col("TP"), F.col("TP") + F.col("FN")).alias("tpr"))


def crosstab(df: DataFrame, alert_col: str) -> DataFrame:
    """A5: alert x label counts (columns label_0, label_1)."""
    a = F.coalesce(F.col(alert_col).cast("boolean"), F.lit(False))
    return (df.groupBy(a.alias(alert_col))
              .agg(F.count_if(F.col("label") == 0).alias("label_0"),
                   F.count_if(F.col("label") == 1).alias("label_1")))


def alert_counts(df: DataFrame, layers: Mapping[str, str] | None = None) -> DataFrame:
    """Number of alerts per layer column (one row)."""
    lay = _layers(df, layers)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"n_{c}") for c in lay])


# ---------------------------------------------------------- dataset facts
def summarize(df: DataFrame) -> DataFrame:
    """A1: rows, distinct cases, sorted replicate list, anomaly count and %."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("case_id").alias("n_cases"),
        F.array_join(F.sort_array(F.collect_set("replicate")).cast("array<string>"), ",")
         .alias("replicates"),
        F.sum("label").cast("bigint").alias("n_anomalies"),
        (F.avg("label") * F.lit(100.0)).alias("anomaly_pct"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A2: counts per value, descending (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def sample_rate_per_case(df: DataFrame, flight_keys=DEFAULT_FLIGHT_KEYS,
                         approx: bool = False, accuracy: int = 10_000,
                         hot_rows: int | None = None) -> DataFrame:
    """A3: median time step (s) per flight; a one-row flight gives NULL.

    Exact by default: Spark's ``median`` when no flight is hot (its buffer is
    then bounded by the hot-row threshold), else the keyed, bucketed prefix
    table (no per-flight buffer, a huge flight spreads over many tasks);
    ``approx=True`` uses a fixed-size quantile sketch per flight instead.
    """
    from aerolens.operators import frames
    keys = list(flight_keys)
    staged, lay = frames.stage(df.select(*keys, *[c for c in ORDER_COLUMNS if c in df.columns],
                                         "timestamp"), keys, halo=1,
                               hot_rows=frames.HOT_ROWS if hot_rows is None else hot_rows)
    t = F.unix_micros(F.col("timestamp"))
    d = staged.withColumn("dt", (t - F.lag(t).over(lay.window())) / F.lit(1e6))
    d = frames.unstage(d, lay)
    if approx:
        return d.groupBy(*keys).agg(F.percentile_approx("dt", 0.5, accuracy).alias("median_dt"))
    if not lay.split:
        # no flight above the hot-row threshold: a per-flight value buffer is bounded
        return d.groupBy(*keys).agg(F.median("dt").alias("median_dt"))
    from aerolens.operators.curves import grouped_percentile
    return grouped_percentile(d, keys, "dt", 50.0, "median_dt")


def sample_rate_summary(rates: DataFrame) -> DataFrame:
    """A4: min / median / max of the per-flight medians.

    The median is the distributed exact percentile (no value buffer in one
    task, however many flights there are).
    """
    from aerolens.operators.curves import percentile_threshold
    p = percentile_threshold(rates, "median_dt", 50.0)
    return p.select(F.col("min_value").alias("min_dt"), F.col("threshold").alias("median_dt"),
                    F.col("max_value").alias("max_dt"))


def pick_case_with_anomalies(df: DataFrame, min_anomalies: int = 50) -> DataFrame:
    """Smallest case with >= N anomalies, else the first case (one row)."""
    per = df.groupBy("case_id").agg(F.count_if(F.col("label") == 1).alias("n_anom"))
    return per.agg(F.coalesce(
        F.min(F.when(F.col("n_anom") >= F.lit(int(min_anomalies)), F.col("case_id"))),
        F.min("case_id")).alias("case_id"))


def choose_case_id(df: DataFrame, requested: int) -> DataFrame:
    """The requested case if present, else the smallest one (one row).

    An empty input raises ``RuntimeError`` when the result is read.
    """
    agg = df.agg(F.max((F.col("case_id") == F.lit(requested)).cast("int")).alias("hit"),
                 F.min("case_id").alias("lo"))
    chosen = F.when(F.col("hit") == 1, F.lit(requested).cast("bigint")).otherwise(F.col("lo"))
    return agg.select(F.when(chosen.isNull(), F.raise_error(
        F.lit("no data in the test set"))).otherwise(chosen).alias("case_id"))
