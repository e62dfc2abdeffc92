"""Queries of the single building blocks (W2-W6, W8-W15, F1-F3, F13, J1, J2,
O2, O5, S2) and of the detector API (F12, M2, M3, M9).

The window primitives run through the same staged flight window as the
composed operators (``frames.stage`` + ``with_base_deltas`` /
``RollingSet``), one ID at a time, with DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.functions.rolling import RollingSet
from aerolens.operators import frames
from aerolens.operators.features import compute_features
from aerolens.operators.models import AnomalyDetector, detect_ml_anomalies
from aerolens.operators.statistical import detect_sudden_changes, with_base_deltas
from aerolens.plans import sqlkit as q
from aerolens.plans.composed import detect
from aerolens.plans.q_eval import DET_CTE
from aerolens.plans.q_ingest import _loaded, events_as_csv
from aerolens.plans.q_layers import FEATURE_CTE, L1_REASONS_SQL, L2_CTE
from aerolens.plans.q_models import _split
from aerolens.plans.registry import r6, register, tele
from aerolens.schema import FEATURE_NAMES
from aerolens.sources import csv as ingest

_W = "(partition by replicate, case_id order by row_idx, _ord)"


def _based(spark, sf_dir):
    staged, lay = frames.stage(tele(spark, sf_dir), halo=31)
    return with_base_deltas(staged, lay), lay


# ------------------------------------------------------------- W2 - W6
@register("w2_first_difference", q.with_view(
    f"select event_id, {q.r6('d_alt')} as d_altitude, {q.r6('d_spd')} as d_speed from b", q.BASE_CTE))
def w2_first_difference(spark, sf_dir):
    d, lay = _based(spark, sf_dir)
    return frames.unstage(d, lay).select("event_id", r6("_d_altitude").alias("d_altitude"),
                                         r6("_d_speed").alias("d_speed"))


@register("w3_circular_heading_diff", q.with_view(
    f"select event_id, {q.r6('d_hdg')} as d_heading from b", q.BASE_CTE))
def w3_circular_heading_diff(spark, sf_dir):
    d, lay = _based(spark, sf_dir)
    return frames.unstage(d, lay).select("event_id", r6("_d_heading").alias("d_heading"))


@register("w4_haversine_step", q.with_view(
    f"select event_id, {q.r6('gps')} as gps_step from b", q.BASE_CTE))
def w4_haversine_step(spark, sf_dir):
    d, lay = _based(spark, sf_dir)
    return frames.unstage(d, lay).select("event_id", r6("_gps_step").alias("gps_step"))


@register("w5_time_step", q.with_view(
    f"select event_id, {q.r6('dt_raw')} as dt, {q.r6('nullif(dt_raw, 0.0)')} as dt_nonzero from b",
    q.BASE_CTE))
def w5_time_step(spark, sf_dir):
    d, lay = _based(spark, sf_dir)
    return frames.unstage(d, lay).select("event_id", r6("_dt_raw").alias("dt"),
                                         r6(F.nullif(F.col("_dt_raw"), F.lit(0.0))).alias("dt_nonzero"))


_W10 = "(partition by replicate, case_id order by row_idx, _ord rows between 9 preceding and current row)"


@register("w6_rolling_by_flight", q.with_view(f"""
select event_id,
  {q.r6(q.roll('mean', 'altitude', 'w10', 5))} as alt_mean10, {q.r6(q.roll('std', 'altitude', 'w10', 5))} as alt_std10,
  {q.r6(q.roll('max', 'speed', 'w10', 5))} as spd_max10, {q.r6(q.roll('min', 'speed', 'w10', 5))} as spd_min10
from t window w10 as {_W10}"""))
def w6_rolling_by_flight(spark, sf_dir):
    """Generic rolling op (window 10, default min periods 5)."""
    staged, lay = frames.stage(tele(spark, sf_dir), halo=10)
    rs = RollingSet(lay.window(), "_q")
    cols = {"alt_mean10": rs.rolling("altitude", 10, "mean"), "alt_std10": rs.rolling("altitude", 10, "std"),
            "spd_max10": rs.rolling("speed", 10, "max"), "spd_min10": rs.rolling("speed", 10, "min")}
    d = staged.withColumns(rs.columns()).withColumns(cols)
    return frames.unstage(d, lay).select("event_id", *[r6(c).alias(c) for c in cols])


# ------------------------------------------------------------- W8, W9
@register("w8_freeze", q.with_view("select event_id, fr as freeze_detected from z", L2_CTE))
def w8_freeze(spark, sf_dir):
    d = detect_sudden_changes(tele(spark, sf_dir))
    return d.select("event_id", F.col("change_reasons").contains("freeze_detected").alias("freeze_detected"))


@register("w9_change_output", q.with_view(
    "select event_id, alert_change, change_reasons from l2", L2_CTE))
def w9_change_output(spark, sf_dir):
    return detect_sudden_changes(tele(spark, sf_dir)).select("event_id", "alert_change", "change_reasons")


# ----------------------------------------------------- W10 - W15 (unfilled)
def _raw_feature_query(names):
    sql = q.with_view("select event_id, " + ", ".join(f"{q.r6(c)} as {c}" for c in names) + " from fv",
                      FEATURE_CTE)

    def fn(spark, sf_dir):
        f = compute_features(tele(spark, sf_dir), fill="none")
        return f.select("event_id", *[r6(c).alias(c) for c in names])
    return sql, fn


for _key, _names in {
    "w10_window_stats": ("alt_mean", "alt_std", "alt_range", "alt_slope",
                         "spd_mean", "spd_std", "spd_range", "spd_slope"),
    "w11_heading_features": ("hdg_diff_mean", "hdg_diff_std", "hdg_diff_abs_max"),
    "w12_gps_features": ("gps_step_mean", "gps_step_std", "gps_step_max"),
    "w13_speed_vs_gps": ("speed_vs_gps",),
    "w14_dt_features": ("dt_mean", "dt_std", "dt_max", "dt_min"),
    "w15_sample_var_score": ("sample_var_score",),
}.items():
    _sql, _fn = _raw_feature_query(_names)
    _fn.__name__ = _key
    register(_key, _sql)(_fn)


# ------------------------------------------------------------- F1 - F3, S2
@register("f1_coerce_numeric", q.with_view(
    f"select event_id as original_row_idx, {q.r6('altitude')} as altitude, "
    "cast(replicate as int) as replicate, label from t"))
def f1_coerce_numeric(spark, sf_dir):
    d = _loaded(spark, sf_dir)
    return d.select("original_row_idx", r6("altitude").alias("altitude"), "replicate", "label")


@register("f2_parse_timestamp", q.with_view("select event_id as original_row_idx, t_us from t"))
def f2_parse_timestamp(spark, sf_dir):
    return _loaded(spark, sf_dir).select("original_row_idx", F.unix_micros("timestamp").alias("t_us"))


@register("f3_drop_row_zero", q.with_view(
    "select cast(count(*) as bigint) as n_rows, cast(min(row_idx) as bigint) as min_row_idx from t"))
def f3_drop_row_zero(spark, sf_dir):
    d = _loaded(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_idx").cast("bigint").alias("min_row_idx"))


@register("s2_usecols", q.with_view(
    "select event_id as original_row_idx, case_id, row_idx, label from t"))
def s2_usecols(spark, sf_dir):
    cols = ["case_id", "row_idx", "timestamp", "label", "original_row_idx"]
    d = ingest.load_dataset(spark, events_as_csv(spark, sf_dir), usecols=cols, flight_keys=("case_id",))
    return d.select("original_row_idx", "case_id", "row_idx", "label")


# ------------------------------------------------------------- F13, J1, J2
@register("f13_combined_alert", q.with_view(f"""
select event_id,
  concat_ws('+', case when alert_threshold then 'rules' end, case when alert_change then 'statistical' end) as layers,
  alert_threshold or alert_change as alert,
  concat_ws('|', nullif({L1_REASONS_SQL}, ''), nullif(change_reasons, '')) as reasons
from det""", DET_CTE))
def f13_combined_alert(spark, sf_dir):
    d = detect(tele(spark, sf_dir), layers="rules,statistical", combine=True)
    return d.select("event_id", F.array_join("layers", "+").alias("layers"), "alert", "reasons")


@register("j1_semi_join_flights", q.with_view(
    "select event_id, case_id from t where case_id in (select case_id from t group by case_id "
    "having count(*) filter (where label = 1) >= 15)"))
def j1_semi_join_flights(spark, sf_dir):
    """Rows of flights with at least 15 anomalies (left-semi join on case_id)."""
    t = tele(spark, sf_dir)
    keep = t.groupBy("case_id").agg(F.count_if(F.col("label") == 1).alias("n")).filter(F.col("n") >= 15)
    return t.join(keep.select("case_id"), "case_id", "left_semi").select("event_id", "case_id")


@register("j2_features_joined_back", q.with_view(
    "select t.event_id, " + ", ".join(f"{q.r6(f'fv.{c}')} as {c}" for c in FEATURE_NAMES)
    + " from t join fv on t.event_id = fv.event_id", FEATURE_CTE))
def j2_features_joined_back(spark, sf_dir):
    """Features stored apart and joined back on (replicate, case_id, row_idx, _ord), null-safe."""
    t = tele(spark, sf_dir)
    keys = ["replicate", "case_id", "row_idx", "_ord"]
    feats = compute_features(t, fill="none").select(*[F.col(k).alias(f"_f_{k}") for k in keys], *FEATURE_NAMES)
    j = t.join(feats, [F.col(k).eqNullSafe(F.col(f"_f_{k}")) for k in keys])
    return j.select("event_id", *[r6(c).alias(c) for c in FEATURE_NAMES])


# ------------------------------------------------------------- O2, O5
@register("o2_case_sorted_by_time", q.with_view(
    "select event_id, row_idx from t where case_id = (select min(case_id) from t) order by t_us, row_idx"))
def o2_case_sorted_by_time(spark, sf_dir):
    t = tele(spark, sf_dir)
    first = t.agg(F.min("case_id").alias("case_id"))
    one = t.join(first, "case_id", "left_semi")
    return one.orderBy("t_us", "row_idx").select("event_id", "row_idx")


@register("o5_union_parts", q.with_view(
    "select cast(count(*) as bigint) as n, cast(count(distinct event_id) as bigint) as n_distinct from t"))
def o5_union_parts(spark, sf_dir):
    train, test = ingest.split_by_replicate(tele(spark, sf_dir), 3)
    u = train.unionByName(test)
    return u.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"))


# ------------------------------------------------------------- detector API
@register("m2_fitted_thresholds", q.with_view("""
select algorithm, algorithm = 'isolation_forest' as has_threshold, algorithm = 'random_forest' as has_optimal, true as same_again
from (select unnest(['isolation_forest', 'random_forest']) as algorithm)"""))
def m2_fitted_thresholds(spark, sf_dir):
    """Fit two detectors twice: which thresholds they set, and that a fit repeats."""
    train, _ = _split(spark, sf_dir)
    rows = []
    for algo in ("isolation_forest", "random_forest"):
        a, b = (AnomalyDetector(algo, params={"n_estimators": 60}).fit(d) for d in (train, train))
        rows.append((algo, a.threshold is not None, a.optimal_threshold is not None,
                     (a.threshold, a.optimal_threshold) == (b.threshold, b.optimal_threshold)))
    return spark.createDataFrame(rows, "algorithm string, has_threshold boolean, has_optimal boolean, same_again boolean")


@register("m3_predict_alert_rates", q.with_view("""
select label, cast(count(*) as bigint) as n, true as some_alerts from t where replicate = 3 group by label"""))
def m3_predict_alert_rates(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    out = AnomalyDetector("isolation_forest").fit(train).predict(test)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), (F.count_if("alert_ml").between(1, F.count(F.lit(1)) / 2)).alias("some_alerts"))


@register("m9_detect_ml_anomalies", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(0 as bigint) as n_differs from t where replicate = 3"""))
def m9_detect_ml_anomalies(spark, sf_dir):
    """Fit and predict in one call, equal to the two calls."""
    train, test = _split(spark, sf_dir)
    one = detect_ml_anomalies(test, train, "isolation_forest").select("event_id", "ml_score", "alert_ml")
    two = AnomalyDetector("isolation_forest").fit(train).predict(test).select("event_id", F.col("ml_score").alias("s"), F.col("alert_ml").alias("a"))
    j = one.join(two, "event_id")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.abs(F.col("ml_score") - F.col("s")) > 1e-12) | (F.col("alert_ml") != F.col("a"))).alias("n_differs"))
