"""Queries of the detection layers: L1 rules, L2 z-scores, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.operators.features import compute_features
from aerolens.operators.rules import detect_threshold_violations
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.plans import sqlkit as q
from aerolens.plans.registry import r6, register, tele
from aerolens.schema import FEATURE_NAMES


# --------------------------------------------------------------------- L1
L1_REASONS_SQL = """concat_ws('|',
    case when altitude < -5.0 then 'altitude_below_min' end,
    case when altitude > 500.0 then 'altitude_above_max' end,
    case when speed < 0.0 then 'speed_negative' end,
    case when speed > 30.0 then 'speed_above_max' end,
    case when heading < 0.0 then 'heading_below_min' end,
    case when heading >= 360.0 then 'heading_above_max' end,
    case when latitude < -90.0 then 'latitude_below_min' end,
    case when latitude > 90.0 then 'latitude_above_max' end,
    case when longitude < -180.0 then 'longitude_below_min' end,
    case when longitude > 180.0 then 'longitude_above_max' end)"""

@register("f9_rules", q.with_view("""
select event_id, case_id, row_idx,
  coalesce(altitude < -5.0, false) or coalesce(altitude > 500.0, false)
  or coalesce(speed < 0.0, false) or coalesce(speed > 30.0, false)
  or coalesce(heading < 0.0, false) or coalesce(heading >= 360.0, false)
  or coalesce(latitude < -90.0, false) or coalesce(latitude > 90.0, false)
  or coalesce(longitude < -180.0, false) or coalesce(longitude > 180.0, false) as alert_threshold,
  concat_ws('|',
    case when altitude < -5.0 then 'altitude_below_min' end,
    case when altitude > 500.0 then 'altitude_above_max' end,
    case when speed < 0.0 then 'speed_negative' end,
    case when speed > 30.0 then 'speed_above_max' end,
    case when heading < 0.0 then 'heading_below_min' end,
    case when heading >= 360.0 then 'heading_above_max' end,
    case when latitude < -90.0 then 'latitude_below_min' end,
    case when latitude > 90.0 then 'latitude_above_max' end,
    case when longitude < -180.0 then 'longitude_below_min' end,
    case when longitude > 180.0 then 'longitude_above_max' end) as alert_reasons
from t"""))
def f9_rules(spark, sf_dir):
    return (tele(spark, sf_dir).transform(detect_threshold_violations)
            .select("event_id", "case_id", "row_idx", "alert_threshold", "alert_reasons"))


# --------------------------------------------------------------------- L2
_W30 = "(partition by replicate, case_id order by row_idx, _ord rows between 29 preceding and current row)"
_W6 = "(partition by replicate, case_id order by row_idx, _ord rows between 5 preceding and current row)"


def _z_sql(x: str) -> str:
    mean, std = q.roll("mean", x, "w30", 15), q.roll("std", x, "w30", 15)
    return f"(case when {std} is not null then ({x} - {mean}) / greatest({std}, cast(0.05 as double)) end)"


L2_CTE = q.BASE_CTE + """,
z as (
  select *, {za} as z_altitude, {zs} as z_speed, {zh} as z_heading, {zg} as z_gps_step,
    coalesce({fs} < 0.05 and {fh} < 0.3 and {fg} < 1e-6, false) as fr
  from b window w30 as {w30}, w6 as {w6}
),
l2 as (
  select *,
    coalesce(abs(z_altitude) > 3.5, false) or coalesce(abs(z_speed) > 3.5, false)
      or coalesce(abs(z_heading) > 3.5, false) or coalesce(abs(z_gps_step) > 3.5, false) or fr
      as alert_change,
    concat_ws('|',
      case when abs(z_altitude) > 3.5 then 'sudden_altitude' end,
      case when abs(z_speed) > 3.5 then 'sudden_speed' end,
      case when abs(z_heading) > 3.5 then 'sudden_heading' end,
      case when abs(z_gps_step) > 3.5 then 'sudden_gps_step' end,
      case when fr then 'freeze_detected' end) as change_reasons
  from z
)""".format(za=_z_sql("d_alt"), zs=_z_sql("d_spd"), zh=_z_sql("d_hdg"), zg=_z_sql("gps"),
            fs=q.roll("std", "speed", "w6", 3), fh=q.roll("std", "heading", "w6", 3),
            fg=q.roll("std", "gps", "w6", 3), w30=_W30, w6=_W6)


@register("w7_zscore", q.with_view(f"""
select event_id, case_id, row_idx,
  {q.r6("z_altitude")} as z_altitude, {q.r6("z_speed")} as z_speed,
  {q.r6("z_heading")} as z_heading, {q.r6("z_gps_step")} as z_gps_step,
  alert_change, change_reasons
from l2""", L2_CTE))
def w7_zscore(spark, sf_dir):
    out = tele(spark, sf_dir).transform(detect_sudden_changes)
    return out.select("event_id", "case_id", "row_idx",
                      *[r6(f"z_{c}").alias(f"z_{c}") for c in ("altitude", "speed", "heading", "gps_step")],
                      "alert_change", "change_reasons")


# --------------------------------------------------------------------- A6
_L1_ANY = """(coalesce(altitude < -5.0, false) or coalesce(altitude > 500.0, false)
  or coalesce(speed < 0.0, false) or coalesce(speed > 30.0, false)
  or coalesce(heading < 0.0, false) or coalesce(heading >= 360.0, false)
  or coalesce(latitude < -90.0, false) or coalesce(latitude > 90.0, false)
  or coalesce(longitude < -180.0, false) or coalesce(longitude > 180.0, false))"""


@register("a6_alert_counts", q.with_view(f"""
select case_id, cast(count(*) as bigint) as n_rows,
  cast(sum(case when {_L1_ANY} then 1 else 0 end) as bigint) as n_alert_threshold,
  cast(sum(case when alert_change then 1 else 0 end) as bigint) as n_alert_change,
  cast(sum(label) as bigint) as n_label
from l2 group by case_id""", L2_CTE))
def a6_alert_counts(spark, sf_dir):
    d = tele(spark, sf_dir).transform(detect_threshold_violations).transform(detect_sudden_changes)
    return d.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("alert_threshold").alias("n_alert_threshold"),
        F.count_if("alert_change").alias("n_alert_change"),
        F.sum("label").cast("bigint").alias("n_label"))


# --------------------------------------------------------------- features
_W8 = "(partition by replicate, case_id order by row_idx, _ord rows between 7 preceding and current row)"
_WD = ("(partition by replicate, case_id order by row_idx desc, _ord desc "
       "rows between unbounded preceding and current row)")


def _feat_raw_sql() -> str:
    r = lambda op, x: q.roll(op, x, "w8", 4)
    parts = []
    for src, p in (("altitude", "alt"), ("speed", "spd")):
        parts += [f"{r('mean', src)} as {p}_mean", f"{r('std', src)} as {p}_std",
                  f"{r('max', src)} - {r('min', src)} as {p}_range",
                  f"({src} - lag({src}, 7) over w) / cast(8.0 as double) as {p}_slope"]
    parts += [f"{r('mean', 'd_hdg')} as hdg_diff_mean", f"{r('std', 'd_hdg')} as hdg_diff_std",
              f"{r('max', 'abs(d_hdg)')} as hdg_diff_abs_max",
              f"{r('mean', 'gps')} as gps_step_mean", f"{r('std', 'gps')} as gps_step_std",
              f"{r('max', 'gps')} as gps_step_max",
              f"{r('mean', 'abs(speed - gps / nullif(dt_raw, cast(0.0 as double)))')} as speed_vs_gps",
              "(case when count(dt_us) over w8 >= 4 then cast(sum(dt_us) over w8 as double)"
              " / count(dt_us) over w8 / 1000000.0 end) as dt_mean",
              f"{r('std', 'dt_raw')} as dt_std",
              f"{r('max', 'dt_raw')} as dt_max", f"{r('min', 'dt_raw')} as dt_min"]
    return ",\n    ".join(parts)


FEATURE_TAIL = """,
fr as (
  select *, {raw}
  from b window w as (partition by replicate, case_id order by row_idx, _ord), w8 as {w8}
),
fv as (
  select *, coalesce(alt_std, 0.0) + coalesce(spd_std, 0.0) + coalesce(hdg_diff_std, 0.0)
    + coalesce(gps_step_std, 0.0) as sample_var_score
  from fr
)""".format(raw=_feat_raw_sql(), w8=_W8)
FEATURE_CTE = q.BASE_CTE + FEATURE_TAIL


def _bfill_select(names) -> str:
    return ",\n  ".join(
        f"{q.r6(f'coalesce(last_value({c} ignore nulls) over wd, 0.0)')} as {c}" for c in names)




@register("w16_features", q.with_view(f"""
select event_id, case_id, row_idx,
  {_bfill_select(FEATURE_NAMES)}
from fv window wd as {_WD}""", FEATURE_CTE))
def w16_features(spark, sf_dir):
    out = tele(spark, sf_dir).transform(compute_features)
    return out.select("event_id", "case_id", "row_idx", *[r6(c).alias(c) for c in FEATURE_NAMES])


@register("w16_features_causal", q.with_view(f"""
select event_id, case_id, row_idx,
  {", ".join(f"{q.r6(f'coalesce({c}, 0.0)')} as {c}" for c in FEATURE_NAMES)}
from fv""", FEATURE_CTE))
def w16_features_causal(spark, sf_dir):
    out = compute_features(tele(spark, sf_dir), fill="causal")
    return out.select("event_id", "case_id", "row_idx", *[r6(c).alias(c) for c in FEATURE_NAMES])
