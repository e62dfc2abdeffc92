"""Queries of the evaluation family (A1-A10, A13, A18, A19) on L1 + L2 alerts."""

from __future__ import annotations


from aerolens.operators import evaluation as ev
from aerolens.operators.rules import detect_threshold_violations
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.plans import sqlkit as q
from aerolens.plans.q_layers import L2_CTE, _L1_ANY
from aerolens.plans.registry import r6, register, tele

LAYERS = {"alert_threshold": "rules", "alert_change": "statistical"}
DET_CTE = L2_CTE + f""",
det as (select *, {_L1_ANY} as alert_threshold from l2)"""


def detections(spark, sf_dir):
    return (tele(spark, sf_dir).transform(detect_threshold_violations)
            .transform(detect_sudden_changes))


def _hits(c):
    return f"cast(sum(case when {c} then 1 else 0 end) as bigint)"


def _text(h, n):
    return (f"(cast({h} as varchar) || '/' || cast({n} as varchar) || ' (' || "
            f"cast(cast(round_even(100.0 * {h} / {n}, 0) as bigint) as varchar) || '%)')")


# ------------------------------------------------------------ A1, A2
@register("a1_summary", q.with_view("""
select cast(count(*) as bigint) as n_rows, cast(count(distinct case_id) as bigint) as n_cases,
  string_agg(distinct cast(replicate as varchar), ',' order by cast(replicate as varchar)) as replicates,
  cast(sum(label) as bigint) as n_anomalies,
  floor(avg(label) * 100.0 * 1000000.0 + 0.5) / 1000000.0 as anomaly_pct
from t"""))
def a1_summary(spark, sf_dir):
    s = ev.summarize(tele(spark, sf_dir))
    return s.withColumn("anomaly_pct", r6("anomaly_pct"))


@register("a2_tamper_counts", q.with_view(
    "select tamper_type, cast(count(*) as bigint) as n from t group by tamper_type"))
def a2_tamper_counts(spark, sf_dir):
    return ev.value_counts(tele(spark, sf_dir), "tamper_type")


@register("a2_profile_counts", q.with_view(
    "select profile, cast(count(*) as bigint) as n from t group by profile"))
def a2_profile_counts(spark, sf_dir):
    return ev.value_counts(tele(spark, sf_dir), "profile")


# ------------------------------------------------------------ A3, A4
_A3_CTE = """dts as (
  select replicate, case_id,
    (t_us - lag(t_us) over (partition by replicate, case_id order by row_idx, _ord)) / 1000000.0 as dt
  from t),
rates as (select replicate, case_id, median(dt) as median_dt from dts group by replicate, case_id)"""


@register("a3_sample_rate", q.with_view(
    f"select replicate, case_id, {q.r6('median_dt')} as median_dt from rates", _A3_CTE))
def a3_sample_rate(spark, sf_dir):
    r = ev.sample_rate_per_case(tele(spark, sf_dir))
    return r.withColumn("median_dt", r6("median_dt"))


@register("a4_sample_rate_summary", q.with_view(
    f"select {q.r6('min(median_dt)')} as min_dt, {q.r6('median(median_dt)')} as median_dt, "
    f"{q.r6('max(median_dt)')} as max_dt from rates", _A3_CTE))
def a4_sample_rate_summary(spark, sf_dir):
    s = ev.sample_rate_summary(ev.sample_rate_per_case(tele(spark, sf_dir)))
    return s.select(*[r6(c).alias(c) for c in s.columns])


# ------------------------------------------------------------ A5-A7
@register("a5_crosstab", q.with_view("""
select alert_change, cast(count(*) filter (where label = 0) as bigint) as label_0,
  cast(count(*) filter (where label = 1) as bigint) as label_1
from det group by alert_change""", DET_CTE))
def a5_crosstab(spark, sf_dir):
    return ev.crosstab(detections(spark, sf_dir), "alert_change")


@register("a6_layer_alerts", q.with_view(f"""
select cast(count(*) as bigint) as n_rows, {_hits('alert_threshold')} as n_alert_threshold,
  {_hits('alert_change')} as n_alert_change from det""", DET_CTE))
def a6_layer_alerts(spark, sf_dir):
    return ev.alert_counts(detections(spark, sf_dir), LAYERS)


def _conf_sql(c: str) -> str:
    tp = f"count(*) filter (where {c} and label = 1)"
    fp = f"count(*) filter (where {c} and label = 0)"
    tn = f"count(*) filter (where not {c} and label = 0)"
    fn = f"count(*) filter (where not {c} and label = 1)"
    return tp, fp, tn, fn


def _ratios_sql(tp, fp, fn):
    p = f"(case when ({tp}) + ({fp}) <> 0 then cast({tp} as double) / (({tp}) + ({fp})) else 0.0 end)"
    r = f"(case when ({tp}) + ({fn}) <> 0 then cast({tp} as double) / (({tp}) + ({fn})) else 0.0 end)"
    f = f"(case when {p} + {r} > 0 then 2.0 * {p} * {r} / ({p} + {r}) else 0.0 end)"
    return p, r, f


_TP, _FP, _TN, _FN = _conf_sql("alert_change")
_P, _R, _F1 = _ratios_sql(_TP, _FP, _FN)


@register("a7_confusion", q.with_view(f"""
select cast({_TP} as bigint) as TP, cast({_FP} as bigint) as FP, cast({_TN} as bigint) as TN,
  cast({_FN} as bigint) as FN, {q.r6(_P)} as precision, {q.r6(_R)} as recall, {q.r6(_F1)} as f1
from det""", DET_CTE))
def a7_confusion(spark, sf_dir):
    c = ev.confusion(detections(spark, sf_dir), "alert_change")
    return c.select("TP", "FP", "TN", "FN", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


def _global_sql() -> str:
    parts = []
    for col, name in LAYERS.items():
        tp, fp, tn, fn = (f"sum(case when {col} and label = 1 then 1 else 0 end)",
                          f"sum(case when {col} and label = 0 then 1 else 0 end)",
                          f"sum(case when not {col} and label = 0 then 1 else 0 end)",
                          f"sum(case when not {col} and label = 1 then 1 else 0 end)")
        p, r, f = _ratios_sql(tp, fp, fn)
        parts.append(f"select '{name}' as layer, cast({tp} as bigint) as TP, cast({fp} as bigint) as FP, "
                     f"cast({fn} as bigint) as FN, cast({tn} as bigint) as TN, {q.r6(p)} as precision, "
                     f"{q.r6(r)} as recall, {q.r6(f)} as F1 from det")
    return "\nunion all\n".join(parts)


@register("a8_global_metrics", q.with_view(_global_sql(), DET_CTE))
def a8_global_metrics(spark, sf_dir):
    g = ev.global_metrics(detections(spark, sf_dir), LAYERS)
    return g.select("layer", "TP", "FP", "FN", "TN",
                    *[r6(x).alias(x) for x in ("precision", "recall", "F1")])


@register("a8_global_report", q.with_view(
    "select layer, TP, FP, FN, TN, round_even(precision, 3) as precision, round_even(recall, 3) as recall, round_even(F1, 3) as F1 from ("
    + _global_sql() + ")", DET_CTE))
def a8_global_report(spark, sf_dir):
    """A8 as reported: three digits."""
    g = ev.global_metrics(detections(spark, sf_dir), LAYERS, digits=3)
    return g.select("layer", "TP", "FP", "FN", "TN", "precision", "recall", "F1")


def _group_sql(key: str, where: str) -> str:
    cols = [key, "cast(count(*) as bigint) as n"]
    for c in LAYERS:
        h = _hits(c)
        cols += [f"{h} as {c}_hits", f"{q.r6(f'cast({h} as double) / count(*)')} as {c}_rate",
                 f"{_text(h, 'count(*)')} as {c}_text"]
    return f"select {', '.join(cols)} from det where {where} group by {key}"


def _group_spark(df):
    cols = [df.columns[0], "n"]
    for c in LAYERS:
        cols += [f"{c}_hits", r6(f"{c}_rate").alias(f"{c}_rate"), f"{c}_text"]
    return df.select(*cols)


@register("a9_per_scenario", q.with_view(_group_sql("tamper_type", "tamper_type <> 'normal'"), DET_CTE))
def a9_per_scenario(spark, sf_dir):
    return _group_spark(ev.per_scenario(detections(spark, sf_dir), LAYERS))


@register("a10_per_profile", q.with_view(
    _group_sql("profile", "label = 1 and profile in ('subtle', 'balanced', 'strong')"), DET_CTE))
def a10_per_profile(spark, sf_dir):
    return _group_spark(ev.per_profile(detections(spark, sf_dir), LAYERS))


def _op_sql() -> str:
    parts = []
    for col, name in LAYERS.items():
        tp, fp, tn, fn = (f"sum(case when {col} and label = 1 then 1 else 0 end)",
                          f"sum(case when {col} and label = 0 then 1 else 0 end)",
                          f"sum(case when not {col} and label = 0 then 1 else 0 end)",
                          f"sum(case when not {col} and label = 1 then 1 else 0 end)")
        fpr = f"(case when ({fp}) + ({tn}) <> 0 then cast({fp} as double) / (({fp}) + ({tn})) else 0.0 end)"
        tpr = f"(case when ({tp}) + ({fn}) <> 0 then cast({tp} as double) / (({tp}) + ({fn})) else 0.0 end)"
        parts.append(f"select '{name}' as layer, {q.r6(fpr)} as fpr, {q.r6(tpr)} as tpr from det")
    return "\nunion all\n".join(parts)


@register("a13_operating_points", q.with_view(_op_sql(), DET_CTE))
def a13_operating_points(spark, sf_dir):
    o = ev.operating_points(detections(spark, sf_dir), LAYERS)
    return o.select("layer", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


# ------------------------------------------------------------ A18, A19
@register("a18_pick_case", q.with_view("""
select coalesce(min(case when n_anom >= 2 then case_id end), min(case_id)) as case_id
from (select case_id, count(*) filter (where label = 1) as n_anom from t group by case_id)"""))
def a18_pick_case(spark, sf_dir):
    return ev.pick_case_with_anomalies(tele(spark, sf_dir), min_anomalies=2)


@register("a19_choose_case", q.with_view("""
select case when max(case when case_id = 550 then 1 else 0 end) = 1 then cast(550 as bigint)
  else min(case_id) end as case_id from t"""))
def a19_choose_case(spark, sf_dir):
    return ev.choose_case_id(tele(spark, sf_dir), 550)
