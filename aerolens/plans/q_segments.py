"""Queries of segments and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.operators import evaluation as ev
from aerolens.operators import segments as sg
from aerolens.plans import sqlkit as q
from aerolens.plans.q_eval import DET_CTE, detections
from aerolens.plans.registry import r6, register, tele

MERGE_GAP = 21_600.0     # samples of the events view are hours apart
MIN_DURATION = 600.0
_W = "(partition by replicate, case_id order by t_rel, row_idx, _ord)"
_WR = "(partition by replicate, case_id order by t_rel, row_idx, _ord rows between unbounded preceding and current row)"


@register("w1_t_rel", q.with_view(
    f"select event_id, case_id, {q.r6('(t_us - min(t_us) over (partition by replicate, case_id)) / 1000000.0')}"
    " as t_rel from t"))
def w1_t_rel(spark, sf_dir):
    return sg.with_t_rel(tele(spark, sf_dir)).select("event_id", "case_id", r6("t_rel").alias("t_rel"))


def _seg_sql(src: str, is1: str, is0: str, typ: str, with_type: bool) -> str:
    ctes = f"""tr as (select *, (t_us - min(t_us) over (partition by replicate, case_id)) / 1000000.0 as t_rel
  from {src}),
g as (select *, {typ} as _type,
    case when {is0} or not coalesce({typ} = lag({typ}) over w, false) then 1 else 0 end as rst,
    lead(t_rel) over w as nxt
  from tr window w as {_W}),
g2 as (select *, sum(rst) over {_WR} as grp from g),
seg as (select replicate, case_id, grp, min(case when {is1} then t_rel end) as start,
    max(coalesce(nxt, t_rel)) as "end", max(_type) as type,
    max(case when {is1} then 1 else 0 end) as has1
  from g2 group by replicate, case_id, grp),
s2 as (select *, case when coalesce(type = lag(type) over w2, false)
      and start - lag("end") over w2 <= {MERGE_GAP} then 0 else 1 end as nw
  from seg where has1 = 1 window w2 as (partition by replicate, case_id order by start, grp)),
s3 as (select *, sum(nw) over (partition by replicate, case_id order by start, grp
    rows between unbounded preceding and current row) as m from s2),
mg as (select replicate, case_id, m, min(start) as seg_start, max("end") as seg_end, max(type) as type
  from s3 group by replicate, case_id, m)"""
    extra = ", type" if with_type else ""
    return ctes, (f"select replicate, case_id, {q.r6('seg_start')} as seg_start, "
                  f"{q.r6('seg_end')} as seg_end{extra} from mg where seg_end - seg_start >= {MIN_DURATION}")


_C17, _B17 = _seg_sql("t", "label = 1", "label = 0", "tamper_type", True)
_C18, _B18 = _seg_sql("det", "alert_change", "not alert_change", "''", False)


@register("w17_anomaly_segments", q.with_view(_B17, _C17))
def w17_anomaly_segments(spark, sf_dir):
    d = sg.with_t_rel(tele(spark, sf_dir))
    s = sg.anomaly_segments(d, MERGE_GAP, MIN_DURATION)
    return s.select("replicate", "case_id", r6("seg_start").alias("seg_start"),
                    r6("seg_end").alias("seg_end"), "type")


@register("w18_alert_segments", q.with_view(_B18, DET_CTE + ",\n" + _C18))
def w18_alert_segments(spark, sf_dir):
    d = sg.with_t_rel(detections(spark, sf_dir))
    s = sg.binary_segments(d, "alert_change", MERGE_GAP, MIN_DURATION)
    return s.select("replicate", "case_id", r6("seg_start").alias("seg_start"),
                    r6("seg_end").alias("seg_end"))


@register("f15_case_timeline", q.with_view(f"""
select {q.r6('t_rel')} as t_rel, row_idx, label, tamper_type,
  concat_ws('|', case when alert_threshold then 'alert_threshold' end,
    case when alert_change then 'alert_change' end) as alerts,
  channel, {q.r6('value')} as value
from (select *, (t_us - min(t_us) over (partition by replicate, case_id)) / 1000000.0 as t_rel from det
      where case_id = (select case when max(case when case_id = 550 then 1 else 0 end) = 1 then 550
                       else min(case_id) end from t)) x
unpivot include nulls (value for channel in (altitude, speed, heading, latitude, longitude))""", DET_CTE))
def f15_case_timeline(spark, sf_dir):
    d = sg.with_t_rel(detections(spark, sf_dir))
    cid = ev.choose_case_id(d, 550).first()[0]
    tl = sg.case_timeline(d, cid, layers=("alert_threshold", "alert_change"))
    return tl.select(r6("t_rel").alias("t_rel"), "row_idx", "label", "tamper_type",
                     F.array_join("alerts", "|").alias("alerts"), "channel",
                     r6("value").alias("value"))
