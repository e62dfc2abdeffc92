"""Streaming queries (S4, S6, S9-S11, T1-T6): replay the telemetry view as a
file stream, run the public job over it, read its sinks back.

Compared with the batch oracle: the stream must equal batch L1 + L2 and the
causal features row for row, whatever the order in which flights arrive.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from aerolens.operators.combine import combine_layers
from aerolens.operators.models import AnomalyDetector
from aerolens.operators.rules import detect_threshold_violations
from aerolens.plans import sqlkit as q
from aerolens.plans.composed import detect
from aerolens.plans.q_eval import DET_CTE
from aerolens.plans.q_layers import FEATURE_TAIL, L1_REASONS_SQL
from aerolens.plans.registry import r6, register, tele
from aerolens.plans.runners import run_stream, stream_results
from aerolens.schema import FEATURE_NAMES
from aerolens.session import checkpoint_dir
from aerolens.sources.csv import split_by_replicate
from aerolens.streaming import job
from aerolens.streaming.replay import replay_stream, write_replay

FILES = 4


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


def _streamed(spark, view, layers=("rules", "statistical"), by="time", **options):
    """Replay ``view`` in four slices through the public job; its output folder."""
    base = _scratch(spark, "stream")
    files = write_replay(view, f"{base}/src", chunks=4, files_per_chunk=FILES, by=by)
    run_stream(spark, f"{base}/src", view.schema, f"{base}/out", f"{base}/ckpt", layers=layers, files_per_trigger=files, **options)
    return f"{base}/out"


_STREAM_CTE = DET_CTE + FEATURE_TAIL + """,
comb as (
  select l2.*, {feats},
    alert_threshold or alert_change as alert,
    concat_ws('|', nullif(l2.alert_reasons, ''), nullif(l2.change_reasons, '')) as reasons
  from (select det.*, {reasons} as alert_reasons from det) l2 join fv on l2.event_id = fv.event_id
)""".format(feats=", ".join(f"fv.{c} as f_{c}" for c in FEATURE_NAMES),
            reasons=L1_REASONS_SQL)


@register("t2_stream_scored", q.with_view(f"""
select event_id, case_id, row_idx,
  {q.r6('z_altitude')} as z_altitude, {q.r6('z_speed')} as z_speed,
  {q.r6('z_heading')} as z_heading, {q.r6('z_gps_step')} as z_gps_step,
  alert_change, change_reasons, alert, reasons,
  {", ".join(f"{q.r6(f'coalesce(f_{c}, 0.0)')} as {c}" for c in FEATURE_NAMES)}
from comb""", _STREAM_CTE))
def t2_stream_scored(spark, sf_dir):
    out = job.read_scored(spark, _streamed(spark, tele(spark, sf_dir).drop("t_us"), with_features=True, sinks=()))
    return out.select("event_id", "case_id", "row_idx",
                      *[r6(f"z_{c}").alias(f"z_{c}") for c in ("altitude", "speed", "heading", "gps_step")],
                      "alert_change", "change_reasons", "alert", "reasons",
                      *[r6(c).alias(c) for c in FEATURE_NAMES])


@register("t3_stream_alerts", q.with_view("""
select strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') || '+00:00' as timestamp,
  case_id, row_idx,
  concat_ws('+', case when alert_threshold then 'rules' end, case when alert_change then 'statistical' end) as layers,
  reasons, label
from comb where alert""", _STREAM_CTE))
def t3_stream_alerts(spark, sf_dir):
    """T3 + S4 + S11: alert records of the JSON-lines sink, read back."""
    out, _ = stream_results(spark, _streamed(spark, tele(spark, sf_dir).drop("t_us"), sinks=("alerts", "metrics")))
    return out.select("timestamp", "case_id", "row_idx", F.array_join("layers", "+").alias("layers"),
                      "reasons", "label")


_COUNTS = """
  cast(count(*) as bigint) as n_samples, cast(count(*) filter (where alert) as bigint) as n_alerts, cast(0 as bigint) as n_late,
  cast(count(*) filter (where alert and label = 1) as bigint) as tp,
  cast(count(*) filter (where alert and label = 0) as bigint) as fp,
  cast(count(*) filter (where not alert and label = 1) as bigint) as fn,
  cast(count(*) filter (where not alert and label = 0) as bigint) as tn"""


@register("t4_stream_metrics", q.with_view(f"""
select *, {q.r6("case when p + r > 0 then 2 * p * r / (p + r) else 0 end")} as f1, {q.r6('p')} as "precision", {q.r6('r')} as recall
from (select *, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as p,
        case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as r from (select {_COUNTS} from comb))""".replace(
    "select *, (floor", "select n_samples, n_alerts, n_late, tp, fp, fn, tn, (floor"), _STREAM_CTE))
def t4_stream_metrics(spark, sf_dir):
    """T4: online counters, per micro-batch, summed when read, and their ratios."""
    _, m = stream_results(spark, _streamed(spark, tele(spark, sf_dir).drop("t_us"), sinks=("alerts", "metrics")))
    return m.select(*job.COUNTERS, *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


_Z_SQL = f"""
select event_id, case_id, row_idx, label, {q.r6('z_altitude')} as z_altitude, {q.r6('z_speed')} as z_speed,
  {q.r6('z_heading')} as z_heading, {q.r6('z_gps_step')} as z_gps_step, alert, reasons"""


def _z_rows(d, *more):
    return d.select("event_id", "case_id", "row_idx", "label", *[r6(f"z_{c}").alias(f"z_{c}") for c in ("altitude", "speed", "heading", "gps_step")],
                    "alert", "reasons", *more)


@register("t7_stream_out_of_order", q.with_view(_Z_SQL + ", false as late from comb", _STREAM_CTE))
def t7_stream_out_of_order(spark, sf_dir):
    """Flights in the order of case_id, so event time jumps back: all rows come out."""
    d = job.read_scored(spark, _streamed(spark, tele(spark, sf_dir).drop("t_us"), by="case", sinks=()))
    return _z_rows(d, "late")


@register("t8_stream_null_timestamp", q.with_view(_Z_SQL + ", case when event_id % 13 = 0 or case_id % 29 = 0 then null else t_us end as t_us from comb", _STREAM_CTE))
def t8_stream_null_timestamp(spark, sf_dir):
    """Rows, and whole flights, without timestamps are scored like others."""
    view = tele(spark, sf_dir).drop("t_us")
    gone = (F.col("event_id") % 13 == 0) | (F.col("case_id") % 29 == 0)
    view = view.withColumn("timestamp", F.when(~gone, F.col("timestamp")))
    d = job.read_scored(spark, _streamed(spark, view, by="case", sinks=()))
    return _z_rows(d, F.unix_micros("timestamp").alias("t_us"))


@register("t9_stream_late_rows", q.with_view("""
select cast(count(*) as bigint) as n_samples, cast(count(*) filter (where late) as bigint) as n_late,
  cast(count(*) filter (where late and l1) as bigint) as n_late_l1
from (select row_idx <= 20 and m > 20 as late, alert_threshold as l1 from (select *, max(row_idx) over (partition by replicate, case_id) as m from comb))""", _STREAM_CTE))
def t9_stream_late_rows(spark, sf_dir):
    """The first 20 rows of every flight arrive last: scored, flagged and counted."""
    base = _scratch(spark, "late")
    view = tele(spark, sf_dir).drop("t_us")
    for k, part in enumerate((view.where("row_idx > 20"), view.where("row_idx <= 20"))):
        part.repartition(1).write.mode("append").parquet(f"{base}/src")
        run_stream(spark, f"{base}/src", view.schema, f"{base}/out", f"{base}/ckpt", layers="rules,statistical")
    d = job.read_scored(spark, f"{base}/out")
    _, m = stream_results(spark, f"{base}/out")
    late = d.agg(F.count_if(F.col("late") & F.col("alert_threshold")).alias("n_late_l1"))
    return m.select("n_samples", "n_late").crossJoin(late)      # one row each


@register("t10_stream_equals_batch_ml", q.with_view("""
select cast(count(*) as bigint) as n, cast(0 as bigint) as n_score_differs, cast(0 as bigint) as n_flag_differs,
  cast(0 as bigint) as n_layers_differ, true as metrics_agree from t where replicate = 3"""))
def t10_stream_equals_batch_ml(spark, sf_dir):
    """All three layers on the stream of the test flights equal the batch detection with causal features."""
    train, test = split_by_replicate(tele(spark, sf_dir).drop("t_us"), 3)
    model = AnomalyDetector("isolation_forest").fit(train)
    want = detect(test, layers="all", model=model, fill="causal", combine=True)
    out = _streamed(spark, test, layers="all", model=model, sinks=("alerts", "metrics"))
    _, m = stream_results(spark, out)
    flags = ("alert_threshold", "alert_change", "alert_ml")
    w = want.select("event_id", F.col("ml_score").alias("s"), F.struct(*flags).alias("f"), F.col("layers").alias("l"), "alert", "label")
    j = job.read_scored(spark, out).select("event_id", "ml_score", F.struct(*flags).alias("g"), "layers").join(w, "event_id")
    differs = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    tot = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(F.abs(F.col("ml_score") - F.col("s")) < 1e-9)).alias("n_score_differs"),
                differs("f", "g").alias("n_flag_differs"), differs("l", "layers").alias("n_layers_differ"),
                F.count_if("alert").alias("a"), F.count_if(F.col("alert") & (F.col("label") == 1)).alias("t"))
    agree = (F.col("n_alerts") == F.col("a")) & (F.col("tp") == F.col("t")) & (F.col("n_samples") == F.col("n"))
    return tot.crossJoin(m).select("n", "n_score_differs", "n_flag_differs", "n_layers_differ", agree.alias("metrics_agree"))


@register("s6_fan_out", q.with_view(f"""
select target, case_id, row_idx, 'rules' as layers, reasons from
  (select case_id, row_idx, {L1_REASONS_SQL} as reasons from det where alert_threshold) cross join (select unnest(['a', 'b']) as target)""", DET_CTE))
def s6_fan_out(spark, sf_dir):
    """Rule alerts of a stream to two targets through ``foreachBatch``."""
    view = tele(spark, sf_dir).drop("t_us")
    base = _scratch(spark, "fan")
    files = write_replay(view, f"{base}/src", files_per_chunk=FILES)
    stream = combine_layers(detect_threshold_violations(replay_stream(spark, f"{base}/src", view.schema, files)), ("rules",))
    w = job.alerts(stream).writeStream.foreachBatch(job.fan_out({"a": f"{base}/a", "b": f"{base}/b"}, fmt="parquet"))
    w.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start().awaitTermination()
    read = lambda n: spark.read.parquet(f"{base}/{n}").select(F.lit(n).alias("target"), "case_id", "row_idx",
                                                              F.array_join("layers", "+").alias("layers"), "reasons")
    return read("a").unionByName(read("b"))
