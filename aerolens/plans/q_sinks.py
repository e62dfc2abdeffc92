"""Queries of the sinks (S5, S6, S7, S8), read back through Spark."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from aerolens.operators import evaluation as ev
from aerolens.operators.models import AnomalyDetector
from aerolens.plans import sqlkit as q
from aerolens.plans.composed import detect
from aerolens.plans.q_eval import DET_CTE, LAYERS, _global_sql, _group_sql
from aerolens.plans.q_layers import L1_REASONS_SQL
from aerolens.plans.registry import r6, register, tele
from aerolens.session import checkpoint_dir
from aerolens.sources.csv import split_by_replicate
from aerolens.sources.sinks import console_lines, write_metric_tables


def _scratch(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:10]}")


def _scored(spark, sf_dir):
    return detect(tele(spark, sf_dir), layers=("rules", "statistical"), combine=True)


_LINE_CTE = DET_CTE + f""",
al as (select *, {L1_REASONS_SQL} as alert_reasons from det),
lines as (select t_us, case_id, row_idx, label,
    concat_ws('+', case when alert_threshold then 'rules' end, case when alert_change then 'statistical' end) as layers,
    concat_ws('|', nullif(alert_reasons, ''), nullif(change_reasons, '')) as reasons
  from al where alert_threshold or alert_change)"""


@register("s5_console_lines", q.with_view("""
select '[ALERT ' || strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S.%f') || '+00:00' || '] case='
  || cast(case_id as varchar) || ' row=' || cast(row_idx as varchar) || ' layers=' || layers
  || ' score=-' || ' reasons=' || case when reasons = '' then '-' else reasons end
  || case when label = 1 then '  [TP]' when label is not null then '  [FP]' else '' end as line
from lines""", _LINE_CTE))
def s5_console_lines(spark, sf_dir):
    return console_lines(_scored(spark, sf_dir))


def _written(spark, sf_dir, name):
    """One of the three metric tables after a round through CSV."""
    d = _scored(spark, sf_dir)
    out = _scratch(spark, "metrics")
    write_metric_tables(*ev.full_evaluation(d, LAYERS), out)
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/{name}")


@register("s7_metric_csv", q.with_view(_global_sql(), DET_CTE))
def s7_metric_csv(spark, sf_dir):
    back = _written(spark, sf_dir, "metrics_global")
    return back.select("layer", *[F.col(c).cast("bigint").alias(c) for c in ("TP", "FP", "FN", "TN")],
                       *[r6(F.col(c).cast("double")).alias(c) for c in ("precision", "recall", "F1")])


def _groups(back, key):
    cols = [key, F.col("n").cast("bigint").alias("n")]
    for c in LAYERS:
        cols += [F.col(f"{c}_hits").cast("bigint").alias(f"{c}_hits"), r6(F.col(f"{c}_rate").cast("double")).alias(f"{c}_rate"),
                 F.col(f"{c}_text").cast("string").alias(f"{c}_text")]
    return back.select(*cols)


@register("s7_scenario_csv", q.with_view(_group_sql("tamper_type", "tamper_type <> 'normal'"), DET_CTE))
def s7_scenario_csv(spark, sf_dir):
    return _groups(_written(spark, sf_dir, "metrics_per_scenario"), "tamper_type")


@register("s7_profile_csv", q.with_view(_group_sql("profile", "label = 1 and profile in ('subtle', 'balanced', 'strong')"), DET_CTE))
def s7_profile_csv(spark, sf_dir):
    return _groups(_written(spark, sf_dir, "metrics_per_profile"), "profile")


@register("s8_model_roundtrip", q.with_view("select event_id, true as same_score from t where replicate = 3"))
def s8_model_roundtrip(spark, sf_dir):
    """Save a fitted detector, load it back, check the scores are identical (m4-m8 do so for every algorithm)."""
    train, test = split_by_replicate(tele(spark, sf_dir), 3)
    det = AnomalyDetector("isolation_forest").fit(train)
    path = _scratch(spark, "model")
    det.save(spark, path)
    a = det.predict(test).select("event_id", F.col("ml_score").alias("s1"))
    b = AnomalyDetector.load(spark, path).predict(test).select("event_id", F.col("ml_score").alias("s2"))
    return a.join(b, "event_id").select("event_id", (F.col("s1") == F.col("s2")).alias("same_score"))
