"""Queries of score curves and thresholds.

Score = the largest |z| of the L2 channels altitude, speed and heading (0
when none is defined), a real per-sample anomaly score of the pipeline.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolens.operators import curves as cv
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.plans import sqlkit as q
from aerolens.plans.q_layers import L2_CTE
from aerolens.plans.registry import r6, register, tele

_SCORE_SQL = q.r6("greatest(coalesce(abs(z_altitude), 0.0), coalesce(abs(z_speed), 0.0), "
                  "coalesce(abs(z_heading), 0.0))")


def scored(spark, sf_dir):
    d = tele(spark, sf_dir).transform(detect_sudden_changes)
    s = F.greatest(*[F.coalesce(F.abs(F.col(f"z_{c}")), F.lit(0.0))
                     for c in ("altitude", "speed", "heading")])
    return d.select("label", r6(s).alias("score"))


def _curve_cte(direction: str) -> str:
    sign = "" if direction == "high" else "-"
    return L2_CTE + f""",
sc as (select {_SCORE_SQL} as score, label from l2),
g as (select {sign}score as s, count(*) filter (where label = 1) as pos,
    count(*) filter (where label = 0) as neg from sc where label is not null group by s),
c as (select *, sum(pos) over (order by s rows between unbounded preceding and current row) as pos_le,
    sum(neg) over (order by s rows between unbounded preceding and current row) as neg_le,
    sum(pos) over () as P, sum(neg) over () as N from g),
cur as (select {sign}s as threshold, cast(pos as bigint) as pos, cast(neg as bigint) as neg,
    cast(P - pos_le + pos as bigint) as tp, cast(N - neg_le + neg as bigint) as fp,
    cast(P as bigint) as P, cast(N as bigint) as N, cast(pos_le as bigint) as pos_le,
    cast(neg_le as bigint) as neg_le from c)"""


@register("w19_score_curve", q.with_view(
    "select threshold, pos, neg, tp, fp, P, N from cur", _curve_cte("high")))
def w19_score_curve(spark, sf_dir):
    return cv.score_table(scored(spark, sf_dir), "score").drop("pos_le", "neg_le")


@register("w19_score_curve_low", q.with_view(
    "select threshold, pos, neg, tp, fp, P, N from cur", _curve_cte("low")))
def w19_score_curve_low(spark, sf_dir):
    return cv.score_table(scored(spark, sf_dir), "score", direction="low").drop("pos_le", "neg_le")


@register("a11_roc_curve", q.with_view(
    f"select threshold, {q.r6('case when N <> 0 then cast(fp as double) / N else 0.0 end')} as fpr, "
    f"{q.r6('case when P <> 0 then cast(tp as double) / P else 0.0 end')} as tpr from cur "
    "union all select null, 0.0, 0.0", _curve_cte("high")))
def a11_roc_curve(spark, sf_dir):
    r = cv.roc_curve(scored(spark, sf_dir), "score")
    return r.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


_AUC = ("case when max(P) > 0 and max(N) > 0 then sum(neg * (cast(P - pos_le as double) + pos / 2.0))"
        " / (cast(max(P) as double) * max(N)) end")


@register("a12_roc_auc", q.with_view(f"select {q.r6(_AUC)} as auc from cur", _curve_cte("high")))
def a12_roc_auc(spark, sf_dir):
    return cv.roc_auc(scored(spark, sf_dir), "score").select(r6("auc").alias("auc"))


@register("a12_roc_auc_low", q.with_view(f"select {q.r6(_AUC)} as auc from cur", _curve_cte("low")))
def a12_roc_auc_low(spark, sf_dir):
    return cv.roc_auc(scored(spark, sf_dir), "score", direction="low").select(r6("auc").alias("auc"))


# rank form of the AUC (Mann-Whitney with average ranks) as a second oracle
@register("a12_roc_auc_rank", q.with_view(f"""
select {q.r6('(sum(case when label = 1 then rk end) - cast(count(*) filter (where label = 1) as double) * '
             '(count(*) filter (where label = 1) + 1) / 2.0) / (cast(count(*) filter (where label = 1) as double) * '
             'count(*) filter (where label = 0))')} as auc
from (select label, (rank() over (order by score) + rank() over (order by score) + count(*) over (partition by score) - 1) / 2.0 as rk
      from (select {_SCORE_SQL} as score, label from l2) x) y""", L2_CTE))
def a12_roc_auc_rank(spark, sf_dir):
    return cv.roc_auc(scored(spark, sf_dir), "score").select(r6("auc").alias("auc"))


_PR = """pr as (select threshold,
    case when tp + fp <> 0 then cast(tp as double) / (tp + fp) else 0.0 end as precision,
    case when P = 0 then 1.0 else cast(tp as double) / P end as recall, pos, P from cur),
prf as (select *, 2.0 * precision * recall / (precision + recall + 1e-12) as f1 from pr)"""


@register("a14_pr_curve", q.with_view(
    f"select threshold, {q.r6('precision')} as precision, {q.r6('recall')} as recall, {q.r6('f1')} as f1 from prf",
    _curve_cte("high") + ",\n" + _PR))
def a14_pr_curve(spark, sf_dir):
    c = cv.pr_curve(scored(spark, sf_dir), "score")
    return c.select("threshold", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@register("a14_max_f1_threshold", q.with_view(
    f"select threshold, {q.r6('f1')} as f1, {q.r6('precision')} as precision, {q.r6('recall')} as recall "
    "from prf order by f1 desc, threshold asc limit 1", _curve_cte("high") + ",\n" + _PR))
def a14_max_f1_threshold(spark, sf_dir):
    b = cv.max_f1_threshold(scored(spark, sf_dir), "score")
    return b.select("threshold", *[r6(x).alias(x) for x in ("f1", "precision", "recall")])


@register("a15_average_precision", q.with_view(
    f"select {q.r6('case when max(P) > 0 then sum(pos * precision) / max(P) else 0.0 end')} as ap from prf",
    _curve_cte("high") + ",\n" + _PR))
def a15_average_precision(spark, sf_dir):
    return cv.average_precision(scored(spark, sf_dir), "score").select(r6("ap").alias("ap"))


@register("a16_percentile_threshold", q.with_view(
    f"select {q.r6('quantile_cont(score, 0.02)')} as threshold from (select {_SCORE_SQL} as score from l2) x",
    L2_CTE))
def a16_percentile_threshold(spark, sf_dir):
    return cv.percentile_threshold(scored(spark, sf_dir), "score", 2.0) \
        .select(r6("threshold").alias("threshold"))


@register("a12_curve_summary", q.with_view(f"""
select {q.r6(_AUC)} as auc,
  {q.r6('case when max(P) > 0 then sum(pos * precision) / max(P) else 0.0 end')} as ap,
  arg_max(threshold, struct_pack(f := f1, t := -threshold)) as max_f1_threshold,
  {q.r6('max(f1)')} as max_f1
from (select c.*, pr.precision, pr.f1 from cur c join prf pr on c.threshold = pr.threshold) x""",
    _curve_cte("high") + ",\n" + _PR))
def a12_curve_summary(spark, sf_dir):
    """AUC, AP and the max-F1 threshold from one prefix-sum pass."""
    s = cv.curve_summary(scored(spark, sf_dir), "score")
    return s.select(r6("auc").alias("auc"), r6("ap").alias("ap"), "max_f1_threshold",
                    r6("max_f1").alias("max_f1"))
