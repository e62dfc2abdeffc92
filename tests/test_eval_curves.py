"""Evaluation and curve operators against brute force on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import curves, evaluation as ev


def _scores(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")


def _bf_curve(y, s):
    out = {}
    for t in sorted(set(s)):
        tp = sum(1 for a, b in zip(y, s) if b >= t and a == 1)
        fp = sum(1 for a, b in zip(y, s) if b >= t and a == 0)
        out[t] = (tp, fp)
    return out


def _bf_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _bf_max_f1(y, s):
    P = sum(y)
    best = None
    for t, (tp, fp) in sorted(_bf_curve(y, s).items()):
        p = tp / (tp + fp)
        r = tp / P if P else 1.0
        f1 = 2 * p * r / (p + r + 1e-12)
        if best is None or f1 > best[1]:
            best = (t, f1)
    return best


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 7])
def test_curves_match_brute_force(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    y = list(rng.integers(0, 2, 300))
    s = list(np.round(rng.normal(0, 1, 300) + 0.8 * np.array(y), 1))   # many ties
    df = _scores(spark, y, s)
    kw = {"rows_per_bucket": rows_per_bucket}
    tab = {r["threshold"]: (r["tp"], r["fp"]) for r in curves.score_table(df, "score", **kw).collect()}
    assert tab == _bf_curve(y, s)
    auc = curves.roc_auc(df, "score", **kw).first()["auc"]
    assert auc == pytest.approx(_bf_auc(y, s), abs=1e-12)
    low = curves.roc_auc(df, "score", direction="low", **kw).first()["auc"]
    assert low == pytest.approx(1 - _bf_auc(y, s), abs=1e-12)
    t, f1 = _bf_max_f1(y, s)
    got = curves.max_f1_threshold(df, "score", **kw).first()
    assert got["threshold"] == t and got["f1"] == pytest.approx(f1)
    P = sum(y)
    ap = sum(sum(1 for a, b in zip(y, s) if a == 1 and b == th) / P * tp / (tp + fp)
             for th, (tp, fp) in _bf_curve(y, s).items())
    assert curves.average_precision(df, "score", **kw).first()["ap"] == pytest.approx(ap)


def test_percentile_exact(spark):
    vals = [1.0, 2.0, 5.0, 5.0, 7.0, 100.0, -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "score double")
    for pct in (2.0, 50.0, 90.0):
        got = curves.percentile_threshold(df, "score", pct).first()["threshold"]
        assert got == pytest.approx(float(np.percentile(vals, pct)))


def test_max_f1_default_when_empty(spark):
    df = spark.createDataFrame([], "label int, score double")
    assert curves.max_f1_threshold(df, "score").first()["threshold"] == 0.5


def _alerts(spark, rows):
    return spark.createDataFrame(rows, "label int, tamper_type string, profile string, "
                                       "alert_threshold boolean, alert_change boolean")


def test_confusion_zero_division(spark):
    df = _alerts(spark, [(0, "normal", "subtle", False, False), (0, "normal", "strong", False, False)])
    m = ev.confusion(df, "alert_change").first()
    assert (m["TP"], m["FP"], m["TN"], m["FN"]) == (0, 0, 2, 0)
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)


def test_scenario_and_profile_tables(spark):
    rows = ([(1, "altitude_spike", "subtle", True, False)] * 1
            + [(1, "altitude_spike", "subtle", False, False)] * 7
            + [(0, "coordinate_jump", "strong", True, True)] * 3
            + [(0, "normal", "balanced", False, True)] * 5)
    df = _alerts(spark, rows)
    lay = {"alert_threshold": "rules", "alert_change": "statistical"}
    sc = {r["tamper_type"]: r for r in ev.per_scenario(df, lay).collect()}
    assert set(sc) == {"altitude_spike", "coordinate_jump"}
    assert sc["altitude_spike"]["alert_threshold_text"] == "1/8 (12%)"   # half to even
    assert sc["coordinate_jump"]["alert_change_text"] == "3/3 (100%)"
    pr = ev.per_profile(df, lay).collect()
    assert [r["profile"] for r in pr] == ["subtle"]
    g = {r["layer"]: r for r in ev.global_metrics(df, lay).collect()}
    assert (g["rules"]["TP"], g["rules"]["FP"], g["rules"]["FN"], g["rules"]["TN"]) == (1, 3, 7, 5)


def test_choose_case(spark):
    df = spark.createDataFrame([(5,), (9,)], "case_id bigint")
    assert ev.choose_case_id(df, 9).first()["case_id"] == 9
    assert ev.choose_case_id(df, 550).first()["case_id"] == 5
    with pytest.raises(Exception):
        ev.choose_case_id(df.filter(F.lit(False)), 1).first()


def test_curve_summary_matches_single_metrics(spark):
    rng = np.random.default_rng(9)
    y = list(rng.integers(0, 2, 200))
    s = list(np.round(rng.normal(0, 1, 200) + np.array(y), 1))
    df = _scores(spark, y, s)
    one = curves.curve_summary(df, "score").first()
    assert one["auc"] == pytest.approx(curves.roc_auc(df, "score").first()["auc"])
    assert one["ap"] == pytest.approx(curves.average_precision(df, "score").first()["ap"])
    m = curves.max_f1_threshold(df, "score").first()
    assert one["max_f1_threshold"] == m["threshold"] and one["max_f1"] == pytest.approx(m["f1"])


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 5])
def test_grouped_percentile(spark, rows_per_bucket):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(5):
        n = int(rng.integers(1, 40))
        vals = np.round(rng.normal(g, 1, n), 1)        # ties
        rows += [(g, float(v)) for v in vals]
    rows += [(9, None), (9, None)]                     # a group without values
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["p"] for r in curves.grouped_percentile(
        df, ["g"], "v", 50.0, "p", rows_per_bucket=rows_per_bucket).collect()}
    for g in range(5):
        vals = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(float(np.median(vals))), g
    assert got[9] is None


def test_sample_rate_hot_path_equals_plain(spark):
    from tests.test_layers import _random_flights
    df = _random_flights(spark, n_flights=3, n=60, seed=12)
    plain = {(r["replicate"], r["case_id"]): r["median_dt"] for r in ev.sample_rate_per_case(df).collect()}
    hot = {(r["replicate"], r["case_id"]): r["median_dt"]
           for r in ev.sample_rate_per_case(df, hot_rows=10).collect()}
    assert plain.keys() == hot.keys()
    for k in plain:
        assert hot[k] == pytest.approx(plain[k])
