"""L1, L2 and features: hand-made fixtures, brute force, hot-flight split."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolens.operators import frames
from aerolens.operators.features import compute_features
from aerolens.operators.rules import detect_threshold_violations
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.plans.composed import detect
from aerolens.schema import FEATURE_NAMES
from tests.conftest import make_rows


def by_row(df, cols):
    return {r["row_idx"]: tuple(r[c] for c in cols) for r in df.collect()}


# ------------------------------------------------------------------ L1
def test_rules_reasons_and_missing(spark):
    rows = [dict(altitude=-6.0), dict(altitude=float("nan")), dict(speed=31.0, heading=360.0),
            dict(altitude=None), dict(latitude=91.0, longitude=-181.0), dict()]
    df = make_rows(spark, rows).withColumn("altitude", F.nanvl("altitude", F.lit(None)))
    out = by_row(df.transform(detect_threshold_violations), ["alert_threshold", "alert_reasons"])
    assert out[1] == (True, "altitude_below_min")
    assert out[2] == (False, "")
    assert out[3] == (True, "speed_above_max|heading_above_max")
    assert out[4] == (False, "")
    assert out[5] == (True, "latitude_above_max|longitude_below_min")
    assert out[6] == (False, "")


def test_rules_custom_thresholds_replace(spark):
    df = make_rows(spark, [dict(altitude=20.0)])
    t = {"altitude_min": 0.0, "altitude_max": 10.0, "speed_max": 30.0, "heading_min": 0.0,
         "heading_max": 360.0, "latitude_min": -90.0, "latitude_max": 90.0,
         "longitude_min": -180.0, "longitude_max": 180.0}
    out = df.transform(lambda d: detect_threshold_violations(d, t)).first()
    assert out["alert_reasons"] == "altitude_above_max"
    with pytest.raises(KeyError):
        detect_threshold_violations(df, {"altitude_min": 0.0})


# ------------------------------------------------------------------ L2
def test_zscore_step_bound(spark):
    rows = [dict(altitude=100.0, speed=5.0, latitude=52.0, longitude=21.0) for _ in range(40)]
    rows[34]["altitude"] = 160.0
    out = by_row(detect_sudden_changes(make_rows(spark, rows)), ["z_altitude", "change_reasons"])
    z, reasons = out[35]
    assert z == pytest.approx(29 / math.sqrt(30), rel=1e-9)
    assert "sudden_altitude" in reasons
    assert out[14][0] is None and out[16][0] == pytest.approx(0.0)  # 15 values from row 16


def test_heading_wrap(spark):
    rows = [dict(heading=h) for h in (350.0, 10.0, 350.0, 179.0, -179.0 + 360.0)]
    d = detect(make_rows(spark, rows), layers=("statistical",), keep_internal=True)
    out = by_row(d, ["_d_heading"])
    assert out[2][0] == pytest.approx(20.0) and out[3][0] == pytest.approx(-20.0)
    assert out[5][0] == pytest.approx(2.0)


def test_freeze_from_row_4(spark):
    rows = [dict(speed=5.0, heading=90.0, latitude=52.0, longitude=21.0) for _ in range(8)]
    out = by_row(detect_sudden_changes(make_rows(spark, rows)), ["alert_change", "change_reasons"])
    assert [out[i][0] for i in range(1, 9)] == [False, False, False] + [True] * 5
    assert out[4][1] == "freeze_detected"


def test_freeze_after_motion_needs_full_window(spark):
    rows = [dict(speed=5.0 + i, heading=90.0) for i in range(6)] + \
        [dict(speed=20.0, heading=90.0, latitude=52.1, longitude=21.0) for _ in range(10)]
    out = by_row(detect_sudden_changes(make_rows(spark, rows)), ["change_reasons"])
    frozen = [i for i, (r,) in out.items() if "freeze_detected" in r]
    # rows 7.. have constant values; gps_step of row 7 still moves -> needs 6 quiet rows
    assert min(frozen) == 13


# --------------------------------------------------------- brute force
def _pandas_layers(pdf: pd.DataFrame, keys=("replicate", "case_id")) -> pd.DataFrame:
    out = []
    for _, g in pdf.sort_values(["row_idx", "_ord"]).groupby(list(keys), sort=False):
        g = g.copy()
        lat, lon = np.radians(g.latitude.values), g.longitude.values
        a = (np.sin(np.diff(lat, prepend=np.nan) / 2) ** 2
             + np.cos(np.roll(lat, 1)) * np.cos(lat) * np.sin(np.radians(np.diff(lon, prepend=np.nan)) / 2) ** 2)
        gps = 2 * 6371000.0 * np.arcsin(np.sqrt(a))
        gps[0] = np.nan
        d = {"altitude": g.altitude.diff(), "speed": g.speed.diff(),
             "heading": ((g.heading.diff() + 180) % 360) - 180, "gps_step": pd.Series(gps, index=g.index)}
        for k, v in d.items():
            m, s = v.rolling(30, min_periods=15).mean(), v.rolling(30, min_periods=15).std()
            g[f"z_{k}"] = (v - m) / s.clip(lower=0.05)
        r8 = lambda s, op: getattr(s.rolling(8, min_periods=4), op)()
        g["alt_mean"] = r8(g.altitude, "mean")
        g["spd_std"] = r8(g.speed, "std")
        g["alt_slope"] = (g.altitude - g.altitude.shift(7)) / 8
        g["hdg_diff_abs_max"] = r8(d["heading"].abs(), "max")
        dt = g.timestamp.diff().dt.total_seconds()
        g["speed_vs_gps"] = r8((g.speed - d["gps_step"] / dt.replace(0, np.nan)).abs(), "mean")
        g["dt_mean"] = r8(dt, "mean")
        for c in ("alt_mean", "spd_std", "alt_slope", "hdg_diff_abs_max", "speed_vs_gps", "dt_mean"):
            g[c] = g[c].bfill().fillna(0.0)
        out.append(g)
    return pd.concat(out)


def _random_flights(spark, n_flights=4, n=60, seed=7):
    rng = np.random.default_rng(seed)
    rows, order = [], 0
    for f in range(n_flights):
        t = 0.0
        for i in range(1, n + 1):
            t += float(rng.choice([0.1, 0.1, 0.0, 2.2]))
            alt = None if rng.random() < 0.08 else float(rng.normal(50, 5))
            rows.append(dict(case_id=f % 3, replicate=f // 3, row_idx=i, _ord=order,
                             altitude=alt, speed=float(rng.normal(10, 1)),
                             heading=float(rng.uniform(0, 360)),
                             latitude=52 + float(rng.normal(0, 1e-4)), longitude=21.0,
                             timestamp=pd.Timestamp("2024-01-01", tz="UTC").to_pydatetime()
                             + pd.Timedelta(seconds=t).to_pytimedelta()))
            order += 1
    rng.shuffle(rows)
    return make_rows(spark, rows)


CHECK = ["z_altitude", "z_speed", "z_heading", "z_gps_step", "alt_mean", "spd_std", "alt_slope",
         "hdg_diff_abs_max", "speed_vs_gps", "dt_mean"]


def _compare(a: pd.DataFrame, b: pd.DataFrame, cols):
    key = ["replicate", "case_id", "row_idx"]
    m = a.merge(b, on=key, suffixes=("_a", "_b"))
    assert len(m) == len(a) == len(b)
    for c in cols:
        x, y = m[f"{c}_a"].astype(float).values, m[f"{c}_b"].astype(float).values
        assert np.allclose(x, y, atol=1e-9, equal_nan=True), c


def test_brute_force_layers(spark):
    df = _random_flights(spark)
    got = detect(df, layers=("statistical",), with_features=True).toPandas()
    exp = _pandas_layers(df.toPandas())
    _compare(got, exp, CHECK)


def test_hot_flight_split_features_only(spark):
    # halo 9 with chunks of 10 rows: many chunk borders, backfill carried across
    df = _random_flights(spark, n_flights=3, n=80, seed=5)
    plain = compute_features(df, hot_rows=None).toPandas()
    split = compute_features(df, hot_rows=20, chunk_rows=10).toPandas()
    _compare(plain, split, list(FEATURE_NAMES))


@pytest.mark.parametrize("chunk_rows", [32, 40])
def test_hot_flight_split_is_exact(spark, chunk_rows):
    df = _random_flights(spark, n_flights=3, n=80, seed=11)
    plain = detect(df, layers=("statistical",), with_features=True, hot_rows=None).toPandas()
    split = detect(df, layers=("statistical",), with_features=True, hot_rows=50,
                   chunk_rows=chunk_rows, bucket_span=16).toPandas()
    _compare(plain, split, CHECK + list(FEATURE_NAMES) + ["alert_change"])


def test_staging_plain_when_no_hot_flight(spark):
    df = _random_flights(spark, n_flights=2, n=10)
    staged, lay = frames.stage(df, ("replicate", "case_id"), hot_rows=1000)
    assert not lay.split and frames.CHUNK not in staged.columns


def test_one_exchange_for_all_layers(spark):
    df = _random_flights(spark, n_flights=2, n=10)
    out = detect(df, layers=("rules", "statistical"), with_features=True, hot_rows=None,
                 fill="causal")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_features_short_flight_min_periods(spark):
    rows = [dict(altitude=float(a)) for a in (1, 3, 4)]
    out = compute_features(make_rows(spark, rows), fill="none").orderBy("row_idx").collect()
    assert all(r["alt_mean"] is None for r in out)   # 3 < 4 values
    assert all(r["sample_var_score"] == 0.0 for r in out)
    filled = compute_features(make_rows(spark, rows)).orderBy("row_idx").collect()
    assert all(r["alt_mean"] == 0.0 for r in filled)


def test_features_backfill_vs_causal(spark):
    rows = [dict(altitude=float(a)) for a in (1, 2, 3, 4, 5, 6)]
    bf = compute_features(make_rows(spark, rows)).orderBy("row_idx").collect()
    ca = compute_features(make_rows(spark, rows), fill="causal").orderBy("row_idx").collect()
    assert [r["alt_mean"] for r in bf[:4]] == [2.5] * 4
    assert [r["alt_mean"] for r in ca[:4]] == [0.0, 0.0, 0.0, 2.5]


def test_unknown_rolling_op():
    from aerolens.functions.rolling import rolling
    from pyspark.sql import Window
    with pytest.raises(ValueError):
        rolling(F.col("x"), Window.orderBy("x"), 3, "median")


def test_parity_mode_single_key_interleaves_replicates(spark):
    # two replicates of one case with equal row_idx: in ("case_id",) mode they
    # form one series ordered by (row_idx, _ord) - the reference's behaviour
    rows = []
    for i in range(1, 21):
        rows.append(dict(case_id=5, replicate=0, row_idx=i, _ord=2 * i, altitude=float(i)))
        rows.append(dict(case_id=5, replicate=1, row_idx=i, _ord=2 * i + 1, altitude=float(100 + i)))
    df = make_rows(spark, rows)
    got = detect(df, layers=("statistical",), flight_keys=("case_id",), keep_internal=True) \
        .orderBy("row_idx", "_ord").toPandas()
    alt = got["altitude"].to_numpy()
    exp = np.r_[np.nan, np.diff(alt)]
    assert np.allclose(got["_d_altitude"].to_numpy(), exp, equal_nan=True)
    per_rep = detect(df, layers=("statistical",), keep_internal=True).toPandas()
    assert set(per_rep["_d_altitude"].dropna().round(9)) == {1.0}
