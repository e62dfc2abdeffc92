"""Properties: flight isolation, partition invariance, bounds, totals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from aerolens.operators import evaluation as ev
from aerolens.plans.composed import detect
from aerolens.schema import FEATURE_NAMES
from tests.test_layers import _random_flights

COLS = ["z_altitude", "z_speed", "z_heading", "z_gps_step"] + list(FEATURE_NAMES)


def _det(df):
    return detect(df, layers=("rules", "statistical"), with_features=True, keep_internal=True)


def _frame(df):
    return df.toPandas().sort_values(["replicate", "case_id", "row_idx"]).reset_index(drop=True)


def test_flight_isolation_and_partition_invariance(spark):
    base = _random_flights(spark, n_flights=3, n=50, seed=31)
    more = _random_flights(spark, n_flights=6, n=50, seed=32).withColumn("case_id", F.col("case_id") + 100)
    a = _frame(_det(base))
    b = _frame(_det(base.unionByName(more)).filter(F.col("case_id") < 100))
    c = _frame(_det(base.repartition(7, "row_idx")))
    for other in (b, c):
        assert len(other) == len(a)
        for col in COLS + ["alert_threshold", "alert_change", "change_reasons"]:
            x, y = a[col], other[col]
            if x.dtype.kind == "f":
                assert np.allclose(x, y, equal_nan=True, atol=0), col
            else:
                assert (x == y).all(), col


def test_row_count_kept_and_z_bound_and_heading_range(spark):
    df = _random_flights(spark, n_flights=4, n=60, seed=33)
    out = _det(df)
    assert out.count() == df.count()
    pdf = out.toPandas()
    n_valid = pd.Series(pdf["_d_altitude"]).notna()
    # |z| <= (n - 1) / sqrt(n) with n <= 30 values in the window
    bound = 29 / math.sqrt(30)
    for c in ("z_altitude", "z_speed", "z_heading", "z_gps_step"):
        z = pdf[c].dropna().abs()
        assert (z <= bound + 1e-9).all(), c
    h = pdf["_d_heading"].dropna()
    assert ((h >= -180) & (h < 180)).all()
    assert n_valid.any()


def test_confusion_totals(spark):
    df = _random_flights(spark, n_flights=3, n=40, seed=34).withColumn(
        "label", (F.col("row_idx") % 3 == 0).cast("int"))
    out = _det(df)
    m = ev.confusion(out, "alert_change").first()
    assert m["TP"] + m["FP"] + m["TN"] + m["FN"] == out.filter(F.col("label").isNotNull()).count()
