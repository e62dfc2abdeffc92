"""CSV ingest traits, layer selection, detectors and persistence."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from aerolens.operators.combine import combine_layers, parse_layers
from aerolens.operators.inject import inject_anomalies, injection_plan
from aerolens.operators.models import AnomalyDetector
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.sources import csv as ingest
from aerolens.sources.events_view import load_events_telemetry
from tests.conftest import SF_SMALL

HEADER = ("replicate,profile,case_id,case_name,row_idx,label,tamper_type,timestamp,latitude,"
          "longitude,altitude,speed,heading,source,original_row_idx")


def _csv(lines, header=HEADER):
    d = tempfile.mkdtemp(prefix="aerolens-csv-")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write(header + "\n" + "\n".join(lines) + "\n")
    return p


def test_csv_traits(spark):
    lines = [
        "3,subtle,7,c7,0,0,normal,1970-01-01T00:00:00+00:00,52,21,10,5,90,S,0",
        "3,subtle,7,c7,1,0,normal,2024-09-15T20:05:41.726000+00:00,52,21,abc,5,90,S,1",
        "3,subtle,7,c7,2,0,normal,2024-09-15T20:05:42+00:00,52,21,NaN,5,90,S,2",
        "3,subtle,7,c7,3,1,injection,not-a-time,52,21,,5,90,S,3",
        "3,subtle,7,c7,3,1,injection,2024-09-15T20:05:43.5+00:00,52,21,11,5,90,S,4",
        ",strong,8,c8,1,0,normal,2024-09-15T20:00:00+00:00,52,21,1,1,1,S,5",
    ]
    df = ingest.load_dataset(spark, _csv(lines))
    rows = {r["original_row_idx"]: r for r in df.collect()}
    assert 0 not in rows                                  # row_idx 0 dropped
    assert rows[1]["altitude"] is None                    # bad token
    assert rows[2]["altitude"] is None                    # NaN text
    assert rows[3]["altitude"] is None and rows[3]["timestamp"] is None
    assert rows[2]["t_rel"] == pytest.approx(0.274)       # whole second vs fraction
    assert {rows[3]["row_idx"], rows[4]["row_idx"]} == {3}  # duplicate row_idx kept
    assert rows[5]["replicate"] is None
    train, test = ingest.split_by_replicate(df, 3)
    assert train.count() == 1 and test.count() == 4       # NULL replicate -> train


def test_csv_missing_column_and_path(spark):
    p = _csv(["3,7,1"], header="replicate,case_id,row_idx")
    with pytest.raises(ValueError, match="Missing columns"):
        ingest.load_dataset(spark, p)
    with pytest.raises(Exception):
        ingest.load_dataset(spark, "/nonexistent/file.csv")


def test_layer_parsing():
    assert parse_layers("all") == ("rules", "statistical", "ml")
    assert parse_layers("ML, rules") == ("rules", "ml")
    with pytest.raises(ValueError):
        parse_layers("rules,foo")
    with pytest.raises(ValueError):
        parse_layers([])


def test_combine_layers(spark):
    df = spark.createDataFrame([(True, "altitude_below_min", False, "", None),
                                (True, "speed_negative", True, "freeze_detected", True),
                                (False, "", False, "", False)],
                               "alert_threshold boolean, alert_reasons string, alert_change boolean, "
                               "change_reasons string, alert_ml boolean")
    out = combine_layers(df).collect()
    assert out[0]["layers"] == ["rules"] and out[0]["reasons"] == "altitude_below_min"
    assert out[1]["layers"] == ["rules", "statistical", "ml"]
    assert out[1]["reasons"] == "speed_negative|freeze_detected"
    assert out[2]["layers"] == [] and out[2]["alert"] is False


@pytest.fixture(scope="module")
def tele(spark):
    return load_events_telemetry(spark, SF_SMALL).persist()


def test_unknown_algorithm_and_predict_before_fit(tele):
    with pytest.raises(ValueError):
        AnomalyDetector("kmeans")
    with pytest.raises(RuntimeError):
        AnomalyDetector("lof").predict(tele)


@pytest.mark.parametrize("algo,params", [
    ("isolation_forest", {"n_estimators": 20}),
    ("lof", {"n_neighbors": 5}),
    ("one_class_svm", {}),
    ("one_class_svm", {"solver": "features", "iters": 10, "n_components": 32}),
    ("random_forest", {"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 2}),
    ("xgboost", {"n_estimators": 5, "max_depth": 3}),
])
def test_detectors_fit_predict_save_load(spark, tele, algo, params):
    train, test = ingest.split_by_replicate(tele, 3)
    det = AnomalyDetector(algo, params=params).fit(train)
    out = det.predict(test)
    assert out.count() == test.count()
    assert out.filter(F.col("ml_score").isNull()).count() == 0
    if det.supervised:
        assert det.optimal_threshold is not None
    else:
        assert det.threshold is not None
        # about threshold_percentile % of the clean training rows alert
    path = tempfile.mkdtemp(prefix="aerolens-model-")
    det.save(spark, path)
    again = AnomalyDetector.load(spark, path)
    a = det.predict(test).select("event_id", F.col("ml_score").alias("a"))
    b = again.predict(test).select("event_id", F.col("ml_score").alias("b"))
    assert a.join(b, "event_id").filter(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0
    override = det.predict(test, ml_threshold=0.0 if det.supervised else 1e9)
    assert override.filter(~F.col("alert_ml")).count() == 0


def test_injected_anomalies_found_by_l2(spark):
    # a smooth flight: constant climb, so a +60 m step stands out
    from tests.conftest import make_rows
    rows = [dict(case_id=1, altitude=100.0 + 0.1 * i, speed=10.0, heading=90.0) for i in range(120)]
    df = make_rows(spark, rows)
    plan = injection_plan(df, pool=["altitude_spike"], n_anomalies=1, segment_seconds=0.5)
    out = detect_sudden_changes(inject_anomalies(df, plan))
    hit = out.filter((F.col("label") == 1) & F.col("change_reasons").contains("sudden_altitude")).count()
    assert plan.count() == 1 and hit >= 1
    with pytest.raises(ValueError):
        injection_plan(df, pool=["teleport"])


def test_subsample_exact_and_repeatable(spark, tele):
    from aerolens.operators.models.sampling import row_hash, subsample
    a = {r["event_id"] for r in subsample(tele, 50, seed=7).collect()}
    b = {r["event_id"] for r in subsample(tele, 50, seed=7).collect()}
    brute = {r["event_id"] for r in tele.withColumn("_h", row_hash(tele, 7)).orderBy("_h").limit(50).collect()}
    assert a == b == brute and len(a) == 50
    assert subsample(tele, 10 ** 9).count() == tele.count()


def test_error_contract(spark, tele):
    import warnings as _w
    from aerolens.operators.combine import validate_layers
    from aerolens.operators.segments import case_timeline, with_t_rel
    from aerolens.schema import FEATURE_NAMES
    with pytest.raises(ValueError, match="model"):
        validate_layers("ml", None)
    with pytest.raises(ValueError, match="shape"):
        injection_plan(tele, shape="zigzag")
    with pytest.raises(ValueError, match="no data"):
        case_timeline(with_t_rel(tele), 10 ** 9, strict=True)
    train, test = ingest.split_by_replicate(tele, 3)
    det = AnomalyDetector("isolation_forest", params={"n_estimators": 5}).fit(train)
    from aerolens.operators.features import compute_features
    feats = compute_features(test)
    shuffled = feats.select(*[c for c in feats.columns if c not in FEATURE_NAMES],
                            *reversed(FEATURE_NAMES))
    with _w.catch_warnings(record=True) as caught:
        _w.simplefilter("always")
        a = det.predict(shuffled).select("event_id", "ml_score")
    assert any("order" in str(w.message) for w in caught)
    b = det.predict(feats).select("event_id", F.col("ml_score").alias("s2"))
    assert a.join(b, "event_id").filter(F.col("ml_score") != F.col("s2")).count() == 0
