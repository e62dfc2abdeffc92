"""Benchmark: headline workloads on the telemetry view of ``events``.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Every query is forced to completion with the ``noop`` sink (all rows, all
columns computed, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from aerolens.operators import curves, evaluation as ev, segments as sg  # noqa: E402
from aerolens.operators.features import compute_features  # noqa: E402
from aerolens.operators.models import AnomalyDetector  # noqa: E402
from aerolens.plans.composed import detect  # noqa: E402
from aerolens.session import checkpoint_dir, get_session  # noqa: E402
from aerolens.sources.csv import split_by_replicate  # noqa: E402
from aerolens.sources.events_view import load_events_telemetry  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_session(f"local[{cpus}]", app="aerolens-bench", shuffle_partitions=cpus,
                        conf={"spark.driver.memory": "16g"})
    checkpoint_dir(spark, tempfile.mkdtemp(prefix="aerolens-bench-"))
    tele = load_events_telemetry(spark, sf_dir).persist()
    n_rows = tele.count()
    train, test = split_by_replicate(tele, 3)

    def q_l1_l2():
        run(detect(tele, layers=("rules", "statistical")))

    def q_features():
        run(compute_features(tele))

    def q_detect_eval():
        d = detect(tele, layers=("rules", "statistical"), with_features=True)
        g, s, p = ev.full_evaluation(d, {"alert_threshold": "rules", "alert_change": "statistical"})
        run(g); run(s); run(p)

    def q_segments():
        d = sg.with_t_rel(tele)
        run(sg.anomaly_segments(d, 21_600.0, 600.0))

    def q_curves():
        d = detect(tele, layers=("statistical",))
        s = d.select("label", F.coalesce(F.abs("z_altitude"), F.lit(0.0)).alias("score")).persist()
        run(curves.curve_summary(s, "score"))
        s.unpersist()

    def q_isolation_forest():
        run(AnomalyDetector("isolation_forest").fit(train).predict(test))

    models = {}

    def q_random_forest():
        det = AnomalyDetector("random_forest")          # 200 trees, depth 16
        models["rf"] = det.fit(train)
        run(models["rf"].predict(test))

    def q_stream_rf():
        """All three layers on the stream, L3 = the random forest above."""
        from aerolens.plans.q_stream import _streamed
        _streamed(spark, load_events_telemetry(spark, sf_dir).drop("t_us"), layers="all", model=models["rf"], sinks=("metrics",))

    def q_stream():
        """L1 + L2 + causal features on the stream."""
        from aerolens.plans.q_stream import _streamed
        _streamed(spark, load_events_telemetry(spark, sf_dir).drop("t_us"), with_features=True, sinks=("metrics",))

    plan = [("l1_l2_detect", q_l1_l2), ("window_features", q_features),
            ("detect_and_evaluate", q_detect_eval), ("anomaly_segments", q_segments),
            ("score_curves", q_curves), ("isolation_forest_fit_predict", q_isolation_forest),
            ("random_forest_fit_predict", q_random_forest), ("stream_replay", q_stream),
            ("stream_replay_with_random_forest", q_stream_rf)]
    times, errors = {}, {}
    for name, fn in plan:
        t0 = time.time()
        try:
            fn()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and keep measuring the rest
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    total = round(sum(v for v in times.values() if v is not None), 3)
    out = {"metric": "total_query_seconds", "value": total, "unit": "sec",
           "queries": times, "sf": sf, "rows": n_rows, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
