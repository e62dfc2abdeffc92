"""End-to-end batch and stream jobs on the sf0.001 tables."""

from __future__ import annotations

import os
import tempfile

from aerolens.plans.q_ingest import events_as_csv
from aerolens.plans.runners import run_batch, run_stream, stream_results
from aerolens.sources.events_view import load_events_telemetry
from aerolens.streaming.replay import write_replay
from tests.conftest import SF_SMALL


def test_run_batch(spark):
    out = tempfile.mkdtemp(prefix="aerolens-batch-")
    res = run_batch(spark, events_as_csv(spark, SF_SMALL), "isolation_forest", out_dir=out,
                    model_path=os.path.join(out, "model"), params={"n_estimators": 20})
    g = {r["layer"]: r for r in res["global"].collect()}
    assert set(g) == {"rules", "statistical", "ml"}
    n = res["scored"].count()
    assert all(r["TP"] + r["FP"] + r["FN"] + r["TN"] == n for r in g.values())
    assert res["curve_summary"].first()["auc"] is not None
    assert os.path.isdir(os.path.join(out, "metrics_global"))
    again = run_batch(spark, events_as_csv(spark, SF_SMALL), "isolation_forest",
                      model_path=os.path.join(out, "model"), load_model=True)
    assert again["global"].count() == 3
    res["scored"].unpersist()


def test_run_stream(spark):
    base = tempfile.mkdtemp(prefix="aerolens-runstream-")
    view = load_events_telemetry(spark, SF_SMALL).drop("t_us")
    src = os.path.join(base, "src")
    write_replay(view, src, chunks=3, files_per_chunk=2)
    run_stream(spark, src, view.schema, os.path.join(base, "out"), os.path.join(base, "ckpt"),
               layers="rules,statistical", files_per_trigger=2)
    alerts, metrics = stream_results(spark, os.path.join(base, "out"))
    m = metrics.first()
    assert m["n_samples"] == view.count()
    assert alerts.count() == m["n_alerts"]


def test_runner_cli(spark, capsys):
    from aerolens.plans.runners import main
    out = tempfile.mkdtemp(prefix="aerolens-cli-")
    main(["batch", "--csv", events_as_csv(spark, SF_SMALL), "--algorithm", "isolation_forest",
          "--out", out])
    printed = capsys.readouterr().out
    assert "statistical" in printed and "auc" in printed
    assert os.path.isdir(os.path.join(out, "metrics_per_scenario"))
