"""End-to-end batch and streaming jobs built from the library operators.

``run_batch``  ingest CSV -> replicate split -> fit (or load) a detector ->
               L1 + L2 + L3 on the test split -> evaluation tables, curve
               summary, metric CSVs, case timeline.
``run_stream`` replay / file stream -> the batch operators per micro-batch
               over stored context -> scored rows, alert records, console
               lines and counters, keyed by batch id (idempotent).

Run as a Spark application: ``spark-submit aerolens/plans/runners.py batch
--csv PATH --algorithm random_forest --out DIR`` (or ``python -m
aerolens.plans.runners ...`` with a local session).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from aerolens.operators import curves, evaluation as ev
from aerolens.operators.models import AnomalyDetector
from aerolens.operators.segments import anomaly_segments, case_timeline
from aerolens.plans.composed import detect
from aerolens.schema import UNSUPERVISED
from aerolens.sources.csv import load_dataset, split_by_replicate
from aerolens.sources.sinks import write_metric_tables
from aerolens.streaming import job


def _load_or_fit(spark, algorithm, train, model_path, load_model, params):
    if load_model and model_path:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(model_path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return AnomalyDetector.load(spark, model_path)      # only a missing model is trained
    det = AnomalyDetector(algorithm, params=params).fit(train)
    if model_path:
        det.save(spark, model_path)
    return det


def run_batch(spark: SparkSession, csv_path, algorithm: str = "isolation_forest",
              out_dir: str | None = None, model_path: str | None = None,
              load_model: bool = False, case_id: int = 550, test_replicate: int = 3,
              params: dict | None = None) -> dict[str, DataFrame]:
    """The batch job; returns its result tables (lazy DataFrames; ``scored``
    is persisted, unpersist it when done)."""
    df = load_dataset(spark, csv_path)
    train, test = split_by_replicate(df, test_replicate)
    det = _load_or_fit(spark, algorithm, train, model_path, load_model, params)
    scored = detect(test, layers="all", model=det, combine=True).persist()
    glob, per_type, per_profile = ev.full_evaluation(scored)
    direction = "low" if det.algorithm in UNSUPERVISED else "high"
    summary = curves.curve_summary(scored, "ml_score", direction=direction)
    chosen = ev.choose_case_id(scored, case_id).first()["case_id"]
    out = {
        "summary": ev.summarize(df),
        "tamper_counts": ev.value_counts(df, "tamper_type"),
        "profile_counts": ev.value_counts(df, "profile"),
        "scored": scored,
        "global": glob, "per_scenario": per_type, "per_profile": per_profile,
        "operating_points": ev.operating_points(scored),
        "curve_summary": summary,
        "roc": curves.roc_curve(scored, "ml_score", direction=direction),
        "segments": anomaly_segments(scored),
        "timeline": case_timeline(scored, chosen),
    }
    if out_dir:
        write_metric_tables(glob, per_type, per_profile, out_dir)
        out["roc"].write.mode("overwrite").parquet(f"{out_dir}/roc")
        summary.write.mode("overwrite").json(f"{out_dir}/curve_summary")
    return out


def run_stream(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint: str,
               model: AnomalyDetector | None = None, layers="all", files_per_trigger: int = 1, **options):
    """The streaming job over a folder of Parquet files; the query (awaited when bounded).

    ``options`` are those of :func:`aerolens.streaming.job.stream_detect`:
    thresholds, stat_config, ml_threshold, case_ids, sinks, buffer_size and
    others.  A layer ``ml`` without a model is an error.
    """
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", int(files_per_trigger))
           .parquet(source_dir))
    return job.stream_detect(src, out_dir, checkpoint, layers=layers, model=model, **options)


def stream_results(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(alerts, metrics with precision / recall / F1) written by ``run_stream``."""
    alerts = spark.read.schema(job.ALERT_READ_SCHEMA).json(f"{out_dir}/alerts")
    return alerts, job.read_metrics(spark, f"{out_dir}/metrics")


def main(argv=None):
    ap = argparse.ArgumentParser(description="telemetry anomaly detection on Spark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("batch")
    b.add_argument("--csv", required=True)
    b.add_argument("--algorithm", default="isolation_forest")
    b.add_argument("--out", default=None)
    b.add_argument("--model", default=None)
    b.add_argument("--load", action="store_true")
    b.add_argument("--case", type=int, default=550)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    res = run_batch(spark, args.csv, args.algorithm, args.out, args.model, args.load, args.case)
    res["global"].show(truncate=False)
    res["per_scenario"].show(truncate=False)
    res["per_profile"].show(truncate=False)
    res["curve_summary"].show(truncate=False)


if __name__ == "__main__":
    main()


__all__ = ["run_batch", "run_stream", "stream_results"]
