"""Physical plan shape: one exchange, pruned scans, partition pruning."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from aerolens.plans.composed import detect
from aerolens.sources.csv import split_by_replicate, write_curated
from aerolens.sources.events_view import load_events_telemetry
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_backfilled_detection_one_exchange_on_flights(spark):
    spark.catalog.clearCache()
    t = load_events_telemetry(spark, SF_SMALL)
    out = detect(t, layers=("rules", "statistical"), with_features=True, hot_rows=None)
    plan = _plan(out)
    # the view itself partitions by user_id once; detection adds one exchange
    assert plan.count("Exchange hashpartitioning(replicate") == 1, plan


def test_scan_reads_only_needed_columns(spark):
    spark.catalog.clearCache()          # other modules cache this view
    t = load_events_telemetry(spark, SF_SMALL)
    plan = _plan(t.select("case_id", "row_idx", "label"))
    scan = [line for line in plan.split("\n") if "ReadSchema" in line or "FileScan" in line]
    text = " ".join(scan)
    assert "props" not in text and "value" not in text, text


def test_curated_table_prunes_replicate_partitions(spark):
    t = load_events_telemetry(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="aerolens-curated-"), "tele")
    write_curated(t, path)
    _, test = split_by_replicate(spark.read.parquet(path), 3)
    plan = _plan(test.select("case_id"))
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PartitionFilters: [(replicate#" in scan and "<=> 3)]" in scan, scan
    assert "ReadSchema: struct<case_id:bigint>" in scan, scan
    assert test.count() == t.filter(F.col("replicate") == 3).count()
