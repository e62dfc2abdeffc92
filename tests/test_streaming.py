"""Stream = batch (causal) over several micro-batches, restarts, late rows and missing timestamps."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolens.operators.features import compute_features
from aerolens.operators.statistical import detect_sudden_changes
from aerolens.plans.runners import run_stream, stream_results
from aerolens.schema import FEATURE_NAMES
from aerolens.streaming import job
from aerolens.streaming.replay import select_cases, write_replay
from tests.test_layers import _random_flights

COLS = ["z_altitude", "z_speed", "z_heading", "z_gps_step"] + list(FEATURE_NAMES)
STAT = "rules,statistical"


def _dirs(*names):
    base = tempfile.mkdtemp(prefix="aerolens-stream-")
    return tuple(os.path.join(base, x) for x in names)


def _batch(df):
    return compute_features(detect_sudden_changes(df), fill="causal").toPandas()


def _check(got: pd.DataFrame, exp: pd.DataFrame):
    m = got.merge(exp, on=["replicate", "case_id", "row_idx"], suffixes=("_s", "_b"))
    assert len(m) == len(exp) == len(got)
    for c in COLS:
        a, b = m[f"{c}_s"].astype(float).values, m[f"{c}_b"].astype(float).values
        assert np.allclose(a, b, atol=1e-9, equal_nan=True), c
    assert (m["alert_change_s"] == m["alert_change_b"]).all()
    assert (m["change_reasons_s"] == m["change_reasons_b"]).all()


def _sliced(df, n):
    t = F.unix_micros("timestamp")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    return df.withColumn("_s", F.floor((t - F.lit(lo)) / F.lit((hi - lo) // n + 1)))


def _append(part, src):
    part.drop("_s").repartition(2, "replicate", "case_id").write.mode("append").parquet(src)


@pytest.mark.parametrize("state,compact_every", [("store", 16), ("table", 1), ("table", 2), ("table", 16)])
def test_parity_with_restart_and_other_partitions(spark, state, compact_every):
    df = _random_flights(spark, n_flights=4, n=70, seed=21)
    src, out, ckpt = _dirs("src", "out", "ckpt")
    parts = _sliced(df, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for c in range(4):                       # one micro-batch a start, partitions change between
            spark.conf.set("spark.sql.shuffle.partitions", str(3 + 2 * (c % 2)))
            _append(parts.filter(F.col("_s") == c), src)
            run_stream(spark, src, df.schema, out, ckpt, layers=STAT, files_per_trigger=2, with_features=True, sinks=(),
                       state=state, compact_every=compact_every)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    if state == "table":                         # folders that no replay needs are gone
        kept = [x for kind in ("full", "delta") if os.path.isdir(f"{out}/context/{kind}") for x in os.listdir(f"{out}/context/{kind}")]
        assert len(kept) <= 2 * compact_every + 2
    else:
        assert not os.path.exists(f"{out}/context")
    _check(job.read_scored(spark, out).toPandas(), _batch(df))


def test_old_flights_and_late_rows_are_kept(spark):
    df = _random_flights(spark, n_flights=3, n=40, seed=2)
    src, out, ckpt = _dirs("src", "out", "ckpt")
    old = df.withColumn("timestamp", F.when(F.col("case_id") == 1, F.expr("timestamp - interval 40 days")).otherwise(F.col("timestamp")))
    for part in (old.filter("case_id <> 1"), old.filter("case_id = 1 and row_idx > 20"), old.filter("case_id = 1 and row_idx <= 20")):
        part.coalesce(1).write.mode("append").parquet(src)
        run_stream(spark, src, df.schema, out, ckpt, layers=STAT)
    got = job.read_scored(spark, out)
    assert got.count() == df.count()
    late = got.filter("late")
    assert late.count() == 20 and late.filter("case_id <> 1 or row_idx > 20").count() == 0
    _, m = stream_results(spark, out)
    assert m.first()["n_late"] == 20 and m.first()["n_samples"] == df.count()


def test_missing_timestamps_and_replay_orders(spark):
    df = _random_flights(spark, n_flights=4, n=30, seed=5).withColumn(
        "timestamp", F.when((F.col("case_id") != 2) & (F.col("row_idx") % 7 != 0), F.col("timestamp")))
    exp = detect_sudden_changes(df).toPandas()
    for by in ("time", "case"):
        src, out, ckpt = _dirs("src", "out", "ckpt")
        files = write_replay(df, src, chunks=3, files_per_chunk=2, by=by)
        assert spark.read.parquet(src).count() == df.count()
        run_stream(spark, src, df.schema, out, ckpt, layers=STAT, files_per_trigger=files)
        got = job.read_scored(spark, out)
        assert got.count() == df.count() and got.filter("timestamp is null").count() == df.filter("timestamp is null").count()
        if by == "case":                         # whole flights: windows as in the batch
            m = got.toPandas().merge(exp, on=["replicate", "case_id", "row_idx"], suffixes=("_s", "_b"))
            assert np.allclose(m["z_altitude_s"].astype(float), m["z_altitude_b"].astype(float), equal_nan=True)
    assert write_replay(df.withColumn("timestamp", F.lit(None).cast("timestamp")), _dirs("x")[0], chunks=2) == 4
    with pytest.raises(ValueError, match="nothing to replay"):
        write_replay(df.limit(0), _dirs("x")[0])


def test_replayed_batch_counts_once(spark):
    df = _random_flights(spark, n_flights=2, n=40, seed=8)
    src, out = _dirs("src", "out")
    context = job.FlightContext(spark, f"{out}/context", df.withColumn("_ord", F.lit(0).cast("bigint")).schema, ("replicate", "case_id"), 40)
    rows = df.withColumn("_ord", F.lit(0).cast("bigint"))
    for batch_id, part in ((0, rows.filter("row_idx <= 20")), (1, rows.filter("row_idx > 20")), (1, rows.filter("row_idx > 20"))):
        scored, whole = job.score_batch(part, batch_id, context, ("statistical",))
        assert scored.count() == part.count() and scored.filter("late").count() == 0
        context.write(batch_id, whole)


def test_options(spark):
    df = _random_flights(spark, n_flights=3, n=20, seed=4)
    src, out, ckpt = _dirs("src", "out", "ckpt")
    write_replay(df, src, chunks=2, files_per_chunk=1)
    with pytest.raises(ValueError, match="needs a fitted model"):
        run_stream(spark, src, df.schema, out, ckpt, layers="ml")
    with pytest.raises(ValueError, match="needs a fitted model"):
        run_stream(spark, src, df.schema, out, ckpt)
    with pytest.raises(ValueError, match="Unknown sinks"):
        run_stream(spark, src, df.schema, out, ckpt, layers="rules", sinks=("kafka",))
    run_stream(spark, src, df.schema, out, ckpt, layers="rules", case_ids=[1], sinks=("console",))
    got = job.read_scored(spark, out)
    assert {r["case_id"] for r in got.select("case_id").distinct().collect()} == {1} and "alert_change" not in got.columns
    assert all(r["value"].startswith("[ALERT ") for r in spark.read.text(f"{out}/console").collect())
    assert not os.path.exists(f"{out}/alerts")


def test_alert_time_is_utc_in_any_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("select timestamp_micros(us) t from values (0L), (1710000000123456L), (-1L), (1709967600000000L), (null) v(us)")
    want = ["1970-01-01 00:00:00.000000+00:00", "2024-03-09 16:00:00.123456+00:00", "1969-12-31 23:59:59.999999+00:00", "2024-03-09 07:00:00.000000+00:00", None]
    try:
        for zone in ("UTC", "America/New_York", "Europe/Warsaw"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in df.select(job.utc_text("t")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_select_cases(spark):
    df = _random_flights(spark, n_flights=4, n=10)
    assert select_cases(df, case_ids=[1]).select("case_id").distinct().count() == 1
    assert select_cases(df, n_cases=2).select("case_id").distinct().count() == 2
    assert select_cases(df, n_cases=2, max_samples=5).count() == 5


def test_model_on_the_stream_matches_batch_causal(spark):
    from aerolens.operators.models import AnomalyDetector
    from aerolens.plans.composed import detect
    df = _random_flights(spark, n_flights=4, n=60, seed=41).withColumn("label", (F.col("row_idx") % 7 == 0).cast("int"))
    det = AnomalyDetector("isolation_forest", params={"n_estimators": 20}).fit(df)
    exp = detect(df, layers="all", model=det, fill="causal", combine=True) \
        .select("replicate", "case_id", "row_idx", "ml_score", "alert_ml", "layers").toPandas()
    src, out, ckpt = _dirs("src", "out", "ckpt")
    files = write_replay(df, src, chunks=3, files_per_chunk=2)
    run_stream(spark, src, df.schema, out, ckpt, model=det, files_per_trigger=files)
    got = job.read_scored(spark, out).select("replicate", "case_id", "row_idx", "ml_score", "alert_ml", "layers").toPandas()
    m = got.merge(exp, on=["replicate", "case_id", "row_idx"], suffixes=("_s", "_b"))
    assert len(m) == len(exp) == len(got)
    assert np.allclose(m["ml_score_s"], m["ml_score_b"], atol=1e-12)
    assert (m["alert_ml_s"] == m["alert_ml_b"]).all()
    assert all(list(a) == list(b) for a, b in zip(m["layers_s"], m["layers_b"]))


def _progress(q):
    return [p for p in q.recentProgress if p.numInputRows]


def test_cost_follows_the_flights_of_the_batch(spark):
    """100,000 flights that are idle: a batch of five flights loads and writes five states and scores its rows."""
    df = _random_flights(spark, n_flights=5, n=50, seed=31)
    idle = df.where("case_id = 1 and row_idx = 1").limit(1).drop("case_id").crossJoin(spark.range(1000, 101_000).withColumnRenamed("id", "case_id"))
    src, out, ckpt = _dirs("src", "out", "ckpt")
    for k, part in enumerate((idle.select(df.columns).repartition(4), df.where("row_idx <= 25"), df.where("row_idx > 25"))):
        part.write.mode("append").parquet(src)
        q = run_stream(spark, src, df.schema, out, ckpt, layers=STAT if k else "rules", buffer_size=40, files_per_trigger=1000, with_features=k > 0, sinks=())
        state = [p.stateOperators[0] for p in _progress(q)]
    assert [(s.numRowsTotal, s.numRowsUpdated) for s in state] == [(100_005, 5)]
    assert any(k.startswith("rocksdb") for k in state[0].customMetrics)
    got = spark.read.option("mergeSchema", True).parquet(f"{out}/scored")
    assert got.count() == 100_000 + df.count() and got.where("case_id < 1000 and late").count() == 0
    _check(got.where("case_id < 1000").toPandas(), _batch(df))


def test_context_carries_any_value(spark):
    """Missing keys and row numbers, ids above 2**53, NaN and infinite channels, microseconds."""
    df = _random_flights(spark, n_flights=3, n=30, seed=12).withColumns({
        "case_id": F.when(F.col("case_id") == 1, F.lit(None)).when(F.col("case_id") == 2, F.lit(9007199254740993)).otherwise(F.col("case_id")),
        "replicate": F.when(F.col("case_id") == 1, F.lit(None)).otherwise(F.col("replicate")),
        "row_idx": F.when(F.col("row_idx") != 7, F.col("row_idx")),
        "timestamp": F.expr("timestamp + interval 123457 microseconds"),
        "speed": F.when(F.col("row_idx") == 22, F.lit(float("inf"))).otherwise(F.col("speed"))})
    for state in ("store", "table"):
        src, out, ckpt = _dirs("src", "out", "ckpt")
        for part in (df.where("row_idx <= 15 or row_idx is null"), df.where("row_idx > 15")):
            part.coalesce(1).write.mode("append").parquet(src)
            run_stream(spark, src, df.schema, out, ckpt, layers=STAT, with_features=True, sinks=(), state=state)
        assert job.read_scored(spark, out).where("case_id = 9007199254740993").count() == 30
        rows = job.read_scored(spark, out).toPandas().sort_values(["case_id", "row_idx"]).reset_index(drop=True)
        want = _batch(df).sort_values(["case_id", "row_idx"]).reset_index(drop=True)
        assert len(rows) == len(want)
        for c in COLS:
            assert np.allclose(rows[c].astype(float), want[c].astype(float), equal_nan=True), (state, c)


def test_idle_flights_are_forgotten(spark):
    df = _random_flights(spark, n_flights=2, n=40, seed=3)
    src, out, ckpt = _dirs("src", "out", "ckpt")
    for part in (df.where("row_idx <= 20"), df.where("row_idx > 20")):
        part.coalesce(1).write.mode("append").parquet(src)
        q = run_stream(spark, src, df.schema, out, ckpt, layers=STAT, sinks=(), idle_after=3600)
    assert _progress(q)[-1].stateOperators[0].numRowsTotal == 2
    class State:
        hasTimedOut, exists, gone = True, True, False
        def remove(self): self.gone = True
    timed_out = State()
    assert list(job._last_rows((3, 1), iter([]), timed_out, 40, 1000)) == [] and timed_out.gone
    with pytest.raises(ValueError, match="Unknown state"):
        run_stream(spark, src, df.schema, out, ckpt, layers=STAT, state="memory")
