"""Ingest of unlike files, injection without overlaps, exact samples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aerolens.operators import curves
from aerolens.operators.inject import inject_anomalies, injection_plan, split_by_case
from aerolens.operators.models import AnomalyDetector
from aerolens.operators.models.sampling import subsample
from aerolens.schema import REQUIRED_COLUMNS
from aerolens.sources import csv as ingest
from tests.conftest import make_rows

POOL = ("altitude_spike", "coordinate_jump", "speed_inconsistency", "heading_inconsistency")


def _line(**kw):
    base = dict(profile="subtle", replicate="1", case_id="7", case_name="n", row_idx="1", label="0", tamper_type="normal",
                timestamp="2024-09-15T20:00:00+02:00", latitude="52", longitude="21", altitude="10", speed="5", heading="90", source="s", original_row_idx="1")
    return base | {k: str(v) for k, v in kw.items()}


def _write(path, rows, columns=REQUIRED_COLUMNS):
    path.write_text("\n".join([",".join(columns), *(",".join(r[c] for c in columns) for r in rows)]) + "\n")


def test_files_with_other_headers(spark, tmp_path):
    _write(tmp_path / "b.csv", [_line(case_id=9007199254740993, altitude=100, speed=1, row_idx=k) for k in range(1, 200)])
    _write(tmp_path / "a.csv", [_line(case_id=9007199254740992, altitude=7, speed=2, replicate="1e20", timestamp="2024-09-15 20:00:00.5")], tuple(reversed(REQUIRED_COLUMNS)))
    _write(tmp_path / "c.csv", [_line(case_id="3.0", row_idx=1, altitude="NaN", timestamp="soon")], tuple(sorted(REQUIRED_COLUMNS)))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            d = ingest.load_dataset(spark, str(tmp_path))
            rows = {r["case_id"]: r for r in d.where("row_idx = 1").withColumn("us", F.unix_micros("timestamp")).collect()}
            assert set(rows) == {9007199254740993, 9007199254740992, 3}
            assert (rows[9007199254740993]["altitude"], rows[9007199254740993]["speed"]) == (100.0, 1.0)
            assert (rows[9007199254740992]["altitude"], rows[9007199254740992]["speed"], rows[9007199254740992]["replicate"]) == (7.0, 2.0, None)
            assert rows[3]["altitude"] is None and rows[3]["us"] is None
            assert rows[9007199254740992]["us"] == 1726430400500000 and rows[9007199254740993]["us"] == 1726423200000000
            order = [(r["case_id"], r["row_idx"]) for r in d.orderBy("_ord").select("case_id", "row_idx").collect()]
            assert order == [(9007199254740992, 1), *((9007199254740993, k) for k in range(1, 200)), (3, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ordinal_follows_the_file_over_splits(spark, tmp_path):
    _write(tmp_path / "a.csv", [_line(row_idx=k, original_row_idx=k) for k in range(1, 4000)])
    _write(tmp_path / "b.csv", [_line(row_idx=k, original_row_idx=5000 + k) for k in range(1, 50)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = [r[0] for r in ingest.load_dataset(spark, str(tmp_path)).orderBy("_ord").select("original_row_idx").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [*range(1, 4000), *range(5001, 5050)]


@pytest.mark.parametrize("shape", ["cruise", "mission"])
@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_injection(spark, shape, k):
    rows = [{"case_id": c, "replicate": None if c == 2 else 1, "row_idx": i} for c in (1, 2, 3) for i in range(1, 61)]
    df = make_rows(spark, rows)
    plan = injection_plan(df, pool=POOL, n_anomalies=k, shape=shape, segment_seconds=2.0)
    p = plan.collect()
    assert len(p) == 3 * k and {r["case_id"] for r in p} == {1, 2, 3}            # also the flight without a replicate
    for c in (1, 2, 3):
        own = sorted((r["start_row"], r["end_row"]) for r in p if r["case_id"] == c)
        assert all(1 <= a <= b <= 60 for a, b in own) and all(x[1] < y[0] for x, y in zip(own, own[1:]))
        assert len({r["type"] for r in p if r["case_id"] == c}) == k
    out = inject_anomalies(df, plan)
    assert out.count() == len(rows)
    assert out.where("label = 1").count() == sum(r["end_row"] - r["start_row"] + 1 for r in p)


def test_overlapping_plans_give_each_row_one_type(spark):
    df = make_rows(spark, [{"row_idx": i} for i in range(1, 21)])
    plan = spark.createDataFrame([(3, 1, 5, 15, "altitude_spike"), (3, 1, 8, 10, "speed_inconsistency")],
                                 "replicate int, case_id bigint, start_row bigint, end_row bigint, type string")
    got = {r["row_idx"]: r["tamper_type"] for r in inject_anomalies(df, plan).collect()}
    assert len(got) == 20 and got[7] == got[11] == "altitude_spike" and got[9] == "speed_inconsistency" and got[16] == "normal"


def test_subsample_is_exact_and_keeps_partitions(spark):
    df = spark.range(20_000).select(F.col("id").alias("case_id"), (F.col("id") % 7).alias("row_idx"))
    df = df.repartition(6)
    for n in (1, 500, 19_999, 20_000, 30_000):
        s = subsample(df, n, seed=3)
        assert s.count() == min(n, 20_000) == s.distinct().count()
    one = subsample(df, 5_000, seed=3)
    assert one.rdd.getNumPartitions() >= 6
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in subsample(df.coalesce(2), 5_000, seed=3).collect()}
    same = spark.range(100).select(F.lit(1).alias("case_id"), F.lit(1).alias("row_idx"))
    assert subsample(same, 30).count() == 30


def test_split_by_case_has_the_exact_share(spark):
    df = spark.range(7200).select(F.when(F.col("id") % 720 > 0, F.col("id") % 720).alias("case_id"), F.col("id").alias("row_idx"))
    train, test = split_by_case(df, 0.25)
    a, b = ({r[0] for r in x.select("case_id").distinct().collect()} for x in (train, test))
    assert (len(a), len(b)) == (540, 180) and not a & b and train.count() + test.count() == 7200


def test_models_need_a_cap(spark):
    with pytest.raises(ValueError, match="cap"):
        AnomalyDetector("lof", max_train_samples=0).fit(make_rows(spark, [{"row_idx": 1}]))


def test_roc_starts_at_the_origin(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 0)], "score double, label int")
    got = {(r["threshold"], r["fpr"], r["tpr"]) for r in curves.roc_curve(df, "score").collect()}
    assert got == {(None, 0.0, 0.0), (0.9, 0.0, 1.0), (0.8, 0.5, 1.0), (0.3, 1.0, 1.0)}
    assert curves.roc_curve(df, "score", start=False).count() == 3


def test_interval_join_of_many_segments(spark):
    """10,000 segments in one flight, some overlapping, some over many bins, beyond the flight and on a missing key."""
    import random
    rng = random.Random(4)
    rows = spark.range(-50, 40_000).select(F.col("id").alias("row_idx"), F.lit(3).alias("replicate"), F.lit(None).cast("bigint").alias("case_id"),
        *[F.lit(1.0).alias(c) for c in ("altitude", "speed", "heading", "latitude", "longitude")], F.lit(0).alias("label"), F.lit("normal").alias("tamper_type"))
    types = ["altitude_spike", "coordinate_jump", "speed_inconsistency", "heading_inconsistency"]
    segments = [(a := rng.randint(-60, 41_000), a + rng.choice([0, 1, 3, 30]), rng.choice(types)) for _ in range(10_000)]
    segments += [(100, 10**12, "speed_inconsistency"), (39_000, 39_500, "altitude_spike"), (50, 40, "altitude_spike"), (20_000, 20_000 + 2**17, "coordinate_jump")]
    plan = spark.createDataFrame([(3, None, a, b, t) for a, b, t in segments], "replicate int, case_id bigint, start_row bigint, end_row bigint, type string")
    out = inject_anomalies(rows.unionByName(rows.limit(1).withColumn("row_idx", F.lit(None).cast("bigint"))), plan)
    got = {r["row_idx"]: r["tamper_type"] for r in out.select("row_idx", "tamper_type").collect()}
    want = {}
    for a, b, t in sorted(segments):
        for i in range(max(a, -50), min(b, 39_999) + 1):
            want[i] = t
    assert len(got) == 40_051 and got == {i: want.get(i, "normal") for i in got}
    plan_text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_p_bin" in plan_text
