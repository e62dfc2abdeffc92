"""The pipeline: each stage on all that the one before kept; whole run on the smallest tables."""

from __future__ import annotations

from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline as cp
from aerolens.llm import op6_mixing, queries


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "packing"]


def test_stages(spark, docs, tmp_path):
    now, ids = docs, []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, now, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert ids[0] >= ids[1] == ids[2] == ids[3] == ids[4] and 1 in ids[4] and 17 not in ids[0]


def test_run(spark):
    rows = cp.run(spark, "/root/testdata/sf0.001").collect()
    per = defaultdict(int)
    for r in rows:
        per[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert rows and all(total == n for (_, n), total in per.items())


def test_sequences_follow_the_mix(spark, tmp_path):
    sizes = {"a": 3600, "b": 900, "c": 400}
    rows = [(k * 10_000 + i, f"{s} " * (60 if s == "a" else 20) + str(i), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000",
            "spark.sql.files.openCostInBytes": "20000"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        cp.mixing(spark, now, "").write.parquet(str(tmp_path / "mix"))
        mixed = spark.read.parquet(str(tmp_path / "mix"))
        assert len(mixed.inputFiles()) > 1
        got = cp.packing(spark, mixed, "").where("start = 0").select("doc_id", "sequence_id", "segment").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == sum(sizes.values())
    slots = {r["doc_id"]: r["slot"] for r in op6_mixing.place(now).select("doc_id", "_mix.slot").collect()}
    parts = defaultdict(list)
    for r in got:
        parts[r["sequence_id"] >> 40].append(r["doc_id"])
    total, done, checked = sum(n ** 0.5 for n in sizes.values()), [], 0
    for p in sorted(parts):
        assert max((slots[i] for i in done), default=-1) <= min(slots[i] for i in parts[p])
        done += parts[p]
        if len(done) < 2000:                                # all sources still have rows
            checked += 1
            for k, n in enumerate(sizes.values()):
                assert abs(sum(i // 10_000 == k for i in done) - n ** 0.5 / total * len(done)) <= 3 * op6_mixing.BLOCK_ROWS
    assert len(parts) > 1 and checked
