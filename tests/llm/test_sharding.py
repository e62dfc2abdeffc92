"""op9: the law, slots, linked documents together, quotas of large groups."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from aerolens.llm import op9_sharding as sh


def check_law(got, shards=8):
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_rows_and_sizes(docs):
    got = sh.shard(docs).collect()
    rows = docs.collect()
    check_law(got)
    size = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, *size(r["text"])) for r in rows)


@pytest.mark.parametrize("hot", [0, 40, 400])
def test_copies_stay_together(spark, hot):
    rows = [(i, f"copy {i // 4}") for i in range(400)] + [(1000 + i, f"single {i}") for i in range(500)] + [(5000 + i, "hot") for i in range(hot)]
    got = sh.shard(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()
    check_law(got)
    text = dict(rows)
    groups = defaultdict(Counter)
    for r in got:
        groups[text[r["doc_id"]]][r["shard"]] += 1
    split = sum(len(c) > 1 for t, c in groups.items() if t != "hot")
    assert split <= 5                                       # of 100; a full shard can hold the larger half of a group
    if hot == 400:                                          # larger than a shard: fills whole shards
        quota = len(rows) // 8
        assert sorted(groups["hot"].values())[-1] >= quota - 8 and len(groups["hot"]) <= 5
    elif hot:
        assert len(groups["hot"]) == 1


def test_given_links(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(64)], "doc_id bigint, text string")
    links = spark.createDataFrame([(i, str(i // 8)) for i in range(64)] + [(i, f"x{i // 16}") for i in range(0, 64, 2)], "doc_id bigint, g string")
    got = {r["doc_id"]: r["shard"] for r in sh.shard(docs, links=links, rounds=10).collect()}
    together = sum(got[i] == got[i - i % 8] for i in range(64))
    assert Counter(Counter(got.values()).values()) == {8: 8} and together >= 32


def test_empty_and_tiny(spark, no_docs):
    assert sh.shard(no_docs).collect() == []
    got = sh.shard(spark.createDataFrame([(1, None), (2, None), (3, "")], "doc_id bigint, text string")).collect()
    check_law(got)


def test_no_python(docs):
    plan = sh.shard(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
