"""op6: Pfair windows and less than a block of deviation, against a plain schedule."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aerolens.llm import op6_mixing as mx


def rows_of(spark, sizes):
    rows = [(k * 1000 + i, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string")


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 0.0}])
def test_schedule(spark, weights):
    sizes = {"a": 900, "b": 300, "c": 200, None: 37}
    got = mx.place(rows_of(spark, sizes), weights, block_rows=4).select("doc_id", "source", "_mix.*").collect()
    assert len(got) == sum(sizes.values()) and len({r["doc_id"] for r in got}) == len(got)
    slots = defaultdict(list)
    for r in got:
        slots[r["slot"]].append(r)
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len({(r["lane"], r["block"]) for r in x}) == 1 and len(x) <= 4 for x in slots.values())
    tree, _ = mx._tree(mx._sources(rows_of(spark, sizes), weights, mx.TEMPERATURE))
    share = {r["lane"]: r["units"] for r in tree.collect()}
    period = sum(share.values())
    end = min(math.floor(max(r["block"] for r in got if r["lane"] == k) * period / u) for k, u in share.items())
    done = Counter()
    for t in range(end):                                    # all sources still have blocks
        done[slots[t][0]["lane"]] += 1
        assert all(abs(done[k] - u / period * (t + 1)) < 1 for k, u in share.items())


def plain_edf(units, blocks):
    """Slot of every block, one slot after the other."""
    d, done, out = sum(units), [0] * len(units), {}
    for t in range(max(-(-n * d // u) for u, n in zip(units, blocks))):
        ready = [(-(-(done[i] + 1) * d // u), i) for i, u in enumerate(units) if done[i] * d // u <= t]
        i = min(ready)[1]
        if done[i] < blocks[i]:
            out[i, done[i]] = t
        done[i] += 1
    return out


@pytest.mark.parametrize("seed,segment", [(1, 1000), (2, 7), (3, 5), (4, 40)])
def test_segments_equal_one_plain_run(spark, monkeypatch, seed, segment):
    """Whatever the segments, the slots are those of a single run from slot 0, each block in its window."""
    rng = random.Random(seed)
    monkeypatch.setattr(mx, "SEGMENT", segment)
    units = [int(10 ** rng.uniform(0, 6)) for _ in range(rng.randint(2, 9))]
    blocks = [max(1, round(200 * u / sum(units))) for u in units]
    kids = spark.createDataFrame([(0, i, u, n) for i, (u, n) in enumerate(zip(units, blocks))], "node bigint, lane int, units bigint, nb bigint")
    got = {(r["lane"], r["block"]): r for r in mx._plan(kids).where("slot < 3000").collect()}
    want = {k: t for k, t in plain_edf(units, [min(n, 200) for n in blocks]).items() if t < 3000} if sum(units) / min(units) < 10**5 else None
    if want is not None:
        assert {k: r["slot"] for k, r in got.items()} == want
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got.values())


def test_null_and_empty_names_and_clashing_columns(spark):
    rows = [(k, (None, "", "a")[k % 3], "mine", {"slot": "x"}, "y") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, _mix string, _mix_row map<string,string>, _num_bucket string")
    got = mx.place(df, {"": 0.7, "a": 0.3}, block_rows=1)
    assert got.columns == [*df.columns, "_mix_"]
    first = [r["source"] for r in got.where("_mix_.slot < 1000").select("source").collect()]
    assert abs(first.count("") - 699) <= 2 and abs(first.count("a") - 300) <= 2 and first.count(None) <= 2
    both = mx.place(df, {"": 0.2, None: 0.5, "a": 0.3}, block_rows=1).where("_mix_.slot < 1000").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in both} == {"": 200, None: 500, "a": 300}
    out = mx.mix(df)
    assert out.columns == df.columns and out.where("_mix = 'mine'").count() == 3000


def test_many_sources_share_a_lane(spark, monkeypatch):
    monkeypatch.setattr(mx, "MAX_LANES", 4)
    sizes = {f"s{k}": 20 - k for k in range(10)}
    got = mx.place(rows_of(spark, sizes), block_rows=2).select("doc_id", "_mix.lane").collect()
    assert len(got) == sum(sizes.values()) and {r["lane"] for r in got} == {0, 1, 2, 3}


def test_mix_keeps_rows(docs, no_docs):
    out = mx.mix(docs)
    assert out.columns == docs.columns
    key = lambda df: sorted(map(str, df.collect()))
    assert key(out) == key(docs)
    assert mx.mix(no_docs).collect() == []


def test_no_python(docs):
    plan = mx.place(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def deviations(got, share):
    """The largest deviation from share * slots of each source, while all still have blocks."""
    by, last = {r["slot"]: r["source"] for r in got}, Counter()
    for r in got:
        last[r["source"]] = max(last[r["source"]], r["slot"])
    done, worst = Counter(), Counter()
    for t in range(min(last.values())):
        done[by.get(t)] += 1
        for s, w in share.items():
            worst[s] = max(worst[s], abs(done[s] - w * (t + 1)))
    return worst, min(last.values())


def test_deviation_from_the_target_weights(spark):
    weights = {"a": 0.0504, "b": 0.9495, "c": 0.0001}
    rows = rows_of(spark, {"a": 900, "b": 17_500, "c": 3}).withColumn("doc_id", F.monotonically_increasing_id())
    got = mx.place(rows, weights, block_rows=1).select("source", "_mix.slot").collect()
    assert len({r["slot"] for r in got}) == len(got) == 18_403
    worst, slots = deviations(got, weights)
    assert slots > 15_000 and all(x < 1 for x in worst.values())


def test_sources_in_the_shared_lane_have_their_own_weights(spark, monkeypatch):
    monkeypatch.setattr(mx, "MAX_LANES", 4)
    sizes = {f"s{k:02}": 400 - k for k in range(12)}
    raw = {s: (6.0 if s == "s11" else 1.0 + k % 3) for k, s in enumerate(sizes)}
    got = mx.place(rows_of(spark, sizes), raw, block_rows=1).select("source", "_mix.slot").collect()
    assert len({r["slot"] for r in got}) == len(got) == sum(sizes.values())
    worst, slots = deviations(got, {s: w / sum(raw.values()) for s, w in raw.items()})
    assert slots > 1000 and all(x < 4 for x in worst.values())
