"""op1 against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from aerolens.llm import op1_minhash as mh
from aerolens.llm.common import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: (n_shingles values, component)}; rows that repeat an id are one document."""
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [(r[0], word_set(r[1])) for r in rows if r[0] is not None]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_groups_equal_brute_force(docs):
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    got = mh.near_duplicate_groups(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(word_set(r[1])) for r in rows)


def test_blocks_of_large_keys(spark):
    """Many texts around the limit, small blocks: the in-task comparison finds every link."""
    import random
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.sample(range(80), rng.choice([1, 1, 2, 3, 4])):
            w[p] = f"c{i}x{p}"
        rows.append((i * 3, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in mh.near_duplicate_groups(df, block=16).collect()}
    assert got == brute(rows)


def test_large_tables_shuffle_instead_of_broadcast(docs, monkeypatch):
    monkeypatch.setattr("aerolens.llm.common.BROADCAST_IDS", 0)
    monkeypatch.setattr(mh, "BROADCAST_SIGS", 0)
    monkeypatch.setattr(mh, "small", lambda df, *_: df)
    want = brute([tuple(r) for r in docs.collect()])
    got = mh.near_duplicate_groups(docs).where("doc_id is not null").collect()
    assert all(r["component_id"] == want[r["doc_id"]] for r in got)


def test_dropping_keeps_one_of_each_group(docs):
    kept = mh.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = brute([tuple(r) for r in docs.collect()])
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values()))
    assert ids.count(None) == 1


def test_empty_table(no_docs):
    assert mh.near_duplicate_groups(no_docs).collect() == []
    assert mh.drop_near_duplicates(no_docs).count() == 0


def test_shingles_of_long_texts_don_t_depend_on_the_pieces(monkeypatch):
    text = " ".join(f"w{k * 7919 % 1000}" for k in range(3000)) + " " + "y" * 9000 + " end"
    whole = mh.shingle_set(text)
    assert len(whole) == len(word_set(text))
    monkeypatch.setattr(mh, "_CHUNK", 1000)
    assert np.array_equal(whole, mh.shingle_set(text))


@pytest.mark.parametrize("bound", [0, 1000])
def test_components(spark, bound):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 70), (70, 90), (200, 200)] + [(500, x) for x in range(501, 560)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), bound=bound).collect()}
    assert all(got[k] == 1 for k in range(2, 61)) and got[100] == got[90] == 70
    assert all(got[x] == 500 for x in range(501, 560)) and 200 not in got and 1 not in got


def test_tensored_keys_need_few_minima():
    assert mh.N_MINIMA == 2 * mh.M * mh.K == 96
    rng = np.random.default_rng(1)
    misses = 0
    for _ in range(300):                                    # pairs at 0.75 meet in some table (i, j)
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
        x, y = (mh.half_keys(mh.minima(np.concatenate((common, part)))) for part in (a, b))
        misses += not ((x == y)[:mh.M].any() and (x == y)[mh.M:].any())
    assert misses <= 2


def test_removed_rows_reach_no_window(docs):
    out = mh.drop_near_duplicates(docs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "LeftOuter" not in plan and "Join Inner" in window and "_mh_many" in window
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(i is None for i, _ in got) == 1 and len([i for i, _ in got if i == 20]) == 1 and len([i for i, _ in got if i == 1]) == 1
