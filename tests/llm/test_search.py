"""op12 against a plain version in Python integers."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from aerolens.llm import op12_search as se
from tests.llm.conftest import SCHEMA


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=50):
    rows = [(d, Counter(plain_terms(t))) for d, t in docs if d is not None]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, words in asked.items():
        scored = []
        for d, c, n in rows:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


ITEMS = [(0, "alpha beta GAMMA delta, one two three"), (1, "changed1x5 omega epsilon 7"), (2, None), (3, "... !"), (None, "alpha"),
         (4, "É un pi tau10 Σ"), (5, "two"), (5, "words"), (6, "nothing like this occurs qqq"), (7, "x" * 400_000), (8, "alpha1 " * 50 + "beta2")]


def items_of(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id bigint, text string, rank string, doc_id int")


@pytest.mark.parametrize("how", [{}, {"pass_pairs": 4, "item_tile": 2, "doc_tile": 7}, {"k": 3, "item_tile": 1}], ids=["whole", "passes", "few"])
def test_equals_plain_version(spark, docs, how):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, se.search(docs, items_of(spark), **how).collect()))
    assert got == plain_search(rows, ITEMS, how.get("k", 50)) and {r[0] for r in got} == {0, 5, 7, 8}


def test_ties_go_to_the_smaller_doc_id(spark):
    rows = [(900 - i, "the same text é%d" % (i % 3)) for i in range(600)] + [(2000 + i, "filler text of other words") for i in range(500)]
    df = spark.createDataFrame([(i, t, "en", "a", 1, "", "", "") for i, t in rows], SCHEMA).repartition(7)
    items = [(1, "same é1"), (2, "the"), (3, "text")]
    assert sorted(map(tuple, se.search(df, items_of(spark, items), doc_tile=16).collect())) == plain_search(rows, items)


def test_sums_stay_below_the_exact_range():
    rng = random.Random(1)
    weights = np.array([rng.randint(0, 25_000) for _ in range(500)])
    items = [[rng.randrange(500) for _ in range(rng.randint(1, 200))] for _ in range(20)]
    items = [sorted(set(x)) for x in items]
    limit = 200_000 * se.IMPACT
    tiles = se.vocabulary_tiles(items, weights, limit, columns=64)
    assert len(tiles) > 8 and all((w.sum(axis=0) * se.IMPACT < limit).all() and len(t) <= 64 for t, w in tiles)
    total = sum(w.sum(axis=0) for _, w in tiles)
    assert total.tolist() == [sum(int(weights[t]) for t in x) for x in items]
    assert sorted(int(t) for x, _ in tiles for t in x) == sorted({t for x in items for t in x if weights[t] > 0})
    big = 2**33 * np.ones(3, np.int64)                           # weights of which two already pass 2**53
    assert [len(t) for t, _ in se.vocabulary_tiles([[0, 1, 2]], big)] == [1, 1, 1]


def test_scores_beyond_one_exact_tile():
    """Two vocabulary tiles whose sum is beyond 2**53 add up in integers."""
    import pyarrow as pa
    weights = np.array([2**33 - 1, 2**33 - 3, 2**33 - 5])
    tiles = [(0, 1, se.vocabulary_tiles([[0, 1, 2]], weights))]
    idx, tf = pa.array([[0, 1, 2]], pa.list_(pa.int32())), pa.array([[9, 1, 4]], pa.list_(pa.int64()))
    b = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([14]), idx, tf], ["doc_id", "n", "idx", "tf"])
    got = next(se._rank(iter([b]), [7], tiles, 1, 14, 50, 512)).to_pylist()
    impact = [10**9 * t // (1000 * t + 20 * 100) for t in (9, 1, 4)]
    assert got == [{"item_id": 7, "doc_id": 5, "score": sum(int(w) * x for w, x in zip(weights, impact))}]


def test_empty_tables(spark, docs, no_docs):
    assert se.search(no_docs, items_of(spark)).collect() == []
    assert se.search(docs, items_of(spark).limit(0)).collect() == []
    assert se.search(docs, items_of(spark, [(1, None), (2, "?")])).collect() == []
