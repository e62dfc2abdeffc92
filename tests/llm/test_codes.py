"""op13 against a plain version in Python integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from aerolens.llm import op13_codes as pq
from aerolens.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(x)) for x in e], y) for i, e, y in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return [], None
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), y) for i, v, y in kept]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min((dist(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    out, by_label = [], {}
    for i, v, y in kept:
        got = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in got)
        by_label[y] = by_label.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in got), error, y))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, min(e, pq.LONG_MAX), min(by_label[y], pq.LONG_MAX)) for i, c, e, y in out], hashlib.sha256(flat.encode()).hexdigest()


def ours(spark, rows, **how):
    coded, books = pq.encode(spark.createDataFrame([(i, e, y, "x", "y") for i, e, y in rows], SCHEMA).repartition(3), **how)
    got = [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in pq._label_errors(coded).collect()]
    return got, pq.codebooks_digest(books) if got else None


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def f32(x):
    return float(np.float32(x))


def random_rows(seed, n, dim, step=None):
    rng = random.Random(seed)
    x = lambda: f32(rng.gauss(0, 0.2)) if step is None else rng.randint(-2, 2) * step
    return [(i * 3 - 20, [x() for _ in range(dim)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    random_rows(1, 300, 64),
    random_rows(2, 200, 16, step=1 / 4096),                     # a small grid: many ties
    random_rows(3, 40, 13),                                     # a length that 8 doesn't divide
    random_rows(4, 5, 16),                                      # fewer rows than entries
    random_rows(5, 60, 24) + [(None, [0.5] * 24, 1), (None, [0.25] * 24, None), (7, None, 1), (8, [float("nan")] * 24, 1),
                              (9, [None] * 24, 0), (10, [float("inf")] * 24, 0), (11, [], 0), (12, [0.5], 0), (-20, [0.125] * 24, 1)]
    + [(500 + i, [0.75] * 24, 0) for i in range(90)],           # a vector many times, repeated ids, short ones
    [(i, [f32((-1) ** i * 10.0 ** (i % 15)), 1.0] * 8, 0) for i in range(60)],   # integers up to 62 bits
    [(0, [], 1), (1, [], None)],
], ids=["normal", "ties", "padded", "few", "edges", "huge", "no-components"])
def test_equals_plain_version(spark, rows):
    got, digest = ours(spark, rows)
    want, sha = plain(rows)
    assert ordered(got) == ordered(want) and digest == sha


def test_components_beyond_a_long_are_held(spark):
    coded, books = pq.encode(spark.createDataFrame([(0, [f32(3e38), 0.0], 1, "", ""), (1, [f32(-3e38), 0.0], 1, "", "")], SCHEMA))
    assert sorted(int(x) for x in books.ravel())[0] == -(1 << 63) and int(books.max()) == pq.LONG_MAX
    assert [r["error"] for r in coded.collect()] == [0, 0]


def test_orchard_measures_less_and_finds_the_nearest():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (64, 8))
    x = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 8))
    entry, dist, measured = pq.orchard(x, centres)
    full = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (entry == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()
    assert measured < 0.7 * full.size
    same = np.repeat(np.array([[1, 2], [1, 2], [0, 0]]), 1, axis=0)
    assert pq.orchard(np.array([[1, 2], [0, 1], [5, 5]]), same)[0].tolist() == [0, 2, 0]


def test_empty_table_and_decode(spark):
    coded, books = pq.encode(spark.createDataFrame([], SCHEMA))
    assert pq._label_errors(coded).collect() == [] and pq.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    rows = random_rows(6, 50, 16)
    coded, books = pq.encode(spark.createDataFrame([(i, e, y, "", "") for i, e, y in rows], SCHEMA))
    back = {r["vec_id"]: r for r in pq.decode(coded, books).collect()}
    for i, e, _ in rows:
        v = [math.floor(4096 * x) for x in e]
        assert sum((a - b) ** 2 for a, b in zip(v, back[i]["v"])) == back[i]["error"]


def test_query_reads_the_whole_table(spark):
    n = table(spark, "/root/testdata/sf0.001", "embeddings").count()
    got = pq.query(spark, "/root/testdata/sf0.001")
    assert got.count() == n and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
