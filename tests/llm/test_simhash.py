"""op11 against brute force: fingerprints word by word, links over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from aerolens.llm import op11_simhash as sh
from tests.llm.conftest import SCHEMA


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(rows, limit=3):
    """[(doc_id, fingerprint)] to the component of each row."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    fps = sorted({f for _, f in rows})
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= limit:
                up[find(("f", a))] = find(("f", b))
    for d, f in rows:
        if d is not None:
            up[find(("d", d))] = find(("f", f))
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(("f", f))
            least[r] = min(d, least.get(r, d))
    return [least.get(find(("f", f))) for _, f in rows]


@pytest.mark.parametrize("split", [sh.SPLIT, 1])
def test_equals_brute_force(spark, docs, split):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = sorted((d is None, d or 0, f"{f:016x}", c if c is not None else -1) for (d, f), c in zip(fps, plain_components(fps)))
    got = sh.near_duplicates(docs, split).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == want
    zero = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert zero == {14}                                             # null, empty and blank texts are one class


def near_fingerprints(seed, n):
    """Chains and balls of fingerprints around few centres, and their neighbours four bits away."""
    rng = random.Random(seed)
    out = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n):
            x = centre
            for p in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << p
            out.add(x)
            if rng.random() < 0.3:
                centre = x
    return sorted(out)


@pytest.mark.parametrize("split", [10**9, 8, 1])
def test_links_of_crowded_keys(spark, split):
    fps = near_fingerprints(3, 120)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = sh.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), split).collect()
    assert all(r["u"] != r["v"] for r in got)
    at = {x: i for i, x in enumerate(signed)}
    found = sh._hooked(np.arange(len(fps)), np.array([at[r["u"]] for r in got]), np.array([at[r["v"]] for r in got]))
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    same = lambda c: sorted(sorted(i for i in range(len(c)) if c[i] == v) for v in set(c))
    assert same(list(found)) == same(want)
    if split == 1:
        assert sh._crowded(spark.createDataFrame([(x,) for x in signed], "fp bigint"), split).count() > 0


def test_tiles_and_sides_of_a_key():
    fps = np.array(near_fingerprints(5, 200), np.uint64)
    for bit in (-1, 0, 17, 63):
        whole, tiled = sh.stars(fps, bit), sh.stars(fps, bit, tile=64)
        assert sorted(whole[0]) == sorted(tiled[0]) and len(whole[0]) < len(fps)


def test_bits_set_in_exactly_half_are_zero():
    rng = random.Random(2)
    for n in (1, 2, 3, 4, 5, 8, 200):
        t = " ".join(rng.choice("ab") for _ in range(n))
        assert sh.fingerprint(t) == plain_fingerprint(t)
    assert sh.fingerprint("É É\x0bé ÀB c") == plain_fingerprint("É É\x0bé ÀB c")


def test_empty_and_many_copies(spark, no_docs):
    assert sh.near_duplicates(no_docs).collect() == []
    one = spark.range(3000).selectExpr("id + 5 as doc_id", "'the same text in all of these rows' as text", "'x' as fp", "1 as comp")
    got = sh.near_duplicates(one).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(5, 3000)]
    alone = spark.createDataFrame([(7, "one text of its own"), (None, "")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in sh.near_duplicates(alone).collect()) == [(-1, -1), (7, 7)]
