"""op3: every id in one piece, gapless, within the limits, ids as the library gives them."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerolens.llm import op3_packing as pk


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts, tokenizer, limits):
    seqs, want = defaultdict(list), defaultdict(list)
    for t in texts:
        want[t[0]].append(np.array([*tokenizer.encode(t[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for parts in seqs.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        total = sum(r["length"] for r in parts)
        assert 0 < total <= limits.tokens and len(parts) <= limits.segments and sum(r["loss_tokens"] for r in parts) <= limits.loss
        assert total & (total - 1) == 0                     # no sequence needs padding
    for doc, arrays in want.items():
        expected = sorted((a[r["start"]:r["start"] + r["length"]].tobytes(), r["start"]) for a in arrays for r in pieces[doc] if r["doc_tokens"] == len(a))
        assert sum(r["length"] for r in pieces[doc]) == sum(map(len, arrays))
        assert {zlib.crc32(b) for b, _ in expected} >= {r["ids_crc32"] for r in pieces[doc]}
        if len(arrays) == 1:
            parts = sorted(pieces[doc], key=lambda r: r["start"])
            assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])


@pytest.mark.parametrize("limits", [pk.Limits(), pk.Limits(tokens=64, segments=3, loss=64)])
def test_round_trip(docs, tokenizer, limits):
    small = docs.where("doc_id is null or doc_id not in (40, 41)") if limits.tokens < 1024 else docs
    check(pk.pack(small, limits).collect(), [(r["doc_id"], r["text"]) for r in small.collect()], tokenizer, limits)


def test_prompts_bear_no_loss(spark, tokenizer):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["red", "green", "blue"]) for _ in range(n))
    rows = [(i, say(rng.randint(1, 30)), say(rng.randint(1, 30))) for i in range(200)]
    limits = pk.Limits(tokens=64, segments=8, loss=32)
    got = pk.pack(spark.createDataFrame(rows, "doc_id bigint, text string, prompt string").coalesce(1), limits).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    assert all(sum(r["loss_tokens"] for r in x) <= 32 and sum(r["length"] for r in x) <= 64 and len(x) <= 8 for x in by.values())
    ids = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert sum(r["loss_tokens"] for r in got) == sum(ids(t) + 1 for _, t, _ in rows)
    assert sum(r["length"] for r in got) == sum(ids(t) + ids(p) + 1 for _, t, p in rows)


def test_ids_equal_the_library(tokenizer):
    rng, enc = random.Random(1), pk.Encoder()
    for _ in range(300):
        s = "".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0xD800), rng.randrange(0x10000, 0x1FFFF), 32, 10, 9])) for _ in range(40))
        assert enc(s) == tokenizer.encode(s, add_special_tokens=False).ids
    assert enc("a<|endoftext|>b") == tokenizer.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_empty_table(no_docs):
    assert pk.pack(no_docs).collect() == []


@pytest.mark.parametrize("blanks", [" " * 1_000_000, "\n" * 2_000_000, "\u00a0" * 1_000_000])
def test_long_white_space(spark, tokenizer, blanks):
    text = f"before{blanks}after"
    assert pk.Encoder()(text) == tokenizer.encode(text, add_special_tokens=False).ids
    if blanks[0] == " ":
        limits = pk.Limits()
        check(pk.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), limits).collect(), [(1, text)], tokenizer, limits)
