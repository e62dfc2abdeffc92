"""op5: folding, exceptions, held-out accuracy on made rows."""

from __future__ import annotations

import random
import zlib

import pytest

from aerolens.llm import op5_toxicity as tx

CALM = "garden window letter bottle candle paper river stone table yellow music winter summer forest market".split()
RUDE = "snorgle blatfink wuzzock".split()


def rows(n=900):
    rng, out = random.Random(4), []
    for i in range(n):
        w = [rng.choice(CALM) for _ in range(rng.randint(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2 + len(w) // 40):
                r = rng.choice(RUDE) + rng.choice(["", "er", "ish"])
                w.insert(rng.randint(0, len(w)), rng.choice([r, r.replace("o", "0"), r.upper(), r.replace("a", "а")]))
        elif i % 7 == 0:
            w += ["snorgle", "cake"]                        # a harmless phrase
        out.append((i, " ".join(w), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    made = rows()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in made] + [(None, None, "x", 0.5), (5000, "", "x", 0.5), (0, made[0][1], "x", 0.5)],
                                 "doc_id bigint, text string, held_out string, score double").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in made] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in made}


def test_folding():
    assert tx.fold("Ídïót!  ID10T  іdiоt") == " idiot idiot idiot "
    assert tx.fold("y o u l 0 s e r now") == " youioser now "
    assert tx.fold(None) == tx.fold("") == tx.fold(" \t") == " "


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    got = tx.scores(docs, tx.learn(docs, labels)).collect()
    assert len(got) == len(truth) + 3
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97


def test_learning_uses_no_held_out_row_and_repeats(tables):
    docs, labels, truth = tables
    a = tx.learn(docs, labels)
    flipped = labels.where(~tx.held_out(labels["doc_id"]))
    b = tx.learn(docs.repartition(8), flipped)
    assert (a.terms, sorted(a.exceptions), a.coef) == (b.terms, sorted(b.exceptions), b.coef)


def test_exceptions_and_whole_texts():
    m = tx.Lexicon({" trash ": 2.0}, ["trash can"])
    assert m.matches(tx.fold("the trash can")) == [] and len(m.matches(tx.fold("you trash"))) == 1
    far = "calm " * 200_000 + "trash"
    assert m.inputs(far)[2] == 1


def test_without_labels(tables, no_docs, spark):
    docs, labels, _ = tables
    model = tx.learn(docs, labels.limit(0))
    assert model.inputs("what an IDI0T and l0ser")[2] == 2
    assert tx.scores(no_docs, model).collect() == []


def test_folding_of_all_characters():
    bold = "".join(chr(0x1D41A + ord(c) - 97) for c in "snorgle")
    assert tx.fold(bold) == tx.fold("snorgle") == tx.fold("\U0001F600snorgle\u3002")
    assert tx.fold("snor\u200bg\u00adle") == tx.fold("snorgle\ufe0f") == tx.fold("snorgle")


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.range(20_000).selectExpr("id % 4 * 3 as doc_id", "concat('text ', id) as text").unionByName(
        spark.range(100).selectExpr("cast(null as bigint) as doc_id", "'no id' as text"))
    labels = spark.range(0, 60).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").unionAll(spark.sql("select cast(null as bigint), 1"))
    got = tx.training_rows(docs, labels, bound=10)
    assert got.count() <= 4 and got.columns == ["text", "y"]
