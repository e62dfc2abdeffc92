"""op8: fingerprints choose mappings, texts survive the template, digests equal plain ones."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from aerolens.llm import op8_chat as ch

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "a\\b\\\\<|end|>", "<|im_start|><<SYS>>x<</SYS>>", "é\\", "\n\n", "<|end|", "[INST[INST]]",
         "$1 \\1 \\$", "<<|turn|>|turn|>", "x" * 200_000, "日本\U0001f600<s>"]


def test_round_trip(spark):
    turns = [(r, t) for r in ("user", "assistant", "odd\nrole\\<|end|>", "") for t in NASTY]
    df = spark.createDataFrame([(1, turns), (2, [])], "id int, turns array<struct<role:string,text:string>>")
    d = df.select("id", ch.format_turns(F.col("turns")).alias("f"), "turns").select("id", "f.*", "turns")
    d = d.withColumns({"back": ch.parse(F.col("formatted")), "loss": ch.loss_texts(F.col("formatted"), F.col("loss_spans"))})
    one, none = d.orderBy("id").collect()
    assert [tuple(t) for t in one["back"]] == turns
    assert one["loss"] == NASTY
    body = one["formatted"]
    for c in ch.CONTROL:
        assert body.count(c) == (len(turns) if c in ("<|turn|>", "<|end|>") else 0)
    assert none["formatted"] == "" and none["back"] == [] and none["loss"] == []


LAYOUTS = [
    ({"messages": [("system", "s"), ("user", "u"), ("assistant", "a")]}, "messages", [("system", "s"), ("user", "u"), ("assistant", "a")]),
    ({"messages": [("user", None)]}, "messages", [("user", "")]),
    ({"messages": []}, "messages", []),
    ({"conversations": [("human", "u"), ("gpt", "a"), ("system", "s")]}, "sharegpt", [("user", "u"), ("assistant", "a"), ("system", "s")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"question": "p", "answer": "c"}, "question", [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"prompt": "p"}, None, None), ({}, None, None), ({"prompt": "p", "answer": "c"}, None, None)]


def test_fingerprints_choose_mappings(spark):
    schema = ("id int, formatted string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, prompt string, "
              "completion string, question string, answer string, instruction string, input string, output string")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple([k, "x", *[layout.get(c) for c in names[2:]]]) for k, (layout, *_) in enumerate(LAYOUTS)]
    got = ch.with_turns(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    for r, (_, name, turns) in zip(got, LAYOUTS):
        assert r["mapping"] == name
        assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns
    assert len({r["fingerprint"] for r in got}) == len({frozenset(str(k) for k in lay) if "messages" not in lay else str(lay) for lay, *_ in LAYOUTS})


def test_tables_without_some_layouts(spark):
    got = ch.with_turns(spark.createDataFrame([("p", "c", 1)], "prompt string, completion string, extra int")).first()
    assert got["mapping"] == "prompt" and got["extra"] == 1


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "hi", 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", "x\\<s>", 5), (None, None, None, "t", 5), (2, 0, "assistant", "é", 5),
                                  (2, 0, "assistant", "é", 5), (-1, 5, "user", "more", 5)]])
def test_query_digests(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_turns int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in ch.query(spark, str(tmp_path)).collect()}
    whole = [r[:4] for r in rows] + [(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    assert set(got) == {r[0] for r in whole}
    low = (False, 0)
    for i, r in got.items():
        turns = sorted((x[1:] for x in whole if x[0] == i), key=lambda x: tuple(low if v is None else (True, v) for v in (x[0], x[1])) + ((x[2] or ""),))
        text = "".join(f"{a or ''}\n{b or ''}\n" for _, a, b in turns)
        loss = "".join(b or "" for _, a, b in turns if a == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_no_python(spark):
    plan = ch.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
