"""op10 against counts made word by word, and a plain MCD check."""

from __future__ import annotations

import random
import re
from collections import Counter

from aerolens.llm import op10_quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    many = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)


def test_base_counts(spark, docs):
    extra = [(900, "a b c d e a b c d e a b c d e f\na b\n a b\na b\n\n\n#*$%&|<>\nu v w x y u v w x y z"), (901, "é x y 日本 語\x1c\x1f z\x0bq\x0cr"),
             (902, "one two three four five six seven eight nine ten eleven twelve " * 1 + "one two three four five")]
    more = spark.createDataFrame([(i, t, "en", "a") for i, t in extra], "doc_id bigint, text string, lang string, source string")
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    texts = sorted(((r["doc_id"] is not None, r["doc_id"], brute(r["text"])) for r in rows.collect()), key=str)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
                  for r in q.quality_verdicts(rows).collect()), key=str)
    assert got == texts


def _corpus(n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(12, 200))]
        junk = i % 20 == 0
        if junk:
            w = [x + rng.choice(["***", "$$$", "|||"]) for x in w] if i % 40 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w).capitalize() if not junk else " ".join(w), "en" if i % 2 else "de", "hot" if i % 3 else None, junk))
    return rows


def test_outliers_go_and_the_rest_stays(spark):
    rows = _corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, junk boolean")
    kept = {r["doc_id"]: r["kept"] for r in q.quality_verdicts(df).collect()}
    assert [i for i, *_, junk in rows if junk == kept[i]] == []
    good = q.keep_good(df)
    assert good.columns == df.columns
    assert sorted(r["doc_id"] for r in good.collect()) == [i for i, *_, junk in rows if not junk]


def test_verdicts_don_t_depend_on_the_partitions(spark):
    df = spark.createDataFrame(_corpus(300), "doc_id bigint, text string, lang string, source string, junk boolean")
    a = sorted(map(tuple, q.quality_verdicts(df.repartition(2)).collect()))
    assert a == sorted(map(tuple, q.quality_verdicts(df.repartition(7)).collect()))


def test_no_python_on_the_main_path(spark, docs):
    plan = q.with_stats(docs, [])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(no_docs):
    assert q.quality_verdicts(no_docs).collect() == []
    assert q.keep_good(no_docs).collect() == []
