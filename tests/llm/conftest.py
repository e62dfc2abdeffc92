from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, slot string, n_words string"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
         "phi chi psi omega one two three four five six seven eight nine ten").split()


def made_texts(seed: int = 7) -> list[tuple]:
    """Rows with nulls, blanks, copies, near copies, repeated rows and a long text; clashing extra columns."""
    rng = random.Random(seed)
    rows = []
    add = lambda i, t, lang="en", src="a": rows.append((i, t, lang, src, None if t is None else len(t), "x", "y", "z"))
    base = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(120)]
    add(1, " ".join(base))
    for k in range(2, 9):                                   # near copies with k - 1 changed words
        w = list(base)
        for p in rng.sample(range(len(w)), k - 1):
            w[p] = f"changed{k}x{p}"
        add(k, " ".join(w), src="b")
    for k in range(9, 14):                                  # copies: case and white space differ
        add(k, "\n".join(base).upper() if k % 2 else "  ".join(base))
    add(14, None)
    add(15, "")
    add(16, " \t\n ")
    add(17, "two words")
    add(18, "Two  words")
    add(19, "two words here", None, None)
    for k in range(20, 40):
        add(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 90))), rng.choice(["en", "de", None]), rng.choice("abc"))
    add(40, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60_000)))
    add(41, "x" * 400_000)
    add(None, "a row without an id has five words")
    rows.append(rows[0])                                    # a repeated row
    add(20, "the same id with another text of six words")
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(made_texts(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
