"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters of other
scripts to plain letters, digits and signs that stand for letters to those
letters (l, i and 1 count as one), everything else to blanks, and letters
spelled out one by one joined.  The lexicon holds whole words and word
beginnings with weights; an automaton finds them in one pass.  Matches inside
an exception phrase don't count.  The score is a logistic function of the
summed weight and of the summed weight per word.

Lexicon, exceptions and the logistic function are learned from labelled rows
whose crc32(doc_id as text) mod 3 is not 1, at most MAX_TRAIN of them (those
with the smallest id hashes): a term's weight is the smoothed log-odds of the
documents that hold it.  Label, language, source and id are no inputs of a
score.  Every text is scored whole.

Defined cases: null and empty texts get the score of no matches; a null
doc_id is not held out; without usable labels the lexicon is DEFAULT_LEXICON;
rows that repeat a doc_id are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.llm.common import materialise, prepare, table

MAX_TRAIN = 12_000
MAX_TERMS = 4_000
MIN_DOCS, MIN_WEIGHT = 4, 2.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_matches bigint, n_words bigint"

# Letters that look like plain ones, and signs that stand for them.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ԛ": "q", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
    "æ": "ae", "œ": "oe"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
DEFAULT_LEXICON = {" idiot ": 3.0, " moron ": 3.0, " stupid ": 2.5, " scum ": 3.0, " loser ": 2.5, " worthless ": 2.5,
                   " pathetic ": 2.5, " disgusting ": 2.5, " trash ": 2.0, " clown ": 2.0}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "stupid mistake", "not stupid", "not an idiot")


class _Table(dict):
    """What each character folds to, worked out when it is first met; marks, format characters and variation selectors vanish."""

    def __missing__(self, cp: int) -> str:
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        base = "".join(HOMOGLYPHS.get(x, SIGNS.get(x, x)) for x in base.lower())
        base = "".join(x if x.isalnum() else " " for x in base).replace("l", "i")
        unseen = unicodedata.category(c) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF
        self[cp] = "" if unseen or unicodedata.combining(c) else (base or " ")
        return self[cp]


_FOLD = _Table()
_SPELLED = re.compile(r"(?<= )(?:\w ){3,}")


def fold(text: str | None) -> str:
    """The folded text, with a blank at each end and single blanks between words."""
    words = " ".join((text or "").translate(_FOLD).split())
    return _SPELLED.sub(lambda m: m.group().replace(" ", "") + " ", f" {words} ") if words else " "


class Lexicon:
    """Weighted terms in an automaton, exception phrases, and the logistic coefficients."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], coef: tuple[float, ...] = (-4.0, 1.2, 2.0)):
        self.terms, self.exceptions, self.coef, self._automaton = terms, exceptions, coef, None

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "coef": self.coef, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for e in self.exceptions:
                a.add_word(f" {e} ", (len(e) + 2, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of the matches that count: one a word, the strongest, outside exceptions."""
        if not self.terms and not self.exceptions:
            return []
        best: dict[int, float] = {}
        benign: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton().iter(folded):
            start = end - n + 1
            if w is None:
                benign.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in benign)]

    def inputs(self, text: str | None) -> tuple[float, float, int, int]:
        folded = fold(text)
        found, words = self.matches(folded), max(1, folded.count(" ") - 1)
        total = sum(w for _, w in found)
        return math.log1p(total), math.log1p(100.0 * total / words), len(found), 0 if folded == " " else words

    def score(self, a: float, b: float) -> float:
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _terms(text: str | None) -> list[str]:
    words = set(fold(text).split())
    out = {f" {w} " for w in words if 3 <= len(w) <= 40}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return sorted(out)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> DataFrame:
    """(text, y) of at most ``bound`` labelled documents that are not held out; rows that repeat a doc_id are one, of the smallest text."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(bound)
    found = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return found.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Lexicon:
    """Term weights, exception phrases and coefficients.

    The fit is on a bounded sample and so is what comes to the driver: at most
    ``bound`` rows, and of the terms and of the phrases the MAX_TERMS of most
    weight or use.  Terms are words of 3 to 40 letters and beginnings of words.
    """
    prepare(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, bound), "tox-train")
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not pos or pos == n:
        return Lexicon({fold(t).rstrip() + " ": w for t, w in DEFAULT_LEXICON.items()}, [fold(e).strip() for e in EXCEPTIONS])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_terms(t.as_py()) for t in b.column(0)], pa.list_(pa.string())), b.column(1)], ["terms", "y"])

    each = rows.mapInArrow(terms, "terms array<string>, y int").select(F.explode("terms").alias("term"), "y")
    counts = each.groupBy("term").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    weight = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("c") - F.col("p") + 0.5) / (n - pos + 1.0))
    kept = counts.withColumn("w", F.round(weight, 4)).where((F.col("p") >= MIN_DOCS) & (F.col("w") >= MIN_WEIGHT))
    found = [(r["term"], r["w"]) for r in kept.orderBy(F.desc("w"), F.desc("p"), "term").limit(MAX_TERMS).collect()]
    lexicon: dict[str, float] = {}
    for t, w in sorted(found, key=lambda x: (len(x[0]), x[0])):          # a beginning stands for the words it explains
        if not any(lexicon.get(t[:k], 0.0) >= 0.8 * w for k in (5, 6, 7)):
            lexicon[t] = w
    model = Lexicon(lexicon, [fold(e).strip() for e in EXCEPTIONS])

    # phrases around a match that clean documents use and toxic ones don't
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f, seen = fold(t), set()
                for s, _ in model.matches(f):
                    one = (f.find(" ", s + 1) + 1 or len(f) + 1) - 1          # ends of the word at the match and of the next
                    two = (f.find(" ", one + 1) + 1 or len(f) + 1) - 1
                    seen |= {f"{f[f.rfind(' ', 0, s) + 1:s]} {f[s + 1:one]}".strip(), f[s + 1:two].strip()}
                out += [(p, y) for p in sorted(seen) if " " in p]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32())], ["phrase", "y"])

    benign = rows.mapInArrow(phrases, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("c"))
    benign = benign.where(f"p = 0 and c >= {MIN_DOCS}").orderBy(F.desc("c"), "phrase").limit(MAX_TERMS)
    model.exceptions += [r["phrase"] for r in benign.collect()]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.inputs(t.as_py())[:2] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in x]), pa.array([v for _, v in x]), b.column(1)], ["a", "b", "y"])

    xy = np.array(sorted(tuple(r) for r in rows.mapInArrow(values, "a double, b double, y int").collect()), float)
    model.coef = _logistic(xy[:, :2], xy[:, 2])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Coefficients (constant first) of a ridge logistic regression by Newton steps."""
    z = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 9) for v in w)


def scores(docs: DataFrame, model: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches, n_words) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.inputs(t.as_py()) for t in b.column(2)]
            s = [round(model.score(v[0], v[1]), 9) for v in x]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32()),
                 pa.array([v[2] for v in x], pa.int64()), pa.array([v[3] for v in x], pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scores(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
