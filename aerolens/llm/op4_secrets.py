"""Secret scans with a random forest that removes false positives.

Patterns give candidates (known prefixes, assignments to names such as
password or token, long mixed tokens).  A random forest then decides from the
candidate's length, its transitions between character classes, how much of it
dictionary words cover, the path (the document's source and a path-like token
on the line) and the neighbouring words.

The forest is Spark MLlib's, fitted on labelled findings: by default at most
LABELLED_HOSTS documents (those with the smallest id hashes) lend their text
and source, and seeded generators put keys (label 1) and look-alikes such as
placeholders, digests, identifiers and UUIDs (label 0) between their words.
Callers with reviewed findings pass their own table.  The bound concerns the
fit alone; every text is scanned whole.

Defined cases: null and empty texts have no findings; doc_id may be null or
repeated (each row is scanned); equal rows give equal findings; an empty
table gives no findings (the forest is then fitted without host texts);
extra columns are ignored by the scan and kept by the redaction.  Spans count
code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.llm.common import materialise, prepare, remove, scratch, table

LABELLED_HOSTS = 1500
TREES, DEPTH = 40, 9
THRESHOLD = 0.5
NEAR_WORDS = 3
NEAR_BUCKETS = 16
#: characters of context on each side in which neighbouring words are looked for
CONTEXT = 160
SCHEMA = ("doc_id bigint, start bigint, length bigint, rule string, digest string, masked string, "
          "score double, is_secret boolean")

# Published key formats, and words of names and placeholders.
PREFIXED = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9\-]{10,}",
    "stripe_key": r"[rs]k_live_[A-Za-z0-9]{16,}",
    "google_key": r"AIza[0-9A-Za-z_\-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END [A-Z ]*PRIVATE KEY-----",
}
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "auth_key",
         "credential", "private_key")
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "here", "test", "fake", "none", "null",
                "xxxx", "todo", "redacted", "insert", "value", "string", "enter")
DICTIONARY = (
    "about access account action admin after again all and any api app are array auth back base before between block "
    "build cache call case change check class client code column command commit common config content context control "
    "count create current data date debug default delete device document domain download element email enable error "
    "event example false field file filter find first folder for format from function get global group handler hash "
    "have header here high image index info input insert into item key label language last length level library line "
    "link list load local log login main make manager map message method model module most name network next node not "
    "number object option order other output package page parameter password path place point port process project "
    "public query read record release remote request reset resource response result return root sample save search "
    "secret section select send server service session set size source start state status store stream string system "
    "table target task test text that the this time title token type update upload url user value version view was "
    "when with word work write your").split()
RULES = [*PREFIXED, "assignment", "generic"]
SUSPECT_PATH = ("test", "spec", "example", "sample", "doc", "mock", "fixture")

_PREFIXED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PREFIXED.items()))
_HINTS = ("AKIA", "ASIA", "gh", "xox", "k_live_", "AIza", "eyJ", "-----BEGIN")
_ASSIGNED = re.compile(r"(?i)(?:" + "|".join(map(re.escape, NAMES)) + r")[\w\-]{0,20}[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?([^\s\"'<>,;]{8,})")
_GENERIC = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}")
_WORD = re.compile(r"\w+")
_DICT = re.compile("|".join(sorted((w for w in {*DICTIONARY, *PLACEHOLDERS, *NAMES} if len(w) > 2), key=lambda w: (-len(w), w))))
#: class of each ASCII character: small, capital, digit, other; the last entry is for all characters beyond
_CLASS = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in range(129)])


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of a text, in order, without overlaps (earlier rules win)."""
    found: list[tuple[int, int, str]] = []
    if any(h in text for h in _HINTS):
        found += [(m.start(), m.end(), m.lastgroup) for m in _PREFIXED.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "assignment") for m in _ASSIGNED.finditer(text)]
    if any(len(w) >= 20 for w in text.split()):
        for m in _GENERIC.finditer(text):
            s = m.group()
            if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s):
                found.append((m.start(), m.end(), "generic"))
    order = {r: i for i, r in enumerate(RULES)}
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for s, e, r in sorted(found, key=lambda x: (min(order[x[2]], len(PREFIXED)), x[0])):
        if len(found) == 1 or not any(s < b and a < e for a, b in taken):
            taken.append((s, e))
            out.append((s, e, r))
    return sorted(out)


def features(text: str, source: str, start: int, end: int, rule: str) -> list[float]:
    s = text[start:end]
    n = len(s)
    kinds = _CLASS[np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    move = np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16)
    freq = _frequencies(s)
    entropy = -sum(p * math.log2(p) for p in freq)
    low = s.lower()
    covered = sum(len(m) for m in _DICT.findall(low)) / n
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    near = [w.lower() for w in _WORD.findall(before)[-NEAR_WORDS:]] + [w.lower() for w in _WORD.findall(after)[:NEAR_WORDS]]
    hashed = [0.0] * NEAR_BUCKETS
    for w in near:
        if any(k in w for k in (*NAMES, *PLACEHOLDERS, "sha", "hash", "commit", "id", "uuid", "key", "md5", "version")):
            hashed[int.from_bytes(hashlib.md5(w.encode("utf-8", "replace")).digest()[:2], "big") % NEAR_BUCKETS] += 1.0
    line = before.rpartition("\n")[2] + after.partition("\n")[0]
    path = (source + " " + " ".join(w for w in line.split() if "/" in w)).lower()
    return [
        float(n), math.log(n), entropy, *(np.bincount(kinds, minlength=4) / n).tolist(),
        *(move / max(1, n - 1)).tolist(), covered,
        float(len(freq)) / n, float(all(c in "0123456789abcdefABCDEF" for c in s)), float("-" in s), float("_" in s), float("/" in s),
        float(any(p in low for p in PLACEHOLDERS)), float(any(k in w for w in near for k in NAMES)),
        float(any(p in w for w in near for p in PLACEHOLDERS)),
        float(any(w in ("commit", "sha1", "sha256", "md5", "hash", "digest", "checksum", "uuid", "revision") for w in near)),
        float(any(p in path for p in SUSPECT_PATH)), float("/" in path), *hashed, float(RULES.index(rule)),
        float(rule in PREFIXED), float(rule == "assignment"),
    ]


def _frequencies(s: str) -> list[float]:
    return [v / len(s) for v in Counter(s).values()]


# --- labelled findings ------------------------------------------------------

_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _made(rng: random.Random) -> tuple[str, int]:
    """A generated finding in its usual notation, and its label."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, upper = (lambda n: pick("0123456789abcdef", n)), _ALNUM[26:]
    quote, eq = rng.choice(["", '"', "'"]), rng.choice(["=", " = ", ": "])
    name = rng.choice(NAMES)
    words = lambda k, sep: sep.join(rng.choice(DICTIONARY) for _ in range(k))
    camel = lambda k: "".join(rng.choice(DICTIONARY).title() for _ in range(k))
    if rng.random() < 0.5:
        value = rng.choice([
            lambda: rng.choice(["AKIA", "ASIA"]) + pick(upper, 16), lambda: "ghp_" + pick(_ALNUM, 36),
            lambda: f"xoxb-{pick('0123456789', 12)}-{pick(_ALNUM, 24)}", lambda: "sk_live_" + pick(_ALNUM, 24),
            lambda: "AIza" + pick(_ALNUM + "-_", 35), lambda: f"eyJ{pick(_ALNUM, 20)}.eyJ{pick(_ALNUM, 40)}.{pick(_ALNUM, 43)}",
            lambda: f"{name}{eq}{quote}{hexa(rng.choice([16, 18, 20, 24, 32, 40, 64]))}{quote}",
            lambda: f"{name}{eq}{quote}{pick(_ALNUM + '!@#%^*', rng.randint(10, 40))}{quote}",
            lambda: f"{name}{eq}{quote}{pick(_ALNUM + '+/', 40)}{quote}"])()
        return value, 1
    value = rng.choice([
        lambda: "AKIA" + rng.choice(["EXAMPLE", "SAMPLE0", "XXXXXXX"]) + "EXAMPLE00", lambda: "AKIA" + rng.choice("X0A") * 16,
        lambda: "ghp_" + "x" * 36, lambda: f"{name}{eq}{quote}{rng.choice(['changeme', 'your_', 'example_', 'insert_'])}{words(2, '_')}{quote}",
        lambda: f"{name}{eq}{quote}{'x' * rng.randint(8, 30)}{quote}", lambda: f"{name}{eq}{quote}{words(rng.randint(2, 4), rng.choice('-_.'))}{quote}",
        lambda: f"{name}{eq}get{camel(3)}(", lambda: f"{name}{eq}${{{words(2, '_').upper()}}}", lambda: f"{name}{eq}os.environ['{words(2, '_').upper()}']",
        lambda: f"commit {hexa(40)}", lambda: f"sha256 {hexa(64)}", lambda: f"md5 checksum {hexa(32)}", lambda: f"revision {hexa(40)}",
        lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: camel(4) + str(rng.randint(1, 99)),
        lambda: words(4, "_") + f"_{rng.randint(1, 999)}", lambda: "/" + words(4, "/") + f"/{rng.randint(1, 9999)}",
        lambda: f"{words(3, '-')}-{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"])()
    return value, 0


def findings_in(text: str, source: str, seed: int, count: int = 6) -> list[tuple[list[float], float]]:
    """(features, label) of generated findings put between the words of a host text."""
    rng, out = random.Random(seed), []
    words = text.split(" ")
    for _ in range(count):
        made, label = _made(rng)
        at = rng.randint(0, len(words))
        left, right = " ".join(words[max(0, at - 20):at]), " ".join(words[at:at + 20])
        whole = f"{left} {made} {right}"
        lo, hi = len(left) + 1, len(left) + 1 + len(made)
        out += [(features(whole, source, s, e, r), float(label)) for s, e, r in candidates(whole) if s >= lo and e <= hi]
    return out


def labelled_findings(docs: DataFrame, hosts: int = LABELLED_HOSTS) -> DataFrame:
    """(features array<double>, label double) from at most ``hosts`` documents and as many made-up hosts.

    Rows that repeat a doc_id, and rows without one, are one host: that of the smallest text.
    """
    rows_of = docs.select(F.xxhash64(F.lit(5), "doc_id").alias("h"), F.col("text").cast("string").alias("text"),
                          F.col("source").cast("string").alias("source"))
    ids = rows_of.select("h").distinct().orderBy("h").limit(hosts)
    host = rows_of.join(F.broadcast(ids), "h", "left_semi").groupBy("h").agg(F.min(F.struct("text", "source")).alias("x")).select("h", "x.text", "x.source")
    blank = docs.sparkSession.range(hosts // 2, numPartitions=2).select(
        F.xxhash64("id").alias("h"), F.lit("").alias("text"),
        F.concat(F.element_at(F.array(*[F.lit(p) for p in ("src/main/", "src/test/", "docs/", "config/", "examples/", "lib/")]),
                              (F.col("id") % 6 + 1).cast("int")), F.lit("settings.py")).alias("source"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for h, t, s in zip(*(c.to_pylist() for c in b.columns)) for x in findings_in(t or "", s or "", h)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.list_(pa.float64())), pa.array([y for _, y in out])], ["features", "label"])

    return host.unionByName(blank).mapInArrow(rows, "features array<double>, label double")


# --- the forest -------------------------------------------------------------

class Forest:
    """The trees of a fitted classifier as arrays, for scoring inside Arrow tasks."""

    def __init__(self, trees: list[dict[str, np.ndarray]]):
        self.trees = trees

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of class 1, averaged over the trees."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(t["left"][at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                go_left = x[inner, t["feature"][node]] <= t["threshold"][node]
                at[inner] = np.where(go_left, t["left"][node], t["right"][node])
            total += t["value"][at]
        return total / max(1, len(self.trees))


def fit_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit MLlib's forest on ``labelled(features, label)``; its nodes (at most
    trees * 2**(depth+1)) come to the driver."""
    spark = labelled.sparkSession
    data = materialise(labelled.orderBy("label", "features").coalesce(1), "sec-labelled")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8, minInstancesPerNode=2).fit(
        data.select(array_to_vector("features").alias("features"), "label"))
    path = scratch(spark, "sec-forest")
    model.save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").toPandas()
    remove(data)
    out = []
    for _, t in nodes.sort_values("id").groupby("treeID"):
        stats = np.array([list(s) for s in t["impurityStats"]])
        split = list(t["split"])
        out.append({"left": t["leftChild"].to_numpy(), "right": t["rightChild"].to_numpy(),
                    "feature": np.array([max(0, s["featureIndex"]) for s in split]),
                    "threshold": np.array([s["leftCategoriesOrThreshold"][0] if len(s["leftCategoriesOrThreshold"]) else 0.0 for s in split]),
                    "value": stats[:, 1] / np.maximum(stats.sum(axis=1), 1e-9)})
    return Forest(out)


def scored(text: str | None, source: str | None, forest: Forest) -> list[tuple[int, int, str, float]]:
    found = candidates(text) if text else []
    if not found:
        return []
    p = forest.score(np.array([features(text, source or "", *c) for c in found]))
    return [(*c, float(v)) for c, v in zip(found, p)]


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate of ``docs(doc_id, text, source)``; see SCHEMA."""
    prepare(docs.sparkSession)
    forest = forest or fit_forest(labelled_findings(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, s in zip(*b.columns):
                text = t.as_py()
                for a, e, rule, p in scored(text, s.as_py(), forest):
                    v = text[a:e]
                    out.append((i.as_py(), a, e - a, rule, hashlib.sha256(v.encode("utf-8", "replace")).hexdigest(), v[:4] + "...", round(p, 6), p >= threshold))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    cols = [F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("source").cast("string")]
    return docs.select(*cols).mapInArrow(rows, SCHEMA)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs``; each secret in ``text`` replaced by its rule's name.

    ``n_chars``, if there as a number, follows the new text.
    """
    prepare(docs.sparkSession)
    forest = forest or fit_forest(labelled_findings(docs))
    names, counted = docs.columns, dict(docs.dtypes).get("n_chars") in ("int", "bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, size = b.column(names.index("text")), b.column(names.index("n_chars")) if counted else None
            new: dict[int, str] = {}
            for k, (t, s) in enumerate(zip(text, b.column(names.index("source")))):
                old = t.as_py()
                hits = [x for x in scored(old, s.as_py(), forest) if x[3] >= threshold]
                if hits:
                    parts, at = [], 0
                    for a, e, rule, _ in hits:
                        parts += [old[at:a], f"[{rule} removed]"]
                        at = e
                    new[k] = "".join([*parts, old[at:]])
            if new:
                texts = [new[k] if k in new else t.as_py() for k, t in enumerate(text)]
                cols = list(b.columns)
                cols[names.index("text")] = pa.array(texts, text.type)
                if counted:
                    sizes = [len(new[k]) if k in new else n.as_py() for k, n in enumerate(size)]
                    cols[names.index("n_chars")] = pa.array(sizes, size.type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
