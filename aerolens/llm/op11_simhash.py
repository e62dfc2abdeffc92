"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64
values (seed 42) of the text's 3-word shingles, repeats included (lower-cased
A-Z, words split at ASCII white space, shingles joined by one blank; a text
of fewer words is one shingle, a text without words has fingerprint 0).

Two fingerprints link at LIMIT = 3 differing bits or fewer.  Cut into two
segments of 32 bits, one segment then differs by at most one bit (cuts for an
equal segment would have to be four).  So each distinct fingerprint is indexed
under 64 keys: for each segment, its value with bit p struck out, p = 0..31.
Fingerprints that share a key are compared in full inside the task that has
the key.  Two whose segments are equal share all 32 keys of it; they are
compared under p = 0 only, and under the other keys only those on the two
sides of bit p, so nothing is compared twice.  A key yields a spanning star
of its links, never its pairs.

Keys with many fingerprints are split the same way once more: the other
segment is cut in two halves of 16 bits, one of which again differs by at
most one bit, and the key is extended by that half with a bit struck out.  So
extended, a key fixes 46 of the 64 bits and holds at most 2**18 fingerprints,
whatever the table's size.  Which keys need it is known from the counts of
the exact segment values (two rows a fingerprint).

Defined cases: rows with equal fingerprints are linked, those of fingerprint
0 (null, empty or blank texts) like any other; rows that repeat a doc_id with
other texts are one document and tie their classes together; a row without
doc_id belongs to the class of its fingerprint (null if no row there has an
id); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.llm.common import arrow_rows, connected_components, materialise, prepare, remove, small, table

WORDS = 3
SEED = 42
LIMIT = 3
SEGMENT, HALF = 32, 16    # bits of a segment, of a half of the other segment
#: fingerprints of an exact segment value from which its keys are split
SPLIT = 1024
#: fingerprints compared with as many at once
TILE = 2048
#: shingles whose bits are counted at once
CHUNK = 1 << 16
NARROW_ROWS = 20_000


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-WORDS] + 1)).tolist()
    ends = ends[WORDS - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def _hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable by the links (a, b), for stars of earlier links in ``label``."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer
        if np.array_equal(before, label):
            return label


def stars(fps: np.ndarray, bit: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(u, root) links that connect what the links of one key connect.

    ``fps``: distinct fingerprints that share a key.  ``bit``: the struck-out
    bit whose two sides are compared; -1: all are compared with all.
    """
    n = len(fps)
    label, linked = np.arange(n), np.zeros(n, bool)
    if bit < 0:
        left = right = np.arange(n)
    else:
        side = (fps >> np.uint64(bit)) & np.uint64(1) == 1
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
    for i in range(0, len(left), tile):
        for j in range(i if bit < 0 else 0, len(right), tile):
            p, q = left[i:i + tile], right[j:j + tile]
            near = np.bitwise_count(fps[p][:, None] ^ fps[q][None, :]) <= LIMIT
            if bit < 0 and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                a, b = p[x], q[y]
                linked[a] = linked[b] = True
                label = _hooked(label, a, b)
    u = np.flatnonzero(linked & (label != np.arange(n)))
    return fps[u], fps[label[u]]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, more, bit, fp) sorted by (key, more) to links (u, v); holds the rows of one key."""
    def links(cols: list[np.ndarray], bounds: np.ndarray) -> pa.RecordBatch | None:
        us, vs = [], []
        bits, fps = cols[2], cols[3].view(np.uint64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            u, v = stars(fps[lo:hi], int(bits[lo]))
            if len(u):
                us.append(u)
                vs.append(v)
        if us:
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        return None

    def groups(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
        key, more, bit, fp = cols
        edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(more) != 0)) + 1
        bounds = np.concatenate((np.zeros(1, np.int64), edge, np.array([len(key)] if last else [], np.int64)))
        # most keys have one fingerprint: only the others are walked
        lo, hi = bounds[:-1], bounds[1:]
        out = None
        if (several := hi - lo > 1).any():
            size = (hi - lo)[several]
            take = np.repeat(lo[several] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            out = links([c[take] for c in cols], np.concatenate(([0], np.cumsum(size))))
        return out, [c[bounds[-1]:] for c in cols]

    held: list[np.ndarray] | None = None
    parts: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None and held[0][0] == cols[0][-1] and held[1][0] == cols[1][-1]:
            parts.append(cols)                 # still the same key: join once it ends
            continue
        cols = [np.concatenate(x) for x in zip(*([held] if held is not None else []), *parts, cols)]
        parts = []
        done, held = groups(cols, False)
        if done is not None:
            yield done
    if held is not None:
        done, _ = groups([np.concatenate(x) for x in zip(held, *parts)], True)
        if done is not None:
            yield done


def _segment(s: int, fp: str = "fp") -> Column:
    """Segment ``s`` of a fingerprint as a number below 2**32."""
    return F.shiftrightunsigned(fp, SEGMENT * s).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def _variants(value: Column, width: int, part: int) -> Column:
    """Array of (key, bit): ``value``, the ``part``-th (0 or 1) of two, with each of its ``width`` bits struck out.

    ``bit`` is the bit's place in the fingerprint; -1 stands for the first
    variant, under which equal values are compared too.
    """
    one = lambda p: F.struct(
        ((value.bitwiseAND(F.lit(~(1 << p))) * width + F.lit(p)) * 2 + F.lit(part)).alias("key"),
        F.lit(width * part + p if p else -1).alias("bit"))
    return F.array(*[one(p) for p in range(width)])


def indexed(fps: DataFrame) -> DataFrame:
    """(key, bit, fp): the 64 one-wildcard keys of each of distinct ``fps(fp)``."""
    keys = F.concat(*[_variants(_segment(s), SEGMENT, s) for s in (0, 1)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.key", "k.bit", "fp")


def _crowded(fps: DataFrame, split: int) -> DataFrame:
    """(key): keys that may hold over ``2 * split`` fingerprints; few, as each stands for ``split`` of them."""
    pairs = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(s).alias("v")) for s in (0, 1)])).alias("x")).select("x.*")
    large = pairs.groupBy("s", "v").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > split)
    keys = F.when(F.col("s") == 0, _variants(F.col("v"), SEGMENT, 0)).otherwise(_variants(F.col("v"), SEGMENT, 1))
    return large.select(F.explode(keys).alias("k")).select("k.key").distinct()


def _extended(rows: DataFrame) -> DataFrame:
    """(key, more, bit, fp): crowded keys extended by a half of the other segment with a bit struck out.

    Two fingerprints of a key with bit >= 0 count on its two sides only, which
    the comparison of all that share an extended key includes.
    """
    other = F.when(F.col("key") % 2 == 0, _segment(1)).otherwise(_segment(0))
    mask = F.lit((1 << HALF) - 1)
    halves = F.concat(*[_variants(F.shiftrightunsigned(other, HALF * h).bitwiseAND(mask), HALF, h) for h in (0, 1)])
    return rows.select("key", F.explode(halves).alias("k"), "bit", "fp").select("key", F.col("k.key").alias("more"), "bit", "fp")


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (u, v) that connect all distinct ``fps(fp)`` at LIMIT differing bits or fewer."""
    keyed = indexed(fps)
    crowded = materialise(_crowded(fps, split), "sim-crowded")
    n = crowded.count()
    if n:
        mark = small(crowded.withColumn("_crowded", F.lit(True)), n)
        keyed = keyed.join(mark, "key", "left")
        plain = keyed.where("_crowded is null").select("key", F.lit(-1).cast("bigint").alias("more"), "bit", "fp")
        keyed = plain.unionByName(_extended(keyed.where("_crowded")))
    else:
        keyed = keyed.select("key", F.lit(-1).cast("bigint").alias("more"), "bit", "fp")
    dealt = keyed.repartition("key", "more").sortWithinPartitions("key", "more")
    with arrow_rows(fps.sparkSession, NARROW_ROWS):
        return materialise(dealt.mapInArrow(_search, "u bigint, v bigint").distinct(), "sim-links")


def near_duplicates(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialise(texts.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "sim-base")
    reps = materialise(base.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")), "sim-reps")
    found = links(reps.select("fp"), split)
    several = base.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w")
    several = materialise(several.select("doc_id", "v"), "sim-repeated")
    n_several = several.count()
    edges = found
    if n_several:                              # rows that repeat a doc_id with other texts
        edges = edges.union(base.join(small(several, n_several), "doc_id").select(F.col("fp").alias("u"), "v"))
    comps = materialise(connected_components(edges), "sim-comps")

    # what isn't alone: fingerprints of several rows or in a component
    n_comps = comps.count()
    named = reps.join(small(comps, 2 * n_comps), F.col("fp") == F.col("node"), "left").select("fp", "doc", "n", F.coalesce("comp", "fp").alias("comp"))
    roots = comps.select("comp").distinct().select("comp", F.lit(True).alias("_root"))
    named = named.join(small(roots, n_comps), "comp", "left").where("n > 1 or fp <> comp or _root")
    least = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    classes = materialise(named.select("fp", "comp").join(least, "comp").select("fp", "component_id"), "sim-classes")
    out = base.join(small(classes, classes.count()), "fp", "left")
    out = out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    for t in (found, several, comps, reps):
        remove(t)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
