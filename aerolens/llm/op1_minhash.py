"""MinHash near-duplicates with tensored banding and verified links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles
(lower-cased A-Z, words split at ASCII white space; fewer than five words are
one shingle).  Banding with L tables of 6 minima each would need 6 * L minima.
Here two collections of ``M`` keys of ``K`` minima are made, and table (i, j)
is keyed by the pair (a_i, b_j): M * M = 256 tables out of 2 * M * K = 96
minima.  A pair of similarity s meets in a table with probability
(1 - (1 - s**K)**M)**2: 0.9997 at 0.75, above 0.99999 from 0.8 on.

Before the pairs are formed, keys a_i and b_j that no second document has are
left out: a table key that two documents share needs both halves shared, so
this loses nothing and most documents form no table key at all.

Tables can hold large groups, so pairs are never listed whole.  First every
table compares its members with one pivot, its smallest document; pairs that
pass the check on full sets are merged into components, which closes the
tables of true copies at once.  The documents of tables that still span
several components are then compared inside Arrow tasks, in blocks of at most
about BLOCK documents that share a key a_i: a pair counts in the first such
key only, needs a common b_j too (so it does share a table), different
components, fitting sizes and enough equal values of a wider sketch, and only
what passes is written and checked on full sets.

Defined cases: null, empty or blank texts have no set and are linked with
nothing; rows with a null doc_id are linked with nothing (component null,
kept); rows that repeat a doc_id count as one document; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from aerolens.llm.common import connected_components, materialise, prepare, remove, small, table

WORDS = 5                 # words per shingle
NUM, DEN = 75, 100        # link if DEN * |A n B| >= NUM * |A u B|
M, K = 16, 3              # keys per collection, minima per key
N_MINIMA = 2 * M * K
#: least equal minima (of 96) for a pair to be compared on full sets; a pair
#: at 0.75 has 72 on average with a deviation of 4.3, so this is seven away
MIN_EQUAL = 42
#: values of the wider sketch (8 bits each), and how many must be equal: a pair
#: at 0.75 has 577 on average with a deviation of 12; 523 is four and a half away
WIDE, MIN_WIDE = 768, 523
#: documents per block of a large key
BLOCK = 512
#: documents up to this count have their minima (400 bytes each) broadcast
BROADCAST_SIGS = 30_000

_rng = np.random.Generator(np.random.PCG64(20240611))


def _r64(n: int) -> np.ndarray:
    return _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE, _BASE, _POS = _r64(256), _r64(1)[0], _r64(WORDS + 1)
_MUL, _ADD = _r64(N_MINIMA), _r64(N_MINIMA)
_WIDE_MUL, _WIDE_ADD = _r64(WIDE), _r64(WIDE)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
for _b in range(65, 91):                      # A-Z hash as a-z
    _BYTE[_b] = _BYTE[_b + 32]
_BYTE[_SPACE] = 0
_CHUNK = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
    p, q = np.empty(n, np.uint64), np.empty(n, np.uint64)
    p[0] = q[0] = 1
    p[1:], q[1:] = _BASE, inv
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


_POW, _INV = _powers(1 << 16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(part: np.ndarray) -> np.ndarray:
    """One 64-bit polynomial hash per word of a byte array (words are whole in it)."""
    global _POW, _INV
    n = len(part)
    if n > len(_POW):
        _POW, _INV = _powers(1 << int(n - 1).bit_length())
    edge = np.diff(np.concatenate(([True], _SPACE[part], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _POW[:n], dtype=np.uint64)))
    return _mix((c[end] - c[start]) * _INV[start])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (empty without words)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts, at = [], 0
    while at < len(data):                     # long texts: pieces that end at white space
        to = at + _CHUNK
        if to < len(data):
            while True:
                gap = np.flatnonzero(_SPACE[data[max(at, to - 4096):to]])
                if len(gap):
                    to = max(at, to - 4096) + int(gap[-1]) + 1
                    break
                if to >= len(data):
                    to = len(data)
                    break
                to += 4096
        parts.append(_word_hashes(data[at:to]))
        at = to
    w = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if len(w) < WORDS:
        if not len(w):
            return w
        return _mix(np.atleast_1d((w * _POS[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))))
    n = len(w) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for j in range(WORDS):
        s += w[j:j + n] * _POS[j]
    return np.unique(_mix(s + _POS[WORDS]))


def _minwise(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    best = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(best, (s[i:i + 512, None] * mul + add).min(axis=0), out=best)
    return best


def minima(s: np.ndarray) -> np.ndarray:
    """The N_MINIMA minwise values of a set, 32 bits each."""
    return (_minwise(s, _MUL, _ADD) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def wide_sketch(s: np.ndarray) -> np.ndarray:
    """WIDE further minwise values, 8 bits each (unlike values agree by chance in 1 of 256)."""
    return (_mix(_minwise(s, _WIDE_MUL, _WIDE_ADD)) >> np.uint64(56)).astype(np.uint8)


def half_keys(sig: np.ndarray) -> np.ndarray:
    """The 2 * M half keys (a_0.., b_0..) of a signature, 32 bits each."""
    v = sig.view(np.uint32).astype(np.uint64).reshape(2 * M, K)
    h = np.arange(2 * M, dtype=np.uint64)
    for k in range(K):
        h = _mix(h * _POS[k] + v[:, k])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


_SIG_SCHEMA = "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig array<int>"
_SET_SCHEMA = "doc bigint, n bigint, sig array<int>, keys array<int>, items array<bigint>"
_BLOCK_SCHEMA = "h bigint, x int, y int, blk int, i int, doc bigint, comp bigint, n bigint, keys array<int>, wide binary"


def _lists(flat: np.ndarray, sizes: list[int], kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, kind))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, f1, f2, sig = [], [], [], []
        for t in b.column(1):
            s = shingle_set(t.as_py())
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            f1.append((h >> 64) - (1 << 63))
            f2.append((h & ((1 << 64) - 1)) - (1 << 63))
            sig.append(minima(s) if len(s) else np.empty(0, np.int32))
        flat = np.concatenate(sig) if sig else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
             _lists(flat, [len(x) for x in sig], pa.int32())], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 32):
            b = whole.slice(at, 32)
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]     # ids of rows without a set don't get here
            sigs = [minima(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 _lists(np.concatenate(sigs), [len(s) for s in sigs], pa.int32()),
                 _lists(np.concatenate([half_keys(s) for s in sigs]), [2 * M] * len(sigs), pa.int32()),
                 _lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64())],
                ["doc", "n", "sig", "keys", "items"])


def _table_members(reps: DataFrame) -> DataFrame:
    """(tab, doc): the members of every table (i, j) that two documents or more share."""
    key = lambda i: F.xxhash64(i, *[F.get("sig", i * K + k) for k in range(K)])
    half = reps.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * M - 1)), lambda i: F.struct(
        F.floor(i / M).cast("int").alias("side"), key(i).alias("h")))).alias("k")).select("doc", "k.side", "k.h")
    shared = half.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    half = half.join(shared, "h", "left_semi")
    both = half.groupBy("doc").agg(                       # at most M keys a side
        F.collect_list(F.when(F.col("side") == 0, F.col("h"))).alias("a"),
        F.collect_list(F.when(F.col("side") == 1, F.col("h"))).alias("b"))
    both = both.where((F.size("a") > 0) & (F.size("b") > 0))
    tabs = both.select("doc", F.explode("a").alias("x"), "b").select("doc", "x", F.explode("b").alias("y"))
    tabs = materialise(tabs.select(F.xxhash64("x", "y").alias("tab"), "doc"), "mh-tabs")
    many = tabs.groupBy("tab").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tab")
    out = materialise(tabs.join(many, "tab", "left_semi"), "mh-members")
    remove(tabs)
    return out


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct ``pairs(a, b)``, the edges (u, v) whose full sets link."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("items").alias(f"items_{x}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("items_a", "items_b"))
    p = p.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), inter.cast("bigint").alias("i"))
    return p.where(F.col("i") * DEN >= (F.col("n") - F.col("i")) * NUM).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _alike(pairs: DataFrame, sets: DataFrame, n_docs: int) -> DataFrame:
    """Of distinct ``pairs(a, b)``, those with a fitting size ratio and enough equal minima."""
    def side(x: str) -> DataFrame:
        return small(sets.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")), n_docs, BROADCAST_SIGS)

    p = pairs.join(side("a"), "a").join(side("b"), "b")
    equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return p.where((F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM) & (equal >= MIN_EQUAL)).select("a", "b")


def _pairs_in(i: int, left: np.ndarray, right: np.ndarray | None, g: dict[str, np.ndarray]) -> np.ndarray:
    """Index pairs (2 x P) of one block pair that have to be checked on full sets."""
    other = left if right is None else right
    n, m, comp = g["n"][left][:, None], g["n"][other][None, :], g["comp"]
    ok = (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (comp[left][:, None] != comp[other][None, :])
    if right is None:
        ok = np.triu(ok, 1)
    p, q = np.nonzero(ok)
    p, q, keys = left[p], other[q], g["keys"]
    for j in range(i):                        # an earlier common key has the pair already
        new = keys[p, j] != keys[q, j]
        p, q = p[new], q[new]
    out = []
    for at in range(0, len(p), 1 << 16):
        a, b = p[at:at + (1 << 16)], q[at:at + (1 << 16)]
        meet = (keys[a, M:] == keys[b, M:]).any(axis=1)
        a, b = a[meet], b[meet]
        alike = np.concatenate([(g["wide"][a[k:k + 4096]] == g["wide"][b[k:k + 4096]]).sum(axis=1) for k in range(0, len(a), 4096)] or [np.empty(0)]) >= MIN_WIDE
        out.append(np.stack((a[alike], b[alike])))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCK_SCHEMA sorted by (h, x, y) to pairs (a, b); holds one block pair at a time."""
    held: pa.Table | None = None

    def pairs(t: pa.Table, upto_last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        col = lambda c: t.column(c).to_numpy()
        h, x, y = col("h"), col("x"), col("y")
        edge = np.flatnonzero((np.diff(h) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
        bounds = np.concatenate((np.zeros(1, np.int64), edge, np.array([len(h)] if upto_last else [], np.int64)))
        if len(bounds) < 2:
            return None, t
        end = int(bounds[-1])
        part = t.slice(0, end).combine_chunks()
        g = {c: part.column(c).to_numpy() for c in ("n", "comp", "doc", "blk", "i")}
        g["keys"] = pa.concat_arrays(part.column("keys").chunks).flatten().to_numpy().reshape(end, 2 * M)
        g["wide"] = np.frombuffer(b"".join(part.column("wide").to_pylist()), np.uint8).reshape(end, WIDE)
        out = [np.empty((2, 0), np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo < 2:
                continue
            at = np.arange(lo, hi)
            if x[lo] == y[lo]:
                out.append(_pairs_in(int(g["i"][lo]), at, None, g))
            else:
                out.append(_pairs_in(int(g["i"][lo]), at[g["blk"][lo:hi] == x[lo]], at[g["blk"][lo:hi] == y[lo]], g))
        p = np.concatenate(out, axis=1)
        a, b = g["doc"][p[0]], g["doc"][p[1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]), t.slice(end)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= 4 * BLOCK:
            done, held = pairs(held, False)
            if done is not None and done.num_rows:
                yield done
    if held is not None and held.num_rows:
        done, _ = pairs(held, True)
        if done is not None and done.num_rows:
            yield done


_OPEN_SCHEMA = "doc bigint, comp bigint, n bigint, keys array<int>, wide binary"


def _widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = [np.array(s.values.to_numpy(), np.int64).view(np.uint64) for s in b.column("items")]
        wide = pa.array([wide_sketch(s).tobytes() for s in items], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc", "comp", "n", "keys")] + [wide], ["doc", "comp", "n", "keys", "wide"])


def _block_pairs(open_docs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Distinct pairs (a, b) of ``open_docs(doc, comp)`` that share a table and may link."""
    rows = open_docs.join(sets, "doc").select("doc", "comp", "n", "keys", "items").mapInArrow(_widen, _OPEN_SCHEMA)
    rows = materialise(rows, "mh-wide")
    keyed = rows.select("doc", F.posexplode("keys").alias("i", "k")).where(F.col("i") < M)
    keyed = keyed.select("doc", "i", F.xxhash64("i", "k").alias("h"))
    sizes = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    dealt = keyed.join(sizes, "h").withColumn("nb", F.ceil(F.col("c") / block).cast("int"))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64(F.lit(3), "doc"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("z", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("doc", "h", "i", "blk", F.least("blk", "z").alias("x"), F.greatest("blk", "z").alias("y"))
    full = dealt.join(rows, "doc").select("h", "x", "y", "blk", "i", "doc", "comp", "n", "keys", "wide")
    return full.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y").mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_duplicate_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = materialise(texts.mapInArrow(_sketch, _SIG_SCHEMA), "mh-base")
    full = base.where("doc_id is not null and n_shingles > 0")
    reps = materialise(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")), "mh-reps")
    members = _table_members(reps)

    ids = materialise(members.select("doc").distinct(), "mh-ids")
    n_ids = ids.count()
    wanted = texts.join(small(ids, n_ids), F.col("doc_id") == F.col("doc"), "left_semi")
    sets = materialise(wanted.mapInArrow(_sets, _SET_SCHEMA), "mh-sets")

    # rows that repeat a doc_id with other texts tie their classes together
    repeated = materialise(full.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x <> y")
                           .select("doc_id"), "mh-repeated")
    edges = None
    if not repeated.isEmpty():
        tied = full.join(repeated, "doc_id", "left_semi").select("fp1", "fp2", "doc_id")
        edges = reps.join(tied, ["fp1", "fp2"]).select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))

    top = members.groupBy("tab").agg(F.min("doc").alias("a"))
    pairs = members.join(top, "tab").where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    found = _exact(_alike(pairs, sets, n_ids), sets)
    comps = connected_components(found.union(edges) if edges is not None else found)
    n_comps = comps.count()

    # documents of tables that still span several components
    comp_of = small(comps.withColumnRenamed("node", "doc"), n_comps)
    named = members.join(comp_of, "doc", "left").select("tab", "doc", F.coalesce("comp", "doc").alias("comp"))
    spans = named.groupBy("tab").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tab")
    open_docs = materialise(named.join(spans, "tab", "left_semi").select("doc", "comp").distinct(), "mh-open", n_ids)
    pairs = materialise(_block_pairs(open_docs, sets, block), "mh-pairs")
    more = _exact(pairs, sets).union(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    comps = connected_components(more)
    n_comps = comps.count()
    for t in (members, sets, open_docs, pairs):
        remove(t)

    whole = base.join(reps.select("fp1", "fp2", F.col("doc").alias("rep")), ["fp1", "fp2"], "left")
    whole = whole.withColumn("rep", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("rep")))
    whole = whole.join(small(comps.withColumnRenamed("node", "rep"), n_comps), "rep", "left")
    comp = F.coalesce("comp", "rep")
    return whole.select("doc_id", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group, all columns kept.

    Rows without a set or without a doc_id all stay; of rows that repeat a
    kept doc_id, the one with the smallest text stays.
    """
    groups = near_duplicate_groups(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("_mh_id"))
    keep = groups.agg(F.max(F.when(F.col("kept"), F.col("n_shingles"))).alias("_mh_n"), F.count(F.lit(1)).alias("_mh_rows"))
    keep = materialise(keep.where("_mh_n is not null").select("_mh_id", (F.expr("_mh_n > 0 and _mh_rows > 1")).alias("_mh_many")), "mh-keep")
    n_many, n_keep = keep.agg(F.count_if("_mh_many"), F.count(F.lit(1))).first()
    on = docs["doc_id"].cast("bigint") == F.col("_mh_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small(keep.where("not _mh_many"), n_keep - n_many), on).select(*columns)
    one = W.partitionBy("_mh_id").orderBy(F.col("text").asc_nulls_last())
    many = docs.join(small(keep.where("_mh_many"), n_many), on).withColumn("_mh_rn", F.row_number().over(one))
    return out.unionByName(many.where("_mh_rn = 1").select(*columns)).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))
