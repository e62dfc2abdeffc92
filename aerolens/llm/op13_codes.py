"""Vector code compression: product codes, each part assigned by Orchard's search.

Components become integers, floor(4096 * x); vectors are cut into PARTS equal
consecutive parts, each position with a codebook of ENTRIES entries of its
own.  A codebook starts as that part of the vectors of smallest vec_id.  A
round assigns every part to the nearest entry and replaces each entry by the
floor of its parts' mean; all is integer arithmetic, so results don't depend
on how rows are dealt.  A round reads the table once, each task sums per
entry, and only these sums (parts x entries x components) come together.

Orchard's search: every entry has a list of the other entries sorted by their
distance from it.  The search holds a current entry c, goes along c's list
and measures only entries that are not marked visited; an entry that is
nearer becomes the current one and its list is begun.  It ends where the list
passes twice the current distance: by the triangle inequality no entry
further on can be as near as c.  With squared integers that is D(c, e) >
4 D(x, c); at equality the search goes on, so ties go to the lower index.  The
search takes a batch of vectors at a time, one step of all that still go on.

Defined cases: vectors that are null or hold null or non-finite components
are dropped; integers are held to the range of a long and so are error and
label_error; the vectors' length is the longest in the table, shorter ones
(and a length that PARTS doesn't divide) are padded with zeros; rows are the
unit, so rows that repeat a vec_id are coded each, and equal vec_ids start
codebooks in the order of their vectors; rows without vec_id are coded and
come last at the start; with fewer rows than ENTRIES a codebook has as many
entries as rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aerolens.llm.common import arrow_rows, materialise, prepare, small, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: components below this give exact distances of a part in 64 bits
SAFE = 1 << 26
#: rows of vectors handed to a Python worker at once
VECTOR_ROWS = 4096
LONG_MAX = (1 << 63) - 1


def _exact(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` as it is where distances fit in 64 bits, else as Python integers."""
    fits = not x.size or (int(x.max()) < SAFE and int(x.min()) > -SAFE and width < 512)
    return x if fits else x.astype(object)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows (the last axis)."""
    d = a - b
    return (d * d).sum(axis=-1)


def neighbour_lists(codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, distances): each entry's other entries from the nearest on."""
    k = len(codebook)
    order, dist = np.empty((k, k - 1), np.int64), np.empty((k, k - 1), codebook.dtype)
    for c in range(k):
        d = distances(codebook, codebook[c])
        rest = [e for e in sorted(range(k), key=lambda e: (d[e], e)) if e != c]
        order[c], dist[c] = rest, d[rest]
    return order, dist


def orchard(x: np.ndarray, codebook: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance) of each row of ``x``, and how many distances were measured."""
    order, dist = lists or neighbour_lists(codebook)
    n, k = len(x), len(codebook)
    now, best = np.zeros(n, np.int64), distances(x, codebook[0])
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    at, live, measured = np.zeros(n, np.int64), np.arange(n if k > 1 else 0), n
    while len(live):
        c = now[live]
        go = (dist[c, at[live]] <= 4 * best[live]).astype(bool)
        live, c = live[go], c[go]
        e = order[c, at[live]]
        at[live] += 1
        new = ~visited[live, e]
        i, e = live[new], e[new]
        visited[i, e] = True
        d = distances(x[i], codebook[e])
        measured += len(i)
        nearer = ((d < best[i]) | ((d == best[i]) & (e < now[i]))).astype(bool)
        i = i[nearer]
        now[i], best[i], at[i] = e[nearer], d[nearer], 0
        live = live[at[live] < k - 1]
    return now, best, measured


def _assigned(v: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its components, entries, distances) of a batch of integer vectors."""
    width = books.shape[2]
    for p in range(books.shape[0]):
        x, book = _exact(v[:, p * width:(p + 1) * width], width), _exact(books[p], width)
        if x.dtype != book.dtype:
            x, book = x.astype(object), book.astype(object)
        entry, dist, _ = orchard(x, book)
        yield p, x, entry, dist


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    size = np.asarray(pc.list_value_length(column))
    if (size == dim).all():
        return column.flatten().to_numpy().reshape(len(size), dim)
    out = np.zeros((len(size), dim), np.int64)
    at = np.concatenate([np.arange(n) for n in size]) if size.sum() else np.empty(0, np.int64)
    out[np.repeat(np.arange(len(size)), size), at] = column.flatten().to_numpy()
    return out


_SUMS = "part int, entry int, n bigint, sums array<decimal(38,0)>"
_CODES = "vec_id bigint, label string, code string, error bigint"


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per part and entry, the count and the component sums of all the task's rows."""
    parts, k, width = books.shape
    n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
    for b in batches:
        for p, x, entry, _ in _assigned(_matrix(b.column("v"), parts * width), books):
            n[p] += np.bincount(entry, minlength=k)
            if x.dtype != object:               # SAFE * rows of a batch fits in 64 bits
                of_batch = np.zeros((k, width), np.int64)
                np.add.at(of_batch, entry, x)
                total[p] += of_batch
            else:
                np.add.at(total[p], entry, x)
    p, e = np.nonzero(n)
    kind = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()),
         pa.array([[int(s) for s in total[i, j]] for i, j in zip(p, e)], pa.list_(kind))], ["part", "entry", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for b in batches:
        code, error = np.full(b.num_rows, "", object), np.zeros(b.num_rows, object)
        for _, _, entry, dist in _assigned(_matrix(b.column("v"), parts * width), books):
            code += np.array([f"{i:02x}" for i in range(books.shape[1])], object)[entry]
            error += dist
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()),
                                          pa.array([min(int(x), LONG_MAX) for x in error], pa.int64())], ["vec_id", "label", "code", "error"])


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that are kept; ``label`` as text."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    held = lambda x: F.greatest(F.lit(-float(1 << 63)), F.least(F.lit(float(1 << 63)), x * scale))  # noqa: E731  floor() ends at the long's range
    return e.where("e is not null").where(finite).select("vec_id", "label", F.transform("e", lambda x: F.floor(held(x)).cast("bigint")).alias("v"))


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks[part, entry, component]) of all kept rows."""
    spark = embeddings.sparkSession
    prepare(spark)
    v = materialise(integer_vectors(embeddings, scale), "codes-vectors")
    dim = v.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], _CODES), np.zeros((parts, 0, 0), np.int64)
    width = -(-dim // parts)
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        books[i, :len(r["v"])] = r["v"]
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    with arrow_rows(spark, VECTOR_ROWS):
        for _ in range(rounds):
            by_task = v.select("v").mapInArrow(partial(_sums, books=books), _SUMS)
            sums = by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[
                F.sum(F.col("sums")[i]).cast("decimal(38,0)").alias(f"s{i}") for i in range(width)])
            for r in sums.collect():           # parts x entries rows at most
                books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        coded = materialise(v.mapInArrow(partial(_codes, books=books), _CODES), "codes")
    return coded, books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with the integer vector ``v`` that each code stands for."""
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    part = lambda p: F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in books[p]])[entry(p)]
    return coded.withColumn("v", F.concat(*[part(p) for p in range(len(books))]))


def _label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the error of all rows of its label, null labels together."""
    held = lambda c: F.least(c, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint")
    total: Column = F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)")
    by_label = materialise(coded.groupBy("label").agg(held(total).alias("label_error")), "codes-labels").withColumnRenamed("label", "_label")
    return coded.join(small(by_label, by_label.count()), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return _label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    nearest = "arg_min(c.e, (list_sum(list_transform(range(1, len(c.x) + 1), lambda i: (a.x[i] - c.x[i]) * (a.x[i] - c.x[i]))), c.e))"
    steps = []
    for r in range(rounds):
        steps.append(f"""
a{r} as materialized (
  select a.p, a.vec_id, any_value(a.x) as x, {nearest} as e from parts a join c{r} c on a.p = c.p group by a.p, a.vec_id
), s{r} as materialized (
  select p, e, i, sum(x) as s, count(*) as n from (select p, e, unnest(x) as x, unnest(range(1, len(x) + 1)) as i from a{r}) group by p, e, i
), m{r} as (
  select p, e, list((s - ((s % n) + n) % n) // n order by i) as x from s{r} group by p, e
), c{r + 1} as materialized (
  select c.p, c.e, cast(coalesce(m.x, c.x) as bigint[]) as x from c{r} c left join m{r} m on c.p = m.p and c.e = m.e
)""")
    return f"""
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (
  select p, vec_id, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] as x from kept cross join (select unnest(range({PARTS})) as p)
), c0 as materialized (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, x from parts
  where vec_id in (select vec_id from kept order by vec_id limit {ENTRIES})
),{",".join(steps)}, last as (
  select a.p, a.vec_id, {nearest} as e,
    min(list_sum(list_transform(range(1, len(c.x) + 1), lambda i: (a.x[i] - c.x[i]) * (a.x[i] - c.x[i])))) as d
  from parts a join c{rounds} c on a.p = c.p group by a.p, a.vec_id
), coded as materialized (
  select vec_id, string_agg(format('{{:02x}}', e), '' order by p) as code, cast(sum(d) as bigint) as error from last group by vec_id
), flat as (
  select p, e, unnest(x) as x, unnest(range(1, len(x) + 1)) as i from c{rounds}
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by p, e, i)) from flat) as codebooks_sha256
from coded join kept using (vec_id)
"""


ORACLE_SQL = _oracle()
