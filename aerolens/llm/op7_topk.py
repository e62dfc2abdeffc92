"""Exact top-k search by inner product with columnar branch-and-bound.

Vectors are rounded to integers, floor(256 * x).  Queries and candidates are
dealt to blocks, and a task takes one block of queries and one of candidates.
Candidates lie in vertical layout, one row of memory per dimension; scores
grow by one block of dimensions at a time.  After each block a candidate's
score is known up to the product of the norms that remain (Cauchy-Schwarz):
candidates that can't reach the k-th best lower bound are dropped and the
others moved together.  The k best of each task are merged per query.

Scores are exact: integer values in doubles up to 2**53, whole numbers of any
size beyond that (such blocks are scored without bounds, and scores are held
to the range of a long).

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, nor does a row without vec_id; rows that repeat a vec_id are
one vector (the smallest); shorter vectors count as padded with zeros, so an
empty one scores 0; ties go to the smaller vec_id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from aerolens.llm.common import materialise, prepare, table

TOP = 5
QUERY_EVERY = 50
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
DIMS = 16                 # dimensions per step
EXACT = float(1 << 53)


def top_of_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """(query id, vector id, score) of each query's k best within one block; integer-valued doubles."""
    dim, out = vectors.shape[1], []
    columns = np.ascontiguousarray(vectors.T)                  # vertical layout
    starts = list(range(0, dim, DIMS))
    rest = lambda x: np.sqrt(np.stack([(x[:, s + DIMS:] ** 2).sum(axis=1) for s in starts]) if starts else np.zeros((1, len(x))))
    left_v, left_q = rest(vectors) * (1 + 1e-9), rest(queries) * (1 + 1e-9)
    first = queries[:, :DIMS] @ columns[:DIMS]
    for i in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[i])
        score = first[i, alive]
        for step, s in enumerate(starts):
            if step:
                score = score + queries[i, s:s + DIMS] @ columns[s:s + DIMS, alive]
            if len(alive) > k:
                bound = left_q[step, i] * left_v[step, alive]
                least = np.partition(score - bound, len(alive) - k)[len(alive) - k]
                keep = score + bound >= least
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(int(query_ids[i]), int(ids[alive[j]]), int(score[j])) for j in best]
    return out


def _plain_top(queries: list, query_ids: np.ndarray, vectors: list, ids: np.ndarray, k: int) -> list[tuple]:
    """As top_of_block, for components whose products leave the exact range of doubles."""
    out, top = [], (1 << 63) - 1
    for q, qi in zip(queries, query_ids):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), int(i)) for v, i in zip(vectors, ids) if i != qi)[:k]
        out += [(int(qi), i, max(-top - 1, min(top, -s))) for s, i in scored]
    return out


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (qb, cb, is_query, vec_id, v) sorted by (qb, cb); holds one block pair."""
    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        is_q = t.column("is_query").to_numpy(zero_copy_only=False)
        ids = t.column("vec_id").to_numpy()
        lists = t.column("v").combine_chunks()
        size = np.asarray(pa.compute.list_value_length(lists))
        flat = lists.flatten().to_numpy()
        dim = int(size.max()) if len(size) else 0
        top = float(np.abs(flat.astype(np.float64)).max()) if len(flat) else 0.0
        if top * top * max(1, dim) < EXACT / 4:
            full = np.zeros((len(ids), dim))
            full[np.repeat(np.arange(len(ids)), size), np.concatenate([np.arange(n) for n in size]) if len(flat) else np.empty(0, int)] = flat
            got = top_of_block(full[is_q], ids[is_q], full[~is_q], ids[~is_q], k)
        else:
            v = lists.to_pylist()
            got = _plain_top([x for x, y in zip(v, is_q) if y], ids[is_q], [x for x, y in zip(v, is_q) if not y], ids[~is_q], k)
        cols = list(zip(*got)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    held, key = [], None
    for b in batches:
        pair = np.stack((b.column("qb").to_numpy(), b.column("cb").to_numpy()), axis=1)
        edges = np.concatenate(([0], np.flatnonzero((np.diff(pair, axis=0) != 0).any(axis=1)) + 1, [len(pair)]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            now = tuple(pair[lo])
            if key is not None and now != key:
                yield solve(held)
                held = []
            key = now
            held.append(b.slice(int(lo), int(hi - lo)))
    if held:
        yield solve(held)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the integer vectors that take part, one row per vec_id."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    e = e.where("vec_id is not null and e is not null").where(finite)
    return e.groupBy("vec_id").agg(F.min(F.transform("e", lambda x: F.floor(x * 256).cast("bigint"))).alias("v"))


def top_k(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``."""
    prepare(embeddings.sparkSession)
    v = materialise(vectors_of(embeddings), "top-vectors")
    is_query = F.col("vec_id") % every == 0
    n, nq = v.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, math.ceil(n / candidate_block)), max(1, math.ceil(nq / query_block))
    deal = lambda seed, count: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = v.where(is_query).select(deal(1, query_blocks).alias("qb"), spread(blocks).alias("cb"), F.lit(True).alias("is_query"), "vec_id", "v")
    others = v.select(spread(query_blocks).alias("qb"), deal(2, blocks).alias("cb"), F.lit(False).alias("is_query"), "vec_id", "v")
    dealt = queries.unionByName(others).repartition("qb", "cb").sortWithinPartitions("qb", "cb")
    found = dealt.mapInArrow(lambda it: _search(it, k), "query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
