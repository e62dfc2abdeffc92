"""Ranked lexical search by dense blocked multiplication.

A term is a run of ASCII letters and digits and of characters outside ASCII;
A-Z is lower-cased.  Of N documents with a term, L terms in all, a document of
n terms has m = 50 + (50 * n * N) div L, a term found in df documents weighs
w = floor(1000 * ln((2N + 2) / (2df + 1))), and its impact in a document that
holds it tf times is (10**9 * tf) div (1000 * tf + 20 * m).  A document's score
for an item is the sum of w * impact over the item's distinct terms.

The documents are read once per pass of items (see below).  That leaves, per
document, its length and the terms of the pass's vocabulary it holds; N, L
and df come from these postings.  Scores are then products of dense tiles:
items are taken ITEM_TILE at a time, the terms they have between them become
the columns of a compact vocabulary tile, and a tile of documents x terms
(impacts) times terms x items (weights) gives all scores of DOC_TILE documents
by one matrix multiplication in float64.  Impacts stay below 10**6; a
vocabulary tile is cut where an item's weights times that would reach 2**53,
so every partial sum is a whole number that a double holds, in whatever order
the multiplication adds.  Tiles are added in 64-bit integers.

Of each tile a document stays if its score is not below the item's 50th best
so far; equal scores stay too until they are ordered by doc_id, so ties don't
depend on the tiles.  Each task ends with at most 50 documents an item, and
these are merged in two steps, so that no task sees all of an item.

What a task holds is bounded by PASS_PAIRS: a pass takes items with about that
many (item, term) pairs, more items make more passes.

Defined cases: null texts and texts without terms score nothing and are not
counted; rows without doc_id, or without item_id, take no part; rows that
repeat a doc_id are documents of their own; rows that repeat an item_id are
one item with the terms of all; items without a term found have no rows;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from aerolens.llm.common import materialise, prepare, remove, table

TOP = 50
ITEM_TILE, VOCAB_TILE, DOC_TILE = 64, 2048, 512
PASS_PAIRS = 100_000      # (item, term) pairs of a pass; the last item may go beyond
IMPACT = 10**6            # impacts are below this
EXACT = 1 << 53
MERGE = 64                # groups per item in the first merge

_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _b in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TABLE[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_b] = _b + 32
_TABLE = bytes(_TABLE)


def terms(text: str | None) -> list[bytes]:
    """All terms of a whole text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in dict.fromkeys(terms(text))]
        ids, found = zip(*got) if got else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["item_id", "term"])


_POSTINGS = "doc_id bigint, n bigint, idx array<int>, tf array<bigint>"


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Per document its length and, by index, how often it holds the terms of ``vocabulary``."""
    find = vocabulary.get
    for b in batches:
        n, size, idx, tf = [], [0], [], []
        for text in b.column(1):
            words = terms(text.as_py())
            found = Counter(map(find, words))
            found.pop(None, None)
            n.append(len(words))
            idx += found.keys()
            tf += found.values()
            size.append(len(idx))
        at = pa.array(size, pa.int32())
        out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(idx, pa.int32())),
                                          pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["doc_id", "n", "idx", "tf"])
        yield out.filter(pa.array(np.array(n) > 0))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vocabulary_tiles(items: list[list[int]], weights: np.ndarray, limit: int = EXACT, columns: int = VOCAB_TILE) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(terms, weights[term, item])] of a tile of items: the terms that any of them has, cut so that sums stay exact."""
    found = sorted({t for x in items for t in x if weights[t] > 0})
    at = {t: i for i, t in enumerate(found)}
    full = np.zeros((len(found), len(items)))
    for j, x in enumerate(items):
        for t in x:
            if t in at:
                full[at[t], j] = weights[t]
    out, lo, held = [], 0, np.zeros(len(items))
    for i in range(len(found)):
        if i - lo >= columns or ((held + full[i]) * IMPACT >= limit).any():
            out.append((np.array(found[lo:i]), full[lo:i]))
            lo, held = i, np.zeros(len(items))
        held = held + full[i]
    if lo < len(found):
        out.append((np.array(found[lo:]), full[lo:]))
    return out


class Best:
    """The ``k`` best documents of each item so far, ties by doc_id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.docs = [np.empty(0, np.int64) for _ in range(n_items)]
        self.scores = [np.empty(0, np.int64) for _ in range(n_items)]

    def add(self, first: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores[document, item]`` of the items from ``first`` on."""
        row, col = np.nonzero(scores >= self.floor[first:first + scores.shape[1]])
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        edges = np.flatnonzero(np.diff(col, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            i, at = first + int(col[lo]), row[lo:hi]
            s = np.concatenate((self.scores[i], scores[at, col[lo]]))
            d = np.concatenate((self.docs[i], docs[at]))
            keep = np.lexsort((d, -s))[:self.k]
            self.scores[i], self.docs[i] = s[keep], d[keep]
            if len(keep) == self.k:
                self.floor[i] = s[keep[-1]]


def _rank(batches: Iterator[pa.RecordBatch], ids: list[int], tiles: list[tuple[int, int, list]], n_docs: int, n_terms: int, k: int,
          doc_tile: int) -> Iterator[pa.RecordBatch]:
    """``tiles``: (first item, number of items, vocabulary tiles).  At most ``k`` rows an item and task."""
    best, width = Best(len(ids), k), 1 + max((int(t.max()) for _, _, v in tiles for t, _ in v), default=0)
    column = [[np.full(width, -1, np.int64) for _ in v] for _, _, v in tiles]
    for (_, _, v), maps in zip(tiles, column):
        for (t, _), m in zip(v, maps):
            m[t] = np.arange(len(t))

    for whole in batches:
        for lo in range(0, whole.num_rows, doc_tile):
            b = whole.slice(lo, doc_tile)
            docs = b.column("doc_id").to_numpy()
            m = np.array([50 + 50 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            size = b.column("idx").value_lengths().to_numpy()
            doc, idx = np.repeat(np.arange(len(docs)), size), b.column("idx").flatten().to_numpy()
            tf = b.column("tf").flatten().to_numpy()
            impact = (10**9 * tf) // (1000 * tf + 20 * m[doc])
            known = idx < width
            doc, idx, impact = doc[known], idx[known], impact[known]
            for (first, count, vocabulary), maps in zip(tiles, column):
                scores = np.zeros((len(docs), count), np.int64)
                for (t, weights), at in zip(vocabulary, maps):
                    c = at[idx]
                    hit = c >= 0
                    tile = np.zeros((len(docs), len(t)))
                    tile[doc[hit], c[hit]] = impact[hit]
                    scores += (tile @ weights).astype(np.int64)
                best.add(first, scores, docs)
    size = [len(x) for x in best.docs]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), size)), pa.array(np.concatenate(best.docs)),
                                      pa.array(np.concatenate(best.scores))], ["item_id", "doc_id", "score"])


def _one_pass(texts: DataFrame, pairs: list, k: int, item_tile: int, doc_tile: int) -> DataFrame:
    """(item_id, doc_id, score) of the items in ``pairs``: some best documents of each, the ``k`` best among them."""
    vocabulary: dict[bytes, int] = {}
    items: dict[int, list[int]] = {}
    for r in pairs:
        items.setdefault(r["item_id"], []).append(vocabulary.setdefault(bytes(r["term"]), len(vocabulary)))
    postings = materialise(texts.mapInArrow(partial(_postings, vocabulary=vocabulary), _POSTINGS), "search-postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = postings.select(F.explode("idx").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()   # one row a term of the pass
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df:
        weights[r["t"]] = weight(n_docs, r["df"])
    ids = sorted(items)
    tiles = []
    for lo in range(0, len(ids), item_tile):
        tile = [items[i] for i in ids[lo:lo + item_tile]]
        tiles.append((lo, len(tile), vocabulary_tiles(tile, weights)))
    rank = partial(_rank, ids=ids, tiles=tiles, n_docs=n_docs, n_terms=n_terms or 1, k=k, doc_tile=doc_tile)
    out = materialise(postings.mapInArrow(rank, "item_id bigint, doc_id bigint, score bigint"), "search-best")
    remove(postings)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = TOP, pass_pairs: int = PASS_PAIRS, item_tile: int = ITEM_TILE,
           doc_tile: int = DOC_TILE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).where("doc_id is not null")
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), text).where("item_id is not null")
    pairs = materialise(asked.mapInArrow(_item_terms, "item_id bigint, term binary").distinct(), "search-items")
    passes = max(1, math.ceil(pairs.count() / pass_pairs))
    parts = []
    for p in range(passes):
        got = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect() if passes > 1 else pairs.collect()
        if got:
            parts.append(_one_pass(texts, got, k, item_tile, doc_tile))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    order = [F.desc("score"), F.col("doc_id")]
    some = W.partitionBy("item_id", "g").orderBy(*order)
    found = found.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FOUND = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
with d as materialized (
  select row_number() over () as r, doc_id, {_FOUND} as t from documents where doc_id is not null
), s as (
  select count(*) as n_docs, cast(sum(len(t)) as bigint) as n_terms from d where len(t) > 0
), m as materialized (
  select r, doc_id, 50 + (50 * len(t) * n_docs) // n_terms as m from d, s where len(t) > 0
), i as materialized (
  select distinct item_id, unnest({_FOUND}) as term from benchmark where item_id is not null
), f as materialized (
  select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from i) group by r, term
), w as materialized (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
  from (select term, count(*) as df from f group by term), s
), x as (
  select item_id, r, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from i join w using (term) join f using (term) join m using (r) group by item_id, r
), k as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
  from x join m using (r) where score > 0
)
select item_id, rank, doc_id, score from k where rank <= {TOP}
"""
