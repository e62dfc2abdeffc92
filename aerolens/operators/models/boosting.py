"""Histogram gradient boosting for the two-class log loss (M5).

Features are cut into quantile bins once (one aggregate), rows are packed into
blocks of at most BLOCK_ROWS rows of bin numbers, written to the shared
folder.  At the start of a round every block works out its gradients and Hessians.  A tree grows level by level: every block sums gradients and Hessians
per (open node, feature, bin), the sums of all blocks are added on the way to
the driver (``treeReduce``; its size is bounded by nodes x features x bins),
and the best split of each open node follows from running sums over the bins.
So a level is one job whose traffic doesn't depend on the rows.  Of two sister
nodes only the lighter is summed.

Gradients and Hessians are held to 2**-20, so sums are whole numbers: the
trees are the same however the rows are dealt.  Up to LOCAL_ROWS rows the job of
a level takes longer than its sums: such a table is boosted by one task over its
blocks (some 100 bytes a row), which carries the node of each row from level to
level.

Each round takes ``subsample`` of the rows (by a hash of row and round) and
``colsample`` of the features (a seeded permutation).  Margins are carried by
the blocks, kept from round to round and written every RENEW rounds, which cuts
the lineage.

A missing or NaN feature counts as 0.  Without rows of both classes no split
has a gain and all scores are equal.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from aerolens.operators.models.sampling import row_hash
from aerolens.session import checkpoint_dir, ship_package

BLOCK_ROWS = 65_536
LOCAL_ROWS = 1 << 19     # rows that one task boosts
BINS = 64
UPPER = 5                # levels of a tree that are asked as a whole
RENEW = 10
RANKS = 10_000           # values that stand for a column of SUMMED rows
SUMMED = 1 << 18
_ONE = 1 << 20
TREE_SCHEMA = "tree_id int, feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>"
_BLOCK = "x binary, y binary, h binary, margin binary"
_ROUND = _BLOCK + ", gh binary"       # x a feature at a time; gradients and Hessians of the round


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 8
    rate: float = 0.05
    subsample: float = 0.9
    colsample: float = 0.9
    positive_weight: float = 1.0
    l2: float = 1.0
    min_hessian: float = 1.0
    bins: int = BINS
    seed: int = 42


class Tree:
    """Nodes in the order of their making; ``cut`` is a bin, rows of bins up to it go left."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        return at, at + 1

    def nodes_of(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = np.where(x[rows[inner], f[inner]] <= cut[at], left[at], right[at])

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The same for (feature, row) bins, a feature at a time; the right child follows the left."""
        return Nodes(*(np.array(c, np.int64) for c in (self.feature, self.cut, self.left)), bins.dtype).ends(bins)


class Nodes:
    """A tree as arrays; the right child follows the left."""

    def __init__(self, feature, cut, left, kind):
        self.leaf = feature < 0
        most = np.iinfo(kind).max
        self.feature = np.where(self.leaf, 0, feature)
        self.cut = np.where(self.leaf, most, np.minimum(cut, most)).astype(kind)
        self.left = np.where(self.leaf, np.arange(len(feature)), left)     # a leaf leads to itself
        # the upper levels as a heap, in which a leaf is its own left child
        self.heap, inner = [np.zeros(1, np.int64)], not self.leaf[0]
        while inner and len(self.heap) <= UPPER:
            at = self.heap[-1]
            self.heap.append(np.stack([self.left[at], np.where(self.leaf[at], at, self.left[at] + 1)], axis=1).ravel())
            inner = not self.leaf[self.heap[-1]].all()

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of (feature, row) bins ends in.

        In the upper levels every node is asked about every row, and of the
        answers those on the row's way are picked by bits, which takes less than to
        look nodes up row by row.
        """
        n = bins.shape[1]
        turns: list[np.ndarray] = []
        at = np.zeros(n, np.uint8)
        for nodes in self.heap[:-1]:
            asked = bins[self.feature[nodes]] > self.cut[nodes, None]
            for turn in reversed(turns):
                left, right = asked[::2], asked[1::2]
                asked = left ^ ((left ^ right) & turn)
            turns.append(asked[0])
            at = at + at + asked[0]
        node = self.heap[-1].take(at)
        rows, out, flat = np.arange(n), node, bins.ravel()
        first = self.feature * n
        while True:
            live = np.flatnonzero(~self.leaf.take(node))
            if not len(live):
                if len(rows) < n:
                    out[rows] = node
                return out
            if len(live) < len(node):
                if len(rows) < n:
                    out[rows] = node
                rows, node = rows[live], node[live]
            for _ in range(2):
                at = first.take(node)
                at += rows
                node = self.left.take(node) + (flat.take(at) > self.cut.take(node))
            if len(rows) == n:
                out = node


class Walk:
    """Trees (feature, threshold, left, value) over bins of their own thresholds, which are few a feature."""

    def __init__(self, trees: list[tuple]):
        features = max([int(np.max(t[0], initial=-1)) for t in trees], default=-1) + 1
        of = lambda f: [t[1][t[0] == f] for t in trees]
        self.cuts = [np.unique(np.concatenate(of(f))) for f in range(features)]
        self.kind = np.uint8 if max(map(len, self.cuts), default=0) < 255 else np.uint32
        self.trees = []
        for feature, threshold, left, value in trees:
            feature = np.asarray(feature, np.int64)
            cut = np.zeros(len(feature), np.int64)
            for f in range(features):
                cut[feature == f] = np.searchsorted(self.cuts[f], threshold[feature == f])
            self.trees.append((Nodes(feature, cut, np.asarray(left, np.int64), self.kind), np.asarray(value, float)))

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' values for each row."""
        bins = np.array([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)] or [np.zeros(len(x))]).astype(self.kind)
        out = np.zeros(len(x))
        for nodes, value in self.trees:
            out += value.take(nodes.ends(bins))
        return out


class Block:
    """Rows as arrays: bins, label, hash, margin."""

    def __init__(self, row, n_features: int):
        self.y = np.frombuffer(row[1], np.uint8)
        self.x = np.frombuffer(row[0], np.uint8).reshape(len(self.y), n_features)
        self.h = np.frombuffer(row[2], np.uint64)
        self.margin = np.frombuffer(row[3], np.float64).copy()

    def row(self) -> tuple:
        return tuple(bytearray(a.tobytes()) for a in (self.x, self.y, self.h, self.margin))


def uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """[0, 1) by a hash of ``h`` and the seed."""
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _sampled(h: np.ndarray, share: float, seed: int) -> np.ndarray:
    return np.ones(len(h), bool) if share >= 1 else uniform(h, seed) < share


def _gradients(margin: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians in 2**-20."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, s.positive_weight, 1.0)
    return np.round((p - y) * w * _ONE), np.round(p * (1 - p) * w * _ONE)


def _histogram(at: np.ndarray, bins_of: Iterable[np.ndarray], gh: tuple[np.ndarray, np.ndarray], shape: tuple[int, int, int]) -> np.ndarray:
    """(node, column, bin, gradient or Hessian) sums of rows of the nodes ``at``, ``bins_of`` column by column."""
    nodes, columns, bins = shape
    out, base = np.empty((nodes, columns, bins, 2), np.int64), at * bins
    for j, x in enumerate(bins_of):
        key = base + x
        for k, v in enumerate(gh):                    # whole numbers below 2**53: exact in doubles
            out[:, j, :, k] = np.bincount(key, v, nodes * bins).reshape(-1, bins)
    return out


def sums(block: Block, tree: Tree, open_nodes: list[int], columns: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """(open node, column, bin, gradient or Hessian) sums of a block's sampled rows, in 2**-20."""
    return _sums(np.ascontiguousarray(block.x.T), _drawn(block.h, block.margin, block.y, number, s), tree, open_nodes, columns, s)


def _drawn(h: np.ndarray, margin: np.ndarray, y: np.ndarray, number: int, s: Settings) -> np.ndarray:
    """(gradient or Hessian, row) of a round; rows that aren't sampled have none."""
    return np.where(_sampled(h, s.subsample, s.seed * 1_000_003 + number), np.array(_gradients(margin, y, s)), 0.0)


def _sums(x: np.ndarray, gh: np.ndarray, tree: Tree, open_nodes: list[int], columns: np.ndarray, s: Settings) -> np.ndarray:
    shape = (len(open_nodes), len(columns), s.bins)
    if open_nodes == [0]:
        return _histogram(np.zeros(x.shape[1], np.int64), (x[c] for c in columns), tuple(v.astype(float) for v in gh), shape)
    slot = np.full(len(tree.feature), -1)
    slot[open_nodes] = np.arange(len(open_nodes))
    at = slot.take(tree.ends(x))
    rows = np.flatnonzero(at >= 0)
    return _histogram(at.take(rows), (x[c].take(rows) for c in columns), tuple(v.take(rows).astype(float) for v in gh), shape)


class Rows:
    """All rows of a table that one task boosts; ``node`` is where each has come to in the tree of the round."""

    def __init__(self, blocks: list[Block]):
        self.x = np.ascontiguousarray(np.concatenate([b.x for b in blocks]).T)     # a feature at a time
        self.y, self.h, self.margin = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("y", "h", "margin"))

    def start(self, number: int, s: Settings) -> None:
        drawn = _sampled(self.h, s.subsample, s.seed * 1_000_003 + number)
        self.gh = tuple(np.where(drawn, v, 0.0) for v in _gradients(self.margin, self.y, s))     # no part in the sums
        self.node = np.zeros(len(self.y), np.int64)

    def go_down(self, tree: Tree) -> None:
        feature, cut, left = (np.array(c) for c in (tree.feature, tree.cut, tree.left))
        inner = np.flatnonzero(feature[self.node] >= 0)
        while len(inner):
            at = self.node[inner]
            to = left[at] + (self.x.ravel().take(feature[at] * len(self.y) + inner) > cut[at])     # the right child follows the left
            self.node[inner] = to
            inner = inner[feature[to] >= 0]

    def sums(self, tree: Tree, open_nodes: list[int], columns: np.ndarray, s: Settings) -> np.ndarray:
        self.go_down(tree)
        slot = np.full(len(tree.feature), -1)
        slot[open_nodes] = np.arange(len(open_nodes))
        at, shape = slot[self.node], (len(open_nodes), len(columns), s.bins)
        rows = np.flatnonzero(at >= 0)
        if len(rows) == len(at):
            return _histogram(at, (self.x[c] for c in columns), self.gh, shape)
        return _histogram(at[rows], (self.x[c].take(rows) for c in columns), tuple(v[rows] for v in self.gh), shape)

    def finish(self, tree: Tree) -> None:
        self.go_down(tree)
        self.margin += np.array(tree.value)[self.node]


def best_splits(nodes: np.ndarray, s: Settings):
    """(gain, column, bin, left sums, all sums) of each node's (column, bin, 2) sums; ties to the first column and bin."""
    run = np.cumsum(nodes, axis=2)[:, :, :-1]
    total = nodes[:, 0].sum(axis=1)
    gl, hl = run[..., 0] / _ONE, run[..., 1] / _ONE
    g, h = total[:, 0, None, None] / _ONE, total[:, 1, None, None] / _ONE
    score = lambda a, b: a * a / (b + s.l2)
    fits = (hl >= s.min_hessian) & (h - hl >= s.min_hessian)
    gain = np.where(fits, score(gl, hl) + score(g - gl, h - hl) - score(g, h), -np.inf).reshape(len(nodes), -1)
    at, every = np.argmax(gain, axis=1), np.arange(len(nodes))
    j, b = np.divmod(at, run.shape[2])
    return gain[every, at], j, b, run[every, j, b], total


def grow(exchange, n_features: int, number: int, s: Settings) -> Tree:
    """One tree; ``exchange(tree, nodes, columns)`` gives the sums of all rows in these nodes.

    Of two children only the lighter is summed; the other has the rest of its
    parent's sums, exactly, as they are whole numbers.
    """
    take = max(1, math.ceil(s.colsample * n_features))
    columns = np.sort(np.random.default_rng([s.seed, number]).permutation(n_features)[:take])
    tree, pairs = Tree(), []                           # (children, their totals, the parent's sums)
    value = lambda t: -s.rate * (t[0] / _ONE) / (t[1] / _ONE + s.l2)
    may_split = lambda t: t[1] / _ONE >= 2 * s.min_hessian
    for depth in range(s.depth):
        if depth == 0:
            live = {0: exchange(tree, [0], columns)[0]}
            tree.value[0] = value(live[0][0].sum(axis=0))
        else:
            light = [int(totals[1][1] < totals[0][1]) for _, totals, _ in pairs]
            asked = [children[k] for (children, _, _), k in zip(pairs, light)]
            live = {}
            for (children, totals, whole), k, one in zip(pairs, light, exchange(tree, asked, columns) if asked else ()):
                for child, t, node in ((children[k], totals[k], one), (children[1 - k], totals[1 - k], whole - one)):
                    if may_split(t):
                        live[child] = node
        if not live:
            break
        pairs = []
        order = sorted(live)
        for node, gain, j, b, left, total in zip(order, *best_splits(np.stack([live[k] for k in order]), s)):
            if gain > 1e-6:
                children, totals = tree.split(node, int(columns[j]), int(b)), (left, total - left)
                for child, t in zip(children, totals):
                    tree.value[child] = value(t)
                if any(may_split(t) for t in totals):
                    pairs.append((children, totals, live[node]))
    return tree


def _packed(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (h, y, features...) to blocks."""
    def block(t: pa.Table) -> pa.RecordBatch:
        x = np.empty((t.num_rows, len(cuts)), np.uint8)
        for j, c in enumerate(cuts):
            x[:, j] = np.searchsorted(c, np.nan_to_num(t.column(j + 2).to_numpy(), posinf=np.inf, neginf=-np.inf))
        y = t.column("y").to_numpy().astype(np.uint8)
        row = [x.tobytes(), y.tobytes(), t.column("h").to_numpy().tobytes(), np.zeros(len(y)).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], ["x", "y", "h", "margin"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while sum(r.num_rows for r in held) >= BLOCK_ROWS:
            t = pa.Table.from_batches(held)
            yield block(t.slice(0, BLOCK_ROWS))
            held = t.slice(BLOCK_ROWS).to_batches()
    if sum(r.num_rows for r in held):
        yield block(pa.Table.from_batches(held))


def _columns(df: DataFrame, cols: list[str]) -> list[Column]:
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in cols]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every SUMMED rows and column, at most RANKS values in order, each with the rows that it stands for (itself the last)."""
    def summary(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, out = pa.Table.from_batches(held), []
        m = t.num_rows
        last = np.arange(1, min(m, RANKS) + 1) * m // min(m, RANKS) - 1
        many = np.diff(last, prepend=-1).tobytes()
        for f in range(t.num_columns):
            out.append((f, np.sort(t.column(f).to_numpy())[last].tobytes(), many))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["f", "v", "n"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(r.num_rows for r in held) >= SUMMED:
            yield summary(held)
            held = []
    if sum(r.num_rows for r in held):
        yield summary(held)


def quantile_cuts(df: DataFrame, cols: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 cut points a feature, of its quantiles: exact up to RANKS rows a task, else off by a rank of rows / RANKS at most."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = np.frombuffer(b"".join(pdf["v"])), np.frombuffer(b"".join(pdf["n"]), np.int64)
        order = np.argsort(v, kind="stable")
        run = np.cumsum(n[order])
        at = np.searchsorted(run * bins, np.arange(1, bins) * run[-1])      # the first value that so many rows don't exceed
        return pd.DataFrame({"f": pdf["f"].iloc[:1], "cuts": [np.unique(v[order][at])]})

    ship_package(df.sparkSession)
    found = df.select(_columns(df, cols)).mapInArrow(_summaries, "f int, v binary, n binary").groupBy("f").applyInPandas(cut, "f int, cuts array<double>")
    got = {r["f"]: np.array(r["cuts"], float) for r in found.collect()}      # features x bins values
    return [got.get(f, np.zeros(1)) for f in range(len(cols))]


def _begun(blocks: Iterable, n_features: int) -> Iterator[tuple]:
    """Blocks with their bins a feature at a time."""
    for r in blocks:
        x = np.frombuffer(r[0], np.uint8).reshape(-1, n_features)
        yield bytearray(np.ascontiguousarray(x.T).tobytes()), *r[1:4], bytearray()


def _gh_kind(s: Settings):
    return np.int32 if s.positive_weight < 1000 else np.int64


def _renewed(blocks: Iterable, tree: Tree | None, number: int, n_features: int, s: Settings) -> Iterator[tuple]:
    """Blocks with the margins of the tree before and the gradients of this round."""
    for x, y, h, margin, _ in blocks:
        m = np.frombuffer(margin, np.float64)
        if tree is not None:
            m = m + np.array(tree.value).take(tree.ends(np.frombuffer(x, np.uint8).reshape(n_features, -1)))
        gh = _drawn(np.frombuffer(h, np.uint64), m, np.frombuffer(y, np.uint8), number, s)
        yield x, y, h, bytearray(m.tobytes()), bytearray(gh.astype(_gh_kind(s)).tobytes())


def _level(blocks: Iterable, tree: Tree, nodes: list[int], columns: np.ndarray, n_features: int, s: Settings) -> Iterator[np.ndarray]:
    total = None
    for x, _, _, _, gh in blocks:
        one = _sums(np.frombuffer(x, np.uint8).reshape(n_features, -1), np.frombuffer(gh, _gh_kind(s)).reshape(2, -1), tree, nodes, columns, s)
        total = one if total is None else total + one
    if total is not None:
        yield total


def _boost_rows(batches: Iterator[pa.RecordBatch], n_features: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """All rounds over the blocks of a small table."""
    blocks = [Block(row, n_features) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])]
    if not blocks:
        return
    rows = Rows(blocks)
    del blocks
    for number in range(s.rounds):
        rows.start(number, s)
        tree = grow(lambda t, live, columns: rows.sums(t, live, columns, s), n_features, number, s)
        rows.finish(tree)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())] + [
            pa.array([v], pa.list_(kind)) for v, kind in ((tree.feature, pa.int32()), (tree.cut, pa.int32()), (tree.left, pa.int32()),
                                                          (tree.right, pa.int32()), (tree.value, pa.float64()))],
            ["number", "feature", "cut", "left", "right", "value"])


def _boost_blocks(spark: SparkSession, blocks: DataFrame, n_features: int, s: Settings, path: str) -> list[Tree]:
    """Rounds whose levels are jobs over all blocks; a tree's margins are added once, by the first job of the next."""
    trees: list[Tree] = []
    parts = spark.sparkContext.defaultParallelism
    moved, before = blocks.repartition(parts).rdd.map(tuple).mapPartitions(partial(_begun, n_features=n_features)), None
    for number in range(s.rounds):
        moved = moved.mapPartitions(partial(_renewed, tree=trees[-1] if trees else None, number=number, n_features=n_features, s=s))
        if number % RENEW == 0 and number:
            folder = f"{path}/margins-{number}"
            spark.createDataFrame(moved, _ROUND).write.parquet(folder)
            moved = spark.read.schema(_ROUND).parquet(folder).repartition(parts).rdd.map(tuple)
        rdd = moved = moved.persist(StorageLevel.MEMORY_AND_DISK)

        def exchange(tree: Tree, nodes: list[int], columns: np.ndarray) -> np.ndarray:
            one = partial(_level, tree=tree, nodes=nodes, columns=columns, n_features=n_features, s=s)
            return rdd.mapPartitions(one).treeReduce(np.add, 2 if parts > 64 else 1)

        trees.append(grow(exchange, n_features, number, s))
        if before is not None:
            before.unpersist()
        before = rdd
    rdd.unpersist()
    return trees


def write_blocks(df: DataFrame, cols: list[str], cuts: list[np.ndarray], seed: int, n_rows: int, path: str) -> DataFrame:
    """The table of blocks of ``df(label, *cols)``, written to a folder."""
    rows = df.select(row_hash(df, seed).alias("h"), F.col("label").cast("int").alias("y"), *_columns(df, cols))
    rows = rows.coalesce(n_rows // BLOCK_ROWS + 1)
    rows.mapInArrow(partial(_packed, cuts=cuts), _BLOCK).write.parquet(f"{path}/blocks")
    return df.sparkSession.read.schema(_BLOCK).parquet(f"{path}/blocks")


def fit_boosting(df: DataFrame, cols: list[str], s: Settings) -> list[tuple]:
    """Trees (feature, threshold, left, right, value arrays) fitted on ``df(label, *cols)``."""
    spark = df.sparkSession
    ship_package(spark)
    cols = list(cols)
    cuts = quantile_cuts(df, cols, s.bins)
    path = f"{checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex[:12]}"
    n = df.count()
    blocks = write_blocks(df, cols, cuts, s.seed, n, path)
    if n > LOCAL_ROWS:
        trees = _boost_blocks(spark, blocks, len(cols), s, path)
    else:
        schema = "number int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"
        trees = []
        for r in sorted(blocks.coalesce(1).mapInArrow(partial(_boost_rows, n_features=len(cols), s=s), schema).collect(), key=lambda r: r["number"]):   # one row a tree
            t = Tree()
            t.feature, t.cut, t.left, t.right, t.value = (list(r[c]) for c in ("feature", "cut", "left", "right", "value"))
            trees.append(t)
    ends = [np.append(c, np.inf) for c in cuts]       # a cut at the last bin leaves nothing on the right
    out = []
    for t in trees:
        at = [float(ends[f][min(b, len(ends[f]) - 1)]) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut)]
        out.append((np.array(t.feature), np.array(at), np.array(t.left), np.array(t.right), np.array(t.value)))
    return out


def margins(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    return Walk([(t[0], t[1], t[2], t[4]) for t in trees]).total(x)


def score_column(spark: SparkSession, trees: list[tuple], cols: list[str]) -> Column:
    """P(label = 1)."""
    ship_package(spark)
    bc = spark.sparkContext.broadcast(Walk([(t[0], t[1], t[2], t[4]) for t in trees]))          # rounds x nodes of a tree

    @F.pandas_udf(T.DoubleType())
    def boosting_score(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), posinf=np.inf, neginf=-np.inf)
        return pd.Series(1.0 / (1.0 + np.exp(-bc.value.total(x))))

    return boosting_score(*[F.col(c).cast("double") for c in cols])
