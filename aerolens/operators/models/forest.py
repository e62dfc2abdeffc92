"""Random forest of Gini trees on bootstrap samples (M4).

Features are cut into quantile bins and rows packed into blocks, as for the
boosted trees.  A row is drawn Poisson(1) times for each tree, by a hash of the
row and the tree, and a node tries ``columns`` features, by a hash of the tree
and the node's path.  Nodes of more than LOCAL_ROWS draws are split by jobs over
all blocks: every block counts its draws per (node, feature, bin, class), and
the counts are added on the way to the driver (nodes x features x bins).  The
draws of a smaller node go to one task, which grows the rest of its subtree; so
a deep level, whose nodes are many and small, moves no counts at all.  Trees are
grown PAIRS draws at a time, which bounds what a pass shuffles.

Counts are whole numbers, so the trees are the same however the rows are dealt.
A missing or NaN feature counts as 0.  Score = mean over the trees of the
weighted share of label 1 in the row's leaf.
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

from aerolens.operators.models import boosting
from aerolens.session import checkpoint_dir, ship_package, shuffles_let_go

LOCAL_ROWS = 1 << 20     # draws of a node that one task finishes, some 100 bytes each
MANY = 4096              # rows of a node that is counted by itself
PAIRS = 1 << 28          # rows x trees of a pass
BINS = 32
TREE_SCHEMA = "tree_id int, feature binary, threshold binary, left binary, value binary"
_KINDS = (np.int16, np.float64, np.int32, np.float64)
_DRAWS = "tree int, node int, x binary, y binary, w binary"
_SUBTREE = "tree int, node int, feature binary, cut binary, left binary, value binary"
_SHARES = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])     # of Poisson(1)


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    depth: int = 16
    min_leaf: int = 20
    weights: tuple[float, float] = (1.0, 1.0)
    max_features: str = "sqrt"
    bins: int = BINS
    seed: int = 42


def columns_a_node(how, n_features: int, trees: int) -> int:
    """How many features a node tries: auto, all, sqrt, log2, onethird, a number or a share."""
    how = str(how)
    if how == "auto":
        how = "all" if trees == 1 else "sqrt"
    named = {"all": n_features, "sqrt": math.sqrt(n_features), "log2": math.log2(n_features), "onethird": n_features / 3}
    if how not in named:
        named[how] = int(how) if how.isdigit() else float(how) * n_features
    return min(n_features, max(1, math.ceil(named[how])))


def _draws(h: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often each row is drawn for a tree; a single tree takes every row once."""
    if s.trees == 1:
        return np.ones(len(h), np.uint8)
    return np.searchsorted(_SHARES, boosting.uniform(h, s.seed * 1_000_003 + tree), side="right").astype(np.uint8)


def _columns_of(tree: int, paths: np.ndarray, n_features: int, s: Settings) -> np.ndarray:
    """(nodes, columns) features that the nodes try, ascending."""
    take = columns_a_node(s.max_features, n_features, s.trees)
    node = paths.astype(np.uint64)[:, None] * np.uint64(1 << 8) + np.arange(n_features, dtype=np.uint64)
    order = np.argsort(boosting.uniform(node, -1 - s.seed * 1_000_003 - tree), axis=1, kind="stable")
    return np.sort(order[:, :take], axis=1)


def coded(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """(feature, row) bins and labels in one number, 2 bin + label, a feature at a time."""
    kind = np.uint8 if bins <= 128 else np.uint16
    return np.ascontiguousarray(x.T).astype(kind) * kind(2) + y.astype(kind)


def counts(xy: np.ndarray, w: np.ndarray, rows: np.ndarray, starts: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    """(node, column, bin, class) draws of ``rows``, node after node from ``starts`` on; ``w`` are the draws of each of ``rows``."""
    m, take = columns.shape
    out, n = np.empty((m, take, 2 * bins), np.int64), xy.shape[1]
    sizes = np.diff(starts)
    large = sizes >= MANY
    for i in np.flatnonzero(large):
        mine = slice(starts[i], starts[i + 1])
        at, weight = rows[mine], w[mine]
        for j, f in enumerate(columns[i]):
            out[i, j] = np.bincount(xy[f].take(at), weight, 2 * bins)
    small = np.flatnonzero(~large)
    if len(small):
        if len(small) < m:
            mine = np.repeat(~large, sizes)
            rows, w = rows[mine], w[mine]
        sizes = sizes[small]
        base, flat = np.repeat(np.arange(len(small)) * (2 * bins), sizes), xy.ravel()
        for j in range(take):
            at = np.repeat(columns[small, j] * n, sizes)
            at += rows
            key = flat.take(at).astype(np.int64)
            key += base
            out[small, j] = np.bincount(key, w, len(small) * 2 * bins).reshape(len(small), -1)
    return out.reshape(m, take, bins, 2)


def by_node(slot: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts) that put rows node after node, in their own order within a node."""
    return np.argsort(slot.astype(np.uint16) if m <= 1 << 16 else slot, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(slot, minlength=m))])


def best_splits(found: np.ndarray, s: Settings):
    """(splits, column, bin, left counts, all counts) of each node; ties to the first column and bin."""
    run = np.cumsum(found, axis=2)[:, :, :-1]
    total = found[:, 0].sum(axis=1)
    rest = total[:, None, None] - run

    def purity(c):                                     # sum of squares over the sum: weight x (1 - Gini)
        a, b = c[..., 0] * s.weights[0], c[..., 1] * s.weights[1]
        return (a * a + b * b) / np.maximum(a + b, 1e-300), a + b

    (left, _), (right, _), (whole, size) = purity(run), purity(rest), purity(total)
    fits = (run.sum(axis=-1) >= s.min_leaf) & (rest.sum(axis=-1) >= s.min_leaf)
    gain = np.where(fits, left + right - whole[:, None, None], -np.inf).reshape(len(found), -1)
    at = np.argmax(gain, axis=1)
    j, b = np.divmod(at, run.shape[2])
    nodes = np.arange(len(found))
    return gain[nodes, at] > 1e-10 * size, j, b, run[nodes, j, b], total


def _value(c: np.ndarray, s: Settings) -> np.ndarray:
    a, b = c[..., 0] * s.weights[0], c[..., 1] * s.weights[1]
    return b / np.maximum(a + b, 1e-300)


def _opens(c: np.ndarray, s: Settings) -> np.ndarray:
    """Whether nodes of these counts may be split at all."""
    return (c.sum(axis=-1) >= 2 * s.min_leaf) & (c.min(axis=-1) > 0)


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, depth: int, s: Settings):
    """(feature, cut, left, value) of the nodes below a node; its children are ``left`` and ``left`` + 1."""
    room = 2 * (int(w.sum()) // max(1, s.min_leaf)) + 3
    feature, cut, left, value = np.full(room, -1, np.int16), np.zeros(room, np.uint8), np.zeros(room, np.int32), np.zeros(room)
    size, ids, paths = 1, np.zeros(1, np.int64), np.array([path], np.int64)
    xy, n = coded(x, y, s.bins), len(y)
    rows, draws, starts = np.arange(n), w.astype(float), np.array([0, n])
    flat = xy.ravel()
    value[0] = _value(np.bincount(y, w, 2)[:2], s)
    for _ in range(depth, s.depth):
        if not len(ids):
            break
        columns = _columns_of(tree, paths, x.shape[1], s)
        split, j, b, low, total = best_splits(counts(xy, draws, rows, starts, columns, s.bins), s)
        f = columns[np.arange(len(ids)), j]
        made = np.flatnonzero(split)
        first = size + 2 * np.arange(len(made))
        feature[ids[made]], cut[ids[made]], left[ids[made]] = f[made], b[made], first
        child = np.stack([low[made], total[made] - low[made]], axis=1).reshape(-1, 2)
        value[size:size + len(child)] = _value(child, s)
        opens = _opens(child, s)
        number = np.where(opens, np.cumsum(opens) - 1, -1)         # slots of the next level
        to = np.full((len(ids), 2), -1)
        to[made] = number.reshape(-1, 2)
        sizes = np.diff(starts)
        go = flat.take(np.repeat(f * n, sizes) + rows) > np.repeat(2 * b + 1, sizes)
        slot = to.ravel().take(np.repeat(2 * np.arange(len(ids)), sizes) + go)
        kept = np.flatnonzero(slot >= 0)
        order, starts = by_node(slot[kept], int(opens.sum()))
        kept = kept[order]
        rows, draws = rows[kept], draws[kept]
        ids = (size + np.arange(len(child)))[opens]
        paths = (2 * paths[made][:, None] + np.arange(2)).reshape(-1)[opens]
        size += len(child)
    return feature[:size], cut[:size], left[:size], value[:size]


class _Top:
    """The part of a tree above the nodes that tasks finish; ``wide`` are split by jobs, ``small`` by tasks: node -> (path, depth)."""

    def __init__(self, n_rows: int, s: Settings):
        self.tree, root = boosting.Tree(), {0: (1, 0)}
        self.wide, self.small = (root, {}) if n_rows > LOCAL_ROWS else ({}, root)

    def split(self, found: np.ndarray, columns: np.ndarray, s: Settings) -> None:
        todo, self.wide = self.wide, {}
        split, j, b, low, total = best_splits(found, s)
        for i, (node, (path, depth)) in enumerate(todo.items()):
            self.tree.value[node] = float(_value(total[i], s))
            if not split[i]:
                continue
            for k, (child, c) in enumerate(zip(self.tree.split(node, int(columns[i, j[i]]), int(b[i])), (low[i], total[i] - low[i]))):
                self.tree.value[child] = float(_value(c, s))
                if depth + 1 < s.depth and _opens(c, s):
                    (self.wide if c.sum() > LOCAL_ROWS else self.small)[child] = (2 * path + k, depth + 1)


def _blocks(rows: Iterable, n_features: int) -> Iterator[boosting.Block]:
    for r in rows:
        yield boosting.Block(r, n_features)


def _level(rows: Iterable, tops: dict[int, _Top], n_features: int, s: Settings) -> Iterator[dict[int, np.ndarray]]:
    """Counts of the wide nodes of each tree."""
    total = {}
    for block in _blocks(rows, n_features):
        xy = coded(block.x, block.y, s.bins)
        bins = xy >> 1
        for t, top in tops.items():
            w = _draws(block.h, t, s)
            slots = np.full(len(top.tree.feature), -1)
            slots[list(top.wide)] = np.arange(len(top.wide))
            slot = slots[top.tree.ends(bins)]
            mine = np.flatnonzero((slot >= 0) & (w > 0))
            order, starts = by_node(slot[mine], len(top.wide))
            mine = mine[order]
            columns = _columns_of(t, np.array([p for p, _ in top.wide.values()]), n_features, s)
            one = counts(xy, w[mine].astype(float), mine, starts, columns, s.bins)
            total[t] = total[t] + one if t in total else one
    if total:
        yield total


def _added(a: dict, b: dict) -> dict:
    return {t: a[t] + b[t] for t in a}


def _dealt(batches: Iterator[pa.RecordBatch], tops: dict[int, _Top], n_features: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """The draws of each small node, a row per block and node."""
    for batch in batches:
        for block in _blocks(zip(*[c.to_pylist() for c in batch.columns]), n_features):
            bins = np.ascontiguousarray(block.x.T)
            for t, top in tops.items():
                w = _draws(block.h, t, s)
                node = top.tree.ends(bins)
                order = by_node(node, len(top.tree.feature))[0]
                order = order[w[order] > 0]
                nodes, starts = np.unique(node[order], return_index=True)
                out = [(t, int(k), block.x[p].tobytes(), block.y[p].tobytes(), w[p].tobytes())
                       for k, p in zip(nodes, np.split(order, starts[1:])) if int(k) in top.small]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(
                        zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["tree", "node", "x", "y", "w"])


def _pass(blocks: DataFrame, numbers: list[int], n_rows: int, n_features: int, s: Settings) -> list[tuple]:
    """The trees of these numbers."""
    tops = {t: _Top(n_rows, s) for t in numbers}
    if n_rows > LOCAL_ROWS:
        rdd = blocks.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        while wide := {t: top for t, top in tops.items() if top.wide}:
            found = rdd.mapPartitions(partial(_level, tops=wide, n_features=n_features, s=s)).treeReduce(_added, 2)
            for t, top in wide.items():
                top.split(found[t], _columns_of(t, np.array([p for p, _ in top.wide.values()]), n_features, s), s)
        rdd.unpersist()
    where = {(t, node): at for t, top in tops.items() for node, at in top.small.items()}
    below = {}
    if where:
        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            x, y, w = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("x", "y", "w"))
            got = subtree(x.reshape(len(y), n_features), y, w, t, *where[t, node], s)
            return pd.DataFrame([(t, node, *(c.tobytes() for c in got))], columns=["tree", "node", "feature", "cut", "left", "value"])

        spark = blocks.sparkSession
        parts = min(len(where), 8 * spark.sparkContext.defaultParallelism)
        dealt = blocks.mapInArrow(partial(_dealt, tops=tops, n_features=n_features, s=s), _DRAWS)
        grown = dealt.repartition(parts, "tree", "node").groupBy("tree", "node").applyInPandas(finish, _SUBTREE)
        with shuffles_let_go(spark):
            below = {(r["tree"], r["node"]): r for r in grown.collect()}       # the model
    return [_whole(t, top, below) for t, top in tops.items()]


def _whole(t: int, top: _Top, below: dict) -> tuple:
    """(feature, cut, left, value) of a tree, the subtrees put in their places."""
    parts = [[np.array(c, kind)] for c, kind in zip((top.tree.feature, top.tree.cut, top.tree.left, top.tree.value),
                                                    (np.int16, np.uint8, np.int32, np.float64))]
    size = len(top.tree.feature)
    for node in top.small:
        if (t, node) not in below:                     # no row was drawn
            continue
        r = below[t, node]
        feature, cut, left, value = (np.frombuffer(r[c], kind) for c, kind in
                                     (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("value", np.float64)))
        left = np.where(feature >= 0, left - 1 + size, 0).astype(np.int32)        # the first node takes the place of ``node``
        for part, c in zip(parts, (feature, cut, left, value)):
            part[0][node] = c[0]
            part.append(c[1:])
        size += len(feature) - 1
    return tuple(np.concatenate(p) for p in parts)


def fit_trees(df: DataFrame, cols: list[str], s: Settings) -> list[tuple]:
    """Trees (feature, threshold, left, value arrays) fitted on ``df(label, *cols)``; a node's children are left and left + 1."""
    spark = df.sparkSession
    ship_package(spark)
    if not 2 <= s.bins <= 256:
        raise ValueError(f"max_bin must be from 2 to 256, not {s.bins}")
    n = df.count()
    if not n:
        raise ValueError("no labelled rows for random_forest")
    cuts = boosting.quantile_cuts(df, cols, s.bins)
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex[:12]}"
    blocks = boosting.write_blocks(df, cols, cuts, s.seed, n, path)
    ends = [np.append(c, np.inf) for c in cuts]       # a cut at the last bin leaves nothing on the right
    a_pass, out = max(1, PAIRS // n), []
    for first in range(0, s.trees, a_pass):
        for feature, cut, left, value in _pass(blocks, list(range(first, min(first + a_pass, s.trees))), n, len(cols), s):
            at = np.zeros(len(feature))
            for f, e in enumerate(ends):
                mine = feature == f
                at[mine] = e[np.minimum(cut[mine], len(e) - 1)]
            out.append((feature, at, left, value))
    return out


def joined(trees: list[tuple]) -> boosting.Walk:
    """All trees, ready to be walked."""
    return boosting.Walk([(t[0], t[1], t[2], t[3]) for t in trees])


def scores(x: np.ndarray, forest: boosting.Walk) -> np.ndarray:
    return forest.total(x) / len(forest.trees)         # tree by tree, so that a sum doesn't depend on its batch


def score_column(spark: SparkSession, trees: list[tuple], cols: list[str]) -> Column:
    """P(label = 1)."""
    ship_package(spark)
    bc = spark.sparkContext.broadcast(joined(trees))          # trees x nodes of a tree

    @F.pandas_udf(T.DoubleType())
    def forest_score(*columns: pd.Series) -> pd.Series:
        x = np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), posinf=np.inf, neginf=-np.inf)
        return pd.Series(scores(x, bc.value))

    return forest_score(*[F.col(c).cast("double") for c in cols])


def tree_rows(trees: list[tuple]) -> list[tuple]:
    return [(i, *(bytearray(c.astype(kind).tobytes()) for c, kind in zip(t, _KINDS))) for i, t in enumerate(trees)]


def trees_of(rows: Iterable) -> list[tuple]:
    return [tuple(np.frombuffer(r[c], kind) for c, kind in zip(("feature", "threshold", "left", "value"), _KINDS)) for r in rows]
