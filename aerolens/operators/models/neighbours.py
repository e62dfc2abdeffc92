"""Nearest neighbours of every row by a forest of random projections, and outlier factors without a cap (M7).

The capped reference set of ``lof`` is searched row against row.  Here all rows
take part: equal rows become one point with a count, and in each of ``trees``
trees the points are split by random projections (Dasgupta, Freund 2008) until
no leaf holds more than ``leaf`` of them.  A pass splits every open node of
all trees by up to DEPTH levels: the node's cuts are medians of a sample of
at most SAMPLE of its points (kept by hash, so the sample is spread evenly and a
node's size doesn't matter).  Points at a cut go either way by hash, so equal
projections are split as well.  The cuts (points / leaf of them a tree) are
broadcast and every pass reads the points anew, so that they are neither copied
tree by tree nor written until their leaves are known.

Then the trees are taken one after the other: leaves are compared in full, some
GROUP points a task, and a point carries the nearest that it has so far to the
next tree, with their exact distances.  So one tree's points, not all trees'
pairs, are on disk at a time.  A pair is missed only if no tree puts both in one
leaf; ``recall`` measures it against a full search.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aerolens.operators.models import knn
from aerolens.operators.models.ocsvm_dual import points_of
from aerolens.session import checkpoint_dir, ship_package, shuffles_let_go

TREES = 10
LEAF = 512
DEPTH = 5                # levels a pass
SAMPLE = 2048            # points that a node's cuts are taken from, 64 for each of its last cuts
GROUP = 16_384           # points whose leaves one call compares
BLOCK = 1 << 17          # points a block of the full search
_NEAR = (("nbr", np.int64), ("dist", float), ("w", np.int64))
PAIR_SCHEMA = "id long, nbr long, dist double, w long"
_PLACED = "id long, x binary, c long, nodes array<long>"
_STATE = _PLACED + ", nbr binary, dist binary, w binary"


def with_ids(points: DataFrame) -> DataFrame:
    """(id, x, c): a point is known by a hash of its values that no two of them share."""
    for seed in range(100):
        rows = points.select(F.xxhash64("x", F.lit(seed)).alias("id"), "x", "c")
        if rows.groupBy("id").count().where("count > 1").isEmpty():
            return rows
    raise RuntimeError("no hash tells the points apart")


def _folder(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), f"neighbours-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, which later jobs read; what was shuffled for it is let go."""
    spark, path = df.sparkSession, path or _folder(df.sparkSession)
    with shuffles_let_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that no later job reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _directions(dims: int, seed: int, tree: int, step: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, step]).normal(size=(DEPTH, dims))


def _walk(P: np.ndarray, coin: np.ndarray, cuts: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Position in the heap of cuts (root 1) that each row of projections ends at."""
    at, rows = np.ones(len(P), dtype=np.int64), np.arange(len(P))
    for level in range(int(depth.max(initial=0))):
        cut = cuts[rows, np.minimum(at, cuts.shape[1]) - 1]
        p = P[:, level]
        right = (p > cut) | ((p == cut) & ((coin >> level) & 1 == 1))
        at = np.where(level < depth, 2 * at + right, at)
    return at


def _projections(X: np.ndarray, seed: int, tree: int, step: int) -> np.ndarray:
    """One product and sum a level, so that a point's value doesn't depend on its batch."""
    return np.column_stack([(X * w).sum(axis=1) for w in _directions(X.shape[1], seed, tree, step)])


def _coin(ids: np.ndarray, seed: int, tree: int, step: int) -> np.ndarray:
    """24 bits by a hash of the point, the tree and the pass."""
    x = ids.astype(np.uint64) ^ np.uint64((((seed * 1_000_003 + tree) * 1_000_003 + step) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(40)).astype(np.int64)


def _cutter(leaf: int, seed: int, step: int):
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, depth = int(pdf["tree"].iloc[0]), _depth(pdf["n"].iloc[0], leaf)
        pdf = pdf.sort_values("id", kind="stable")
        X, cuts = np.frombuffer(b"".join(pdf["x"])).reshape(len(pdf), -1), np.zeros((1 << DEPTH) - 1)
        P, coins = _projections(X, seed, tree, step), _coin(pdf["id"].to_numpy(), seed, tree, step)
        for level in range(depth):
            at = _walk(P, coins, np.broadcast_to(cuts, (len(P), len(cuts))), np.full(len(P), level))
            for node in range(1 << level, 2 << level):
                mine = P[at == node, level]
                cuts[node - 1] = np.median(mine) if len(mine) else 0.0
        return pd.DataFrame({"tree": [tree], "node": pdf["node"].iloc[:1].to_numpy(), "depth": depth, "cuts": [cuts]})
    return cut


def _depth(n: int, leaf: int) -> int:
    return min(DEPTH, int(np.ceil(np.log2(n / leaf))))


def _matrix(column, n: int) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _unpacked(column, kind) -> np.ndarray:
    """A column of bytes as rows of a matrix of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0]).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as bytes, which move between Spark and Python as they are."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _placed(X: np.ndarray, ids: np.ndarray, passes: list, trees: int, seed: int) -> np.ndarray:
    """(point, tree) nodes after the passes: each a sorted list of open (tree, node) with depths and cuts."""
    out = np.ones((len(X), trees), np.int64)
    for step, by_tree in enumerate(passes):
        for tree, (nodes, depth, cuts) in by_tree.items():
            node = out[:, tree]
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            rows = np.flatnonzero(nodes[at] == node)
            if len(rows):
                at, d = at[rows], depth[at[rows]]
                to = _walk(_projections(X[rows], seed, tree, step), _coin(ids[rows], seed, tree, step), cuts[at], d)
                out[rows, tree] = (node[rows] << d) + to - (1 << d)
    return out


def _by_tree(placed: DataFrame) -> DataFrame:
    return placed.select("id", "x", "c", "nodes", F.posexplode("nodes").alias("tree", "node"))


def _sizes(placed: DataFrame) -> DataFrame:
    """(tree, node, n) points of each node."""
    def count(batches):
        for b in batches:
            nodes = _matrix(b.column("nodes"), b.num_rows)
            for t in range(nodes.shape[1] if b.num_rows else 0):
                node, n = np.unique(nodes[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t, np.int32)), pa.array(node), pa.array(n)], ["tree", "node", "n"])

    return placed.select("nodes").mapInArrow(count, "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n"))


def leaves(points: DataFrame, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """(id, x, c, nodes, tree, node): every point once a tree, at most ``leaf`` points a (tree, node); x as bytes, ``nodes`` of all trees."""
    spark = points.sparkSession
    ship_package(spark)
    passes: list[dict] = []
    while True:
        bc = spark.sparkContext.broadcast(passes)      # some points / leaf cuts a tree

        def place(batches, bc=bc):
            for b in batches:
                if b.num_rows:
                    X = _matrix(b.column("x"), b.num_rows)
                    nodes = _placed(X, b.column("id").to_numpy(), bc.value, trees, seed)
                    yield pa.RecordBatch.from_arrays([b.column("id"), _packed(X), b.column("c"), _lists(nodes)], ["id", "x", "c", "nodes"])

        rows = points.select("id", "x", "c").mapInArrow(place, _PLACED)
        path = _folder(spark)
        opened = written(_sizes(rows).where(F.col("n") > leaf), path)
        if opened.isEmpty():
            _removed(spark, path)
            break
        every = _by_tree(rows)
        step = len(passes)
        # 64 points for each of a node's last cuts
        want = F.least(F.lit(float(SAMPLE)), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / F.lit(float(leaf)))) + 6))
        share = F.pmod(F.xxhash64("id", "tree", F.lit(seed + step)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        drawn = every.select("id", "x", "tree", "node").join(F.broadcast(opened), ["tree", "node"]).where(share * F.col("n") < 2.0 * want)
        found = drawn.groupBy("tree", "node").applyInPandas(_cutter(leaf, seed, step), "tree int, node long, depth int, cuts array<double>")
        with shuffles_let_go(spark):
            cuts = sorted(found.collect(), key=lambda r: (r["tree"], r["node"]))
        _removed(spark, path)
        by_tree = {}
        for t in sorted({r["tree"] for r in cuts}):
            mine = [r for r in cuts if r["tree"] == t]
            by_tree[t] = tuple(np.array([r[c] for r in mine]) for c in ("node", "depth", "cuts"))
        passes = [*passes, by_tree]
    return _by_tree(written(rows))


def _leaf(X: np.ndarray, best: np.ndarray, k: int):
    """(row, row, distance) of pairs in a leaf, the k nearest of each row among them if nearer than ``best``."""
    n = len(X)
    A = X - X.mean(axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        a = (A * A).sum(axis=1)
    if n > k + 1 and np.isfinite(a).all():
        d2 = np.column_stack([-2.0 * A, a, np.ones(n)]) @ np.column_stack([A, np.ones(n), a]).T
        np.fill_diagonal(d2, np.inf)
        limit, far = best * best * (1 + 1e-12), np.flatnonzero(np.isinf(best))
        if len(far):
            limit[far] = np.partition(d2[far], k - 1, axis=1)[:, k - 1]
        hit = np.flatnonzero(d2 <= (limit + 4e-12 * (a + a.max()))[:, None])
        row, col = np.divmod(hit, n)
    else:
        row, col = (v.ravel() for v in np.indices((n, n)))
        row, col = row[row != col], col[row != col]
    dist = np.sqrt(knn.squared(X[row], X[col]))
    fine = np.isfinite(dist) & (dist <= best[row])
    return row[fine], col[fine], dist[fine]


def _closer(k: int):
    """Compares the leaves of a group of points and keeps the k nearest that each has by now."""
    def near(t: pa.Table) -> pa.Table:
        n = t.num_rows
        ids, c, node = (t.column(v).to_numpy() for v in ("id", "c", "node"))
        X = _unpacked(t.column("x"), float)
        nbr, dist, w = (_unpacked(t.column(v), kind).copy() for v, kind in _NEAR)
        order = np.lexsort((ids, node))
        found = []
        for mine in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            row, col, d = _leaf(X[mine], dist[mine, -1], k)
            found.append((mine[row], mine[col], d))
        row, col, d = (np.concatenate(v) for v in zip(*found))
        todo = np.unique(row)
        old = np.flatnonzero(np.isfinite(dist[todo]).ravel())
        row = np.concatenate([row, todo[old // k]])
        name, d, many = (np.concatenate([u, v[todo].ravel()[old]]) for u, v in ((ids[col], nbr), (d, dist), (c[col], w)))
        order = np.lexsort((name, d, row))
        row, name, d, many = row[order], name[order], d[order], many[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (name[1:] != name[:-1])][:len(row)]      # a pair's distance is always the same
        row, name, d, many = row[new], name[new], d[new], many[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        row, place = row[keep], place[keep]
        nbr[todo], dist[todo], w[todo] = 0, np.inf, 0
        nbr[row, place], dist[row, place], w[row, place] = name[keep], d[keep], many[keep]
        return pa.Table.from_arrays([*(t.column(v) for v in ("id", "x", "c")), t.column("nodes"), *map(_packed, (nbr, dist, w))], ["id", "x", "c", "nodes", "nbr", "dist", "w"])
    return near


def _nearest(q: pd.DataFrame, r: pd.DataFrame, k: int):
    """The k points of ``r`` nearest to each of ``q``, but the point itself."""
    r = r.sort_values("id")
    ids, names, w = q["id"].to_numpy(), r["id"].to_numpy(), r["c"].to_numpy()
    row, col, dist = knn.Reference(np.vstack(r["x"].to_numpy())).nearest(np.vstack(q["x"].to_numpy()), k, pd.Index(names).get_indexer(ids))
    return pd.DataFrame({"id": ids[row], "nbr": names[col], "dist": dist, "w": w[col]})


def nearest(points: DataFrame, k: int = 20, trees: int = TREES, leaf: int = LEAF, seed: int = 42) -> DataFrame:
    """(id, nbr, dist, take): the k nearest other rows of every point (id, x, c) by the forest, ``take`` of them equal to nbr.

    Rows equal to the point are its first neighbours and not listed.
    """
    spark, leaf = points.sparkSession, max(leaf, 4 * k)
    groups = -(-points.count() // GROUP)
    none = {"nbr": np.zeros(k, np.int64), "dist": np.full(k, np.inf), "w": np.zeros(k, np.int64)}
    state = leaves(points, trees, leaf, seed).where("tree = 0").select("id", "x", "c", "nodes", *[F.lit(bytearray(v.tobytes())).alias(c) for c, v in none.items()])
    path = None
    for t in range(trees):
        rows = state.withColumn("node", F.get("nodes", F.lit(t)))
        met = rows.groupBy(F.pmod(F.xxhash64("node"), F.lit(max(groups, 1)))).applyInArrow(_closer(k), _STATE)
        path, before = _folder(spark), path
        state = written(met, path)
        if before:
            _removed(spark, before)

    def take(batches):
        for b in batches:
            nbr, dist, w = (_unpacked(b.column(c), kind) for c, kind in _NEAR)
            left = (k - (b.column("c").to_numpy() - 1))[:, None] - (np.cumsum(w, axis=1) - w)
            row, place = np.nonzero(np.minimum(w, left) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                b.column("id").to_numpy()[row], nbr[row, place], dist[row, place], np.minimum(w, left)[row, place])],
                ["id", "nbr", "dist", "take"])

    return state.select("id", "c", "nbr", "dist", "w").mapInArrow(take, "id long, nbr long, dist double, take long")


def _taken(pairs: DataFrame, k: int) -> DataFrame:
    """(id, nbr, dist, take) of the first k rows of each point's pairs (id, c, nbr, dist, w)."""
    near = Window.partitionBy("id").orderBy("dist", "nbr").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(k) - (F.col("c") - 1) - F.coalesce(F.sum("w").over(near), F.lit(0))
    return pairs.withColumn("take", F.least("w", left)).where("take > 0").select("id", "nbr", "dist", "take")


def nearest_exact(points: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """The k nearest rows of the given points by a full search in blocks; to measure the forest."""
    ship_package(points.sparkSession)
    nq, nr = -(-queries.count() // block), -(-points.count() // block)
    deal = lambda d, n: d.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    both = deal(queries, nq).select(F.col("b").alias("qb"), every(nr).alias("rb"), F.lit(True).alias("q"), "id", "x", "c").union(
        deal(points, nr).select(every(nq).alias("qb"), F.col("b").alias("rb"), F.lit(False).alias("q"), "id", "x", "c"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["q"]], pdf[~pdf["q"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"id": pd.Series(dtype=int), "nbr": pd.Series(dtype=int), "dist": pd.Series(dtype=float), "w": pd.Series(dtype=int)})
        return _nearest(q, r, k)

    found = both.groupBy("qb", "rb").applyInPandas(near, PAIR_SCHEMA)      # a pair is found in one block only
    return _taken(found.join(queries.select("id", "c"), "id"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_points, n_true, recall): the share of true neighbours that are found, ties at the last distance alike."""
    last = exact.groupBy("id").agg(F.max("dist").alias("last"), F.sum("take").alias("want"))
    hit = found.join(last, "id").where(F.col("dist") <= F.col("last")).groupBy("id").agg(F.sum("take").alias("got"))
    both = last.join(hit, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_points"), F.sum("want").alias("n_true"),
                    (F.sum(F.least("want", F.coalesce("got", F.lit(0)))) / F.sum("want")).alias("recall"))


def outlier_factors(rows: DataFrame, feature_cols, k: int = 20, trees: int = TREES, leaf: int = LEAF, seed: int = 42,
                    found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, x, c, kdist, lrd, lof) of every different row: local outlier factors (Breunig et al. 2000) among all rows.

    ``c`` rows are equal to the point; near 1 is usual, larger is more
    anomalous.  With fewer than k other rows all are neighbours.  ``found`` are the
    written points and their ``nearest``, if the caller has them.
    """
    points = found[0] if found else with_ids(written(points_of(rows, feature_cols)))
    if points.agg(F.sum("c")).first()[0] in (None, 1):
        raise ValueError("LOF needs at least two rows")
    knn = found[1] if found else written(nearest(points, k, trees, leaf, seed))
    own = F.least(F.col("c") - 1, F.lit(k))
    last = knn.groupBy("id").agg(F.max("dist").alias("kdist"))
    base = points.join(last, "id", "left").withColumn("kdist", F.coalesce("kdist", F.lit(0.0))).withColumn("own", own)
    far = knn.join(base.select(F.col("id").alias("nbr"), F.col("kdist").alias("kd")), "nbr") \
        .groupBy("id").agg(F.sum(F.col("take") * F.greatest("kd", "dist")).alias("reach"), F.sum("take").alias("others"))
    n = F.col("own") + F.coalesce("others", F.lit(0))
    total = F.coalesce("reach", F.lit(0.0)) + F.col("own") * F.col("kdist")
    dense = written(base.join(far, "id", "left").select("id", "x", "c", "own", "kdist", n.alias("n"), (1.0 / (total / n + 1e-10)).alias("lrd")))
    around = knn.join(dense.select(F.col("id").alias("nbr"), F.col("lrd").alias("l")), "nbr") \
        .groupBy("id").agg(F.sum(F.col("take") * F.col("l")).alias("around"))
    lof = (F.coalesce("around", F.lit(0.0)) + F.col("own") * F.col("lrd")) / F.col("n") / F.col("lrd")
    return dense.join(around, "id", "left").select("id", "x", "c", "kdist", "lrd", lof.alias("lof"))
