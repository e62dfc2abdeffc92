"""Exact nearest rows of a reference set held by one task (M7).

The reference rows lie in tiles of near rows (halved at the middle of the widest
column), and so do the queries.  Two tiles whose boxes are further apart than
the distances that the queries already have are not compared; of the others a
matrix product leaves out the pairs that are too far by more than its error,
and the rest are worked out from differences.  So the result is that of a full
search: ties go to the row that comes first.
"""

from __future__ import annotations

import numpy as np

TILE = 256               # reference rows of a tile
QUERIES = 128            # queries compared at once
CHUNK = 1024             # reference rows compared at once
_ERROR = 1e-12           # of a squared length, more than a matrix product is off by


def tiles(X: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size`` near rows."""
    out, todo = [], [np.arange(len(X))] if len(X) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        P = X[rows]
        with np.errstate(invalid="ignore", over="ignore"):
            wide = np.nan_to_num(P.max(axis=0) - P.min(axis=0), nan=0.0, posinf=np.inf)
        half = len(rows) // 2
        order = np.argpartition(P[:, int(np.argmax(wide))], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def squared(P: np.ndarray, Q: np.ndarray) -> np.ndarray:
    """Squared distances row by row, column after column, so that they don't depend on the batch."""
    total = np.zeros(len(P))
    with np.errstate(invalid="ignore", over="ignore"):
        for f in range(P.shape[1]):
            d = P[:, f] - Q[:, f]
            total += d * d
    return total


def first_k(row: np.ndarray, name: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least (dist, name) of each row, in the order of (row, dist, name)."""
    order = np.lexsort((name, dist, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


class Reference:
    def __init__(self, R: np.ndarray):
        self.R = np.ascontiguousarray(R, dtype=float)
        self.mid = self.R.mean(axis=0) if len(R) else np.zeros(self.R.shape[1])
        groups = tiles(self.R, TILE)
        self.order = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        self.at = np.cumsum([0] + [len(g) for g in groups])
        self.lo = np.array([self.R[g].min(axis=0) for g in groups])
        self.hi = np.array([self.R[g].max(axis=0) for g in groups])
        with np.errstate(invalid="ignore", over="ignore"):
            B = self.R[self.order] - self.mid
            self.length = (B * B).sum(axis=1)
        # a product with (-2a, |a|^2, 1) is a squared distance
        self.B = np.column_stack([B, np.ones(len(B)), self.length])
        self.exact = not np.isfinite(self.length).all()

    def nearest(self, Q: np.ndarray, k: int, own: np.ndarray | None = None):
        """(query, row, distance) of the k nearest rows of each query, in this order; ``own`` are rows that a query leaves out, or -1."""
        Q = np.ascontiguousarray(Q, dtype=float)
        own = np.full(len(Q), -1) if own is None else own
        found = [self._tile(Q[q], own[q], k, q) for q in tiles(Q, QUERIES)] if len(self.R) else []
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, col, dist = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], col[order], dist[order]

    def _tile(self, Q: np.ndarray, own: np.ndarray, k: int, names: np.ndarray):
        with np.errstate(invalid="ignore", over="ignore"):
            A = Q - self.mid
            a = (A * A).sum(axis=1)
        row, col, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if self.exact or not np.isfinite(a).all():
            chunks = [(0.0, s, min(s + CHUNK, len(self.order))) for s in range(0, len(self.order), CHUNK)]
            product = None
        else:
            gap = np.maximum(0.0, np.maximum(self.lo - Q.max(axis=0), Q.min(axis=0) - self.hi))
            gap = (gap * gap).sum(axis=1)
            chunks = [(gap[t], self.at[t], self.at[t + 1]) for t in np.argsort(gap, kind="stable")]
            product = np.column_stack([-2.0 * A, a, np.ones(len(A))])
        best = np.full(len(Q), np.inf)                 # squared distance of the k-th so far
        i = 0
        while i < len(chunks) and not chunks[i][0] * (1 - 1e-9) > best.max():
            take, size = [], 0
            while i < len(chunks) and size < CHUNK and not chunks[i][0] * (1 - 1e-9) > best.max():
                take.append(np.arange(chunks[i][1], chunks[i][2]))
                size += len(take[-1])
                i += 1
            here = np.concatenate(take) if len(take) > 1 else take[0]
            rows = self.order[here]
            if product is None:
                r, c = (v.ravel() for v in np.indices((len(Q), len(rows))))
            else:
                d2 = product @ self.B[here].T
                limit = best
                if len(rows) > k + 1:
                    far = np.isinf(best)
                    if far.any():                      # k of these rows and the query itself are no further
                        limit = best.copy()
                        limit[far] = np.partition(d2[far], k, axis=1)[:, k]
                hit = np.flatnonzero(d2 <= (limit + 4.0 * _ERROR * (a + self.length[here].max()))[:, None])
                r, c = np.divmod(hit, len(rows))
            c = rows[c]
            other = c != own[r]
            r, c = r[other], c[other]
            if not len(r):
                continue
            d = np.sqrt(squared(Q[r], self.R[c]))
            fine = np.isfinite(d)
            row, col, dist = (np.concatenate([u, v[fine]]) for u, v in ((row, r), (col, c), (dist, d)))
            keep = first_k(row, col, dist, k)
            row, col, dist = row[keep], col[keep], dist[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(Q)) == k)
            last = np.searchsorted(row, full, side="right") - 1
            best[full] = dist[last] ** 2 * (1 + 1e-12)
        return names[row], col, dist
