"""Squared Euclidean distances in blocks: one matrix product, and the plain sum wherever rounding could decide."""

from __future__ import annotations

import numpy as np

#: Relative to the squared lengths, more than rounding can part the product's distance from the plain sum's.
ROUNDING = 1e-12


def approximate(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each row of x to each of w, and by how much a row's may be off."""
    xx, ww = (x * x).sum(axis=1), (w * w).sum(axis=1)
    return xx[:, None] + ww[None] - 2 * (x @ w.T), ROUNDING * x.shape[1] * (xx + ww.max(initial=0.0)) + 1e-300


def closest(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the row of w nearest to each row of x; ties to the first."""
    d, off = approximate(x, w)
    near = d.argmin(axis=1)
    least = np.take_along_axis(d, near[:, None], 1)
    close = d <= least + 2 * off[:, None]
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        some = np.flatnonzero(close[i])
        near[i] = some[((x[i] - w[some]) ** 2).sum(axis=1).argmin()]
    return near, ((x - w[near]) ** 2).sum(axis=1)


def nearest_k(ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int, other_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the k rows (own, x) nearest to each query (ids, q), in order; ties to the smaller id. Where there
    are fewer, distances are infinite."""
    d, off = approximate(q, x)
    if other_only:
        d[ids[:, None] == own[None, :]] = np.inf
    if d.shape[1] > k:
        least = np.partition(d, k - 1, axis=1)[:, k - 1]
        d[d > (least + 2 * off)[:, None]] = np.inf
    row, col = np.nonzero(np.isfinite(d))
    return ranked(row, own[col], ((q[row] - x[col]) ** 2).sum(axis=1), len(q), k)


def ranked(row: np.ndarray, ids: np.ndarray, exact: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the k best of each of n queries, from (number of the query, id, squared distance)."""
    order = np.lexsort((ids, exact, row))
    row, ids, exact = row[order], ids[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    first = place < k
    out_d, out_i = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
    out_d[row[first], place[first]], out_i[row[first], place[first]] = exact[first], ids[first]
    return out_d, out_i


class Reached:
    """Rows as single-precision columns around a center, whose products rule out all but a few rows of a distance asked for:
    thresholds are widened by more than single precision can be off, so none is lost, and those left are measured exactly."""

    def __init__(self, own: np.ndarray, x: np.ndarray, center: np.ndarray):
        self.own, self.x, self.center, y = own, x, center, x - center
        yy = (y * y).sum(axis=1)
        self.far = float(np.sqrt(yy.max(initial=0.0)))
        self.fits = bool(np.isfinite(self.far)) and self.far < 1e15
        self.y = np.concatenate([y, -yy[:, None] / 2], axis=1).astype(np.float32) if self.fits else None

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries as such columns, their squared lengths, and by how much a product may be off."""
        p = q - self.center
        qq = (p * p).sum(axis=1)
        off = (q.shape[1] + 8) * 1.2e-7 * (np.sqrt(qq) + self.far) ** 2 + 1e-37
        return np.concatenate([p, np.ones((len(p), 1))], axis=1).astype(np.float32), qq, off

    def nearest_k(self, ids: np.ndarray, q: np.ndarray, ready: tuple, limit: np.ndarray, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_k`` among rows a to b at squared distances of up to ``limit``."""
        p, qq, off = ready
        if self.fits and np.isfinite(limit).all() and float(np.sqrt(qq.max(initial=0.0))) < 1e15:
            hit = p @ self.y[a:b].T >= ((qq - limit) / 2 - off).astype(np.float32)[:, None]
            if np.count_nonzero(hit) <= hit.size // 16:
                row, col = np.divmod(np.flatnonzero(hit), b - a)
                exact = ((q[row] - self.x[a + col]) ** 2).sum(axis=1)
                near = exact <= limit[row]
                return ranked(row[near], self.own[a + col[near]], exact[near], len(q), k)
        return nearest_k(ids, q, self.own[a:b], self.x[a:b], k)


def merged(d0: np.ndarray, i0: np.ndarray, d1: np.ndarray, i1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two such results."""
    d, i = np.concatenate([d0, d1], 1), np.concatenate([i0, i1], 1)
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
