"""NumPy block kernels: the nearest of a block of stored vectors to each of a block of query vectors.

Matrix products only prune: what they leave is measured by direct differences in float64, pair by pair, so that results
equal the Catalyst expressions to six decimals and equal vectors get equal distances wherever they stand.  (The Gram form
alone loses distance 0 to cancellation.)
"""

from __future__ import annotations

import numpy as np

#: Bytes of temporaries of a step.
STEP_BYTES = 16 << 20


def pairwise(base: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Matrix queries x base of distances; NaN where cosine has a zero vector."""
    out = np.empty((len(queries), len(base)))
    step = max(1, STEP_BYTES // max(1, base.size * 8))
    for i in range(0, len(queries), step):
        n = len(queries[i : i + step])
        pos, at = np.repeat(np.arange(i, i + n), len(base)), np.tile(np.arange(len(base)), n)
        out[i : i + step] = exact(base, queries, pos, at, metric).reshape(n, len(base))
    return out


def exact(base: np.ndarray, queries: np.ndarray, pos: np.ndarray, at: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (queries[pos], base[at]), each from its own two vectors only."""
    out = np.empty(len(pos))
    step = max(1, STEP_BYTES // max(1, base.shape[1] * 8))
    for i in range(0, len(pos), step):
        x, q = base[at[i : i + step]], queries[pos[i : i + step]]
        if metric == "hamming":
            out[i : i + step] = np.bitwise_count(x ^ q).sum(1)
            continue
        x, q = x.astype("f8"), q.astype("f8")
        if metric == "l2":
            d = x - q
            out[i : i + step] = np.sqrt(np.einsum("ij,ij->i", d, d))
        elif metric == "l1":
            out[i : i + step] = np.abs(x - q).sum(1)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i : i + step] = 1.0 - np.einsum("ij,ij->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", x, x)))
    return out


def about(base: np.ndarray, queries: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Distances by matrix products where there are such (l2, cosine), and how far off they can be; NaN as in pairwise."""
    if metric not in ("l2", "cosine"):
        return pairwise(base, queries, metric), 0.0
    x, q = base.astype("f8"), queries.astype("f8")
    xx, qq, dot = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q), q @ x.T
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - dot / (np.sqrt(qq)[:, None] * np.sqrt(xx)), 1e-13 * base.shape[1]
    top = float(xx.max(initial=0.0) + qq.max(initial=0.0))
    # an error e of the square is at most sqrt(e) of the root
    return np.sqrt(np.maximum(qq[:, None] + xx - 2 * dot, 0.0)), float(np.sqrt(1e-15 * base.shape[1] * top))


def nearest(base: np.ndarray, queries: np.ndarray, metric: str, k: int, low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (pos, at) that hold the k nearest base rows of each query, with ties, of those with a distance within [low, high]
    or near its ends; the rest may hold some more."""
    d, off = about(base, queries, metric)
    with np.errstate(invalid="ignore"):
        maybe = (d >= low - off) & (d <= high + off)  # NaN is neither
        sure = np.where((d >= low + off) & (d <= high - off), d, np.inf)
    if k < sure.shape[1]:
        maybe &= d <= np.partition(sure, k - 1, axis=1)[:, k - 1 : k] + 2 * off if k else False
    return np.nonzero(maybe)


def kmeans(x: np.ndarray, n: int, iterations: int = 25, seed: int = 42) -> np.ndarray:
    """Centroids by k-means++ seeding and Lloyd steps in L2 space; an empty cell restarts at the farthest point.  Rows are
    measured in blocks, so that memory is that of x, the centroids and STEP_BYTES."""
    rng = np.random.default_rng(seed)
    n = min(n, len(x))
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < n:
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centres.append(x[pick])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    c = np.array(centres)
    step = max(1, STEP_BYTES // (8 * n))
    for _ in range(iterations):
        cell, away = np.empty(len(x), "i8"), np.empty(len(x))
        for i in range(0, len(x), step):
            d = (x[i : i + step] ** 2).sum(1)[:, None] - 2 * x[i : i + step] @ c.T + (c * c).sum(1)
            cell[i : i + step] = d.argmin(1)
            away[i : i + step] = d.min(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        count = np.bincount(cell, minlength=n)
        new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        far = np.argsort(-away, kind="stable")
        for i, j in zip(np.flatnonzero(count == 0), far, strict=False):
            new[i] = x[j]
        if np.allclose(new, c):
            break
        c = new
    return c
