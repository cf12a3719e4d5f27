"""Steps on one video's arrays: where segments end, the graph over them, relevance over it, greedy choices."""

from __future__ import annotations

import numpy as np

#: Rows of the similarity matrix that are held at once.
BLOCK = 1024


def surviving(sums: np.ndarray, bounds: list[int], least: int) -> list[int]:
    """The bounds that one walk from left to right leaves.

    sums: sums[k] is the sum of the first k frame vectors. A segment lies between two bounds that follow each
    other. One shorter than least gives up the bound towards the neighbour whose mean is more similar (the left one
    on ties), if that similarity is positive.
    """

    def mean(a: int, z: int) -> np.ndarray:
        return (sums[z] - sums[a]) / (z - a)

    kept = [bounds[0]]
    for k in range(1, len(bounds)):
        here, lo = bounds[k], kept[-1]
        if here - lo < least:
            own = mean(lo, here)
            left = float(mean(kept[-2], lo) @ own) if len(kept) > 1 else -1.0
            right = float(own @ mean(here, bounds[k + 1])) if k + 1 < len(bounds) else -1.0
            if left > 0 and left >= right:
                kept.pop()
            elif right > 0:
                continue
        kept.append(here)
    return kept


def bounds_of(x: np.ndarray, threshold: float, least: int) -> tuple[list[int], np.ndarray]:
    """(bounds, sums) of the segments of frame vectors x: cut where neighbours are less similar than threshold, then
    short ones joined until a walk changes nothing."""
    sums = np.vstack((np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)))
    now = [0, *(np.flatnonzero((x[:-1] * x[1:]).sum(axis=1) < threshold) + 1).tolist(), len(x)]
    while len(now) > 2 and len(after := surviving(sums, now, least)) < len(now):
        now = after
    return now, sums


def unit(x: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), floor)


def segments(x: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, vectors): places of the segments' frames, both inclusive, and their mean vectors of unit length."""
    bounds, sums = bounds_of(x, threshold, least)
    at = np.array(bounds)
    return at[:-1], at[1:] - 1, unit((sums[at[1:]] - sums[at[:-1]]) / np.diff(at)[:, None])


def edges(x: np.ndarray, centre: np.ndarray, alpha: float = 0.6, tau: float = 30.0, top: int = 8):
    """(i, j, w, w_norm): visual and temporal closeness, the best of each row (ties: least j), both directions halved
    and summed, then scaled by the degrees of both ends. Memory: BLOCK rows of the matrix."""
    n = len(x)
    keep = min(top, n - 1)
    row, col, val = [], [], []
    for a in range(0, n if keep > 0 else 0, BLOCK):
        part = slice(a, min(a + BLOCK, n))
        w = alpha * np.clip(x[part] @ x.T, 0, 1) + (1 - alpha) * np.exp(-np.abs(centre[part, None] - centre) / tau)
        w = np.round(w, 9)
        w[np.arange(w.shape[0]), np.arange(part.start, part.stop)] = -1
        best = np.argsort(-w, axis=1, kind="stable")[:, :keep]
        row.append(np.repeat(np.arange(part.start, part.stop), keep))
        col.append(best.ravel())
        val.append(np.take_along_axis(w, best, axis=1).ravel() / 2)
    i, j, half = (np.concatenate(v) if v else np.empty(0) for v in (row, col, val))
    key, of = np.unique(np.concatenate((i * n + j, j * n + i)).astype(np.int64), return_inverse=True)
    w = np.bincount(of, np.concatenate((half, half)), len(key))
    i, j = key // max(n, 1), key % max(n, 1)
    degree = np.bincount(i, w, n)
    root = np.sqrt(degree[i] * degree[j])
    ok = (degree[i] > 1e-8) & (degree[j] > 1e-8)
    return i, j, w, np.where(ok, w / np.where(ok, root, 1), 0.0)


def spread(i, j, w_norm, y: np.ndarray, f: np.ndarray, steps: int = 7, alpha: float = 0.6) -> np.ndarray:
    """steps times f = alpha * W f + (1 - alpha) * y; from y where f is all zero."""
    if np.abs(f).sum() < 1e-8:
        f = y
    for _ in range(steps):
        f = alpha * np.bincount(i, w_norm * f[j], len(y)) + (1 - alpha) * y
    return f


def spaced(f: np.ndarray, i, j, n: int = 8, factor: float = 0.2) -> list[int]:
    """The best node again and again (ties: the least), its neighbours damped each time; stops at 0."""
    f, out = np.round(f, 9), []
    cut = np.searchsorted(i, np.arange(len(f) + 1))
    while len(out) < n and len(f) and f.max() > 0:
        k = int(f.argmax())
        out.append(k)
        f[k] = -np.inf
        f[j[cut[k] : cut[k + 1]]] *= factor
    return out


def frames_of(first: int, last: int, per_node: int = 4) -> list[int]:
    """At most per_node places of a segment, evenly spread."""
    n = last - first + 1
    return list(range(first, last + 1)) if n <= per_node else [int(first + k * n / per_node) for k in range(per_node)]
