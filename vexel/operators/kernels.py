"""numpy kernels of index building and search."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Largest code of the 8-bit quantizer.
MAX_CODE = 255


def normalized(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay."""
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (x / np.where(length == 0, 1, length)).astype(np.float32)


@lru_cache(maxsize=4)
def rotation(dimensions: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, made once in a process."""
    q, r = np.linalg.qr(np.random.default_rng(seed & 0xFFFFFFFF).normal(size=(dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def prepared(x: np.ndarray, metric: str, seed: int, rotate: bool) -> np.ndarray:
    """Vectors as the index holds them before quantization."""
    x = np.ascontiguousarray(x, np.float32)
    if metric == "cosine":
        x = normalized(x)
    return x @ rotation(x.shape[1], seed).T if rotate else x


def quantizer(low: float, high: float) -> tuple[float, float]:
    """Base and scale for values between low and high."""
    return low, MAX_CODE / (high - low) if high > low else 1.0


def quantized(x: np.ndarray, base: float, scale: float) -> np.ndarray:
    scaled = (x.astype(np.float64) - base) * scale
    return np.clip(np.copysign(np.floor(np.abs(scaled) + 0.5), scaled), 0, MAX_CODE).astype(np.uint8)


def squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distance of each row to q, by differences."""
    d = x.astype(np.float32) - q.astype(np.float32)
    return np.einsum("ij,ij->i", d, d, dtype=np.float64)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid, the smallest of equals."""
    out = np.empty(len(x), np.int32)
    norms = (centroids.astype(np.float64) ** 2).sum(1)
    step = max(1, (16 << 20) // (8 * max(1, len(centroids))))
    for i in range(0, len(x), step):
        out[i : i + step] = (norms - 2.0 * (x[i : i + step].astype(np.float64) @ centroids.T.astype(np.float64))).argmin(1)
    return out


def kmeans(x: np.ndarray, clusters: int, seed: int, angular: bool, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty clusters take the rows farthest from their centroid."""
    if clusters == 1:
        return x[:1].copy()
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    centroids = x[rng.permutation(len(x))[:clusters]].copy()
    if len(centroids) < clusters:
        centroids = np.concatenate([centroids, centroids[rng.integers(0, len(centroids), clusters - len(centroids))]])
    for _ in range(rounds):
        own = nearest_centroid(x, centroids)
        counts = np.bincount(own, minlength=clusters)
        sums = np.zeros((clusters, x.shape[1]), np.float64)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(counts)
        sums[filled] = np.add.reduceat(x[order].astype(np.float64), np.cumsum(counts)[filled] - counts[filled], axis=0)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            far = np.argsort(-((x - new[own]) ** 2).sum(1), kind="stable")[: len(empty)]
            new[empty[: len(far)]] = x[far]
        centroids = normalized(new) if angular else new
    return centroids


def top(distance: np.ndarray, row_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by (distance, row_id); NaN comes last."""
    if k <= 0:
        return np.zeros(0, np.int64)
    keep = np.arange(len(distance))
    if len(keep) > 4 * k:
        ranked = np.where(np.isnan(distance), np.inf, distance)
        keep = np.flatnonzero(ranked <= np.partition(ranked, k - 1)[k - 1])
    return keep[np.lexsort((row_id[keep], distance[keep]))[:k]]
