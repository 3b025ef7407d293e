"""Vectors in Arrow batches: validity, matrices, random rotations, chi-square."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(c: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    inf = F.lit(float("inf"))
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(F.col(c).isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Columns of as many random orthogonal dim x dim matrices as make up `bits`."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """The chi-square distribution function for even m."""
    h = np.asarray(x, dtype=np.float64) / 2
    return 1 - np.exp(-h) * sum(h**i / math.factorial(i) for i in range(m // 2))


def chi2_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, m) < p else (low, mid)
    return high


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a-b: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
