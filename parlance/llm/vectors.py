"""Vector columns: which rows take part, and small numpy pieces the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """True for arrays whose components are all finite numbers and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0),
                      F.lit(False))


def stack(column) -> np.ndarray:
    """A pandas column of equally long lists as a float64 matrix."""
    return np.array(column.to_list(), np.float64) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans_directions(x: np.ndarray, k: int, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """k unit centres of unit vectors (spherical k-means; empty centres restart on far points)."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        far = np.argsort(sims.max(axis=1))
        c = np.zeros_like(c)
        np.add.at(c, own, x)
        empty = np.flatnonzero(np.linalg.norm(c, axis=1) < 1e-12)
        c[empty] = x[far[:len(empty)]]
        c = unit(c)
    return c


def bounded_sample(df: DataFrame, key: str, rows: int, salt: int = 3) -> DataFrame:
    """At most `rows` rows, the first in the order of a hash of `key`."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(salt)), key).limit(rows)
