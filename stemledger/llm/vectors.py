"""What the operators on embeddings share: sound vectors, k-means on a bounded sample, and packing rows for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, those with the smallest hashes of their ids.
SAMPLE = 20_000


def sound(vectors: DataFrame, kind: str = "array<double>") -> DataFrame:
    """(vec_id, embedding as ``kind``) of vectors with an id that are not null, empty or zero and hold only finite numbers."""
    good = (
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
        & F.col("vec_id").isNotNull()
    )
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    return rows.filter(F.coalesce(good, F.lit(False)))


def by_length(vectors: DataFrame, most: int = SAMPLE) -> list[tuple[int, np.ndarray]]:
    """The bounded sample, apart by the length of its vectors."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(most).toPandas()["embedding"]
    return [(int(dim), matrix(part)) for dim, part in rows.groupby(rows.map(len))] if len(rows) else []


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest number first, so that no square is out of range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, spherical: bool, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of ``x``; spherical: of rows at length one, by cosine. Fewer if ``x`` has fewer rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)] if k else x[:0]
    for _ in range(rounds if k else 0):
        home = nearest(x, centres, spherical)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.bincount(home, minlength=k)
        filled = size > 0
        centres = centres.copy()
        centres[filled] = sums[filled] / size[filled, None]
        if spherical:
            length = np.sqrt((centres**2).sum(axis=1, keepdims=True))
            centres = np.divide(centres, length, out=centres, where=length > 0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    score = x @ centres.T
    if not spherical:
        score -= (centres**2).sum(axis=1) / 2
    return score.argmax(axis=1)
