"""Whitening of embeddings by spectral divide and conquer over polar decompositions.

1. Entries become whole numbers, so sums over the distinct vectors are exact wherever they are made.
2. Tasks add up the centred products of their distinct vectors; the covariance, as many numbers as the square of the
   dimension, is all that reaches the driver.
3. ``spectral`` shifts the covariance and takes its polar factor by QDWH (dynamically weighted Halley steps in QR form). The
   factor's sign splits space into two invariant subspaces; each is divided in the same way until one component is left.
4. Mean and components, a matrix of the dimension by the number of components, go to all tasks, which whiten every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemledger.llm.shared import release, staged

#: An entry c becomes floor(SCALE * c).
SCALE = 256
_EPS = np.finfo(np.float64).eps
_LONG = 2**63 - 1


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH; directions in its null space may get any value of -1 to 1."""
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    low = _EPS  # taken as lower bound of the smallest: a bound too low costs a step, not accuracy
    eye = np.eye(n)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
        following = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        following = (following + following.T) / 2
        moved = np.linalg.norm(following - x)
        x = following
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < np.cbrt(4 * _EPS) and 1 - low < 10 * _EPS:
            break
    return x


def spectral(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    values, vectors = [], []
    scale = np.linalg.norm(v)
    pending = [(v, np.eye(len(v)))] if len(v) else []
    while pending:
        a, basis = pending.pop()
        n = len(a)
        level = np.trace(a) / n
        if n == 1 or np.linalg.norm(a - level * np.eye(n)) <= 4 * n * _EPS * scale:
            values += [level] * n  # one component, or several that nothing tells apart
            vectors += list(basis.T)
            continue
        parts = _divide(a)
        pending += [(_projected(a, q), basis @ q) for q in parts]
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    order = np.argsort(values)[::-1]
    # rounding of the products of many bases is taken out by one orthogonal step
    q, r = np.linalg.qr(np.array(vectors).T[:, order])
    q = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    return np.einsum("ij,ik,kj->j", q, v, q), q


def _projected(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    part = q.T @ a @ q
    return (part + part.T) / 2


def _divide(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the invariant subspaces above and below a shift; the shift is bisected until both have a dimension."""
    n = len(a)
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    low, high = (np.diag(a) - radius).min(), (np.diag(a) + radius).max()  # all eigenvalues lie between
    shift = np.trace(a) / n  # some lie above their mean and some below, unless all are the same
    for _ in range(200):
        shifted = a - shift * np.eye(n)
        projector = (polar(shifted) + np.eye(n)) / 2
        above = int(round(np.trace(projector)))
        if 0 < above < n:
            # the projector's range, in the order of pivots; a second pass makes it orthogonal to rounding
            q = _range(projector, above)
            return q[:, :above], q[:, above:]
        if above:
            low = shift
        else:
            high = shift
        shift = (low + high) / 2
    raise ArithmeticError("no shift separates the components")


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal basis whose first ``rank`` columns span the projector's range."""
    rng = np.random.default_rng(3)
    start = projector @ rng.standard_normal((len(projector), rank))
    q, _ = np.linalg.qr(start)
    q, _ = np.linalg.qr(projector @ q)
    return np.linalg.qr(np.hstack((q, np.eye(len(q)))))[0][:, : len(projector)]


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of vectors that are not null and hold finite entries only; entries beyond a long are its bounds."""
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.coalesce(good, F.lit(False)) & (F.size("embedding") > 0))
    product = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-9.2e18)), F.lit(9.2e18))))
    return rows.select("vec_id", product.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - total / n, in doubles; whole and broken part of the mean apart, so that large means cost no digits."""
    mean = [divmod(t, n) for t in total]
    return (x - np.array([m for m, _ in mean], dtype=np.int64)).astype(np.float64) - np.array([r / n for _, r in mean])


def _covariance(fit: DataFrame, project) -> np.ndarray:
    """Sum of the products of ``project``'s columns over all rows; tasks send one matrix each, Spark adds them up."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch.column("x")))
                total = y.T @ y + (0 if total is None else total)
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["place", "value"])

    summed = fit.select("x").mapInArrow(products, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    table = summed.toArrow().sort_by("place")  # the dimension squared
    side = int(round(table.num_rows**0.5))
    return table.column("value").to_numpy().reshape(side, side)


class Whitener:
    """Fitted on vectors of one length: their number, sums, eigenvalues and components."""

    def __init__(self, fit: DataFrame, dim: int, components: int):
        places = [F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
        row = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), *places).first()
        self.n, self.most, self.total = row["n"], row["most"], [int(row[f"s{i}"]) for i in range(dim)]
        n, total = self.n, self.total
        v = _covariance(fit, lambda x: _centred(x, n, total)) / n
        self.trace = float(np.trace(v))
        values, vectors = spectral(v)
        self.rank = int((values > 64 * dim * _EPS * max(values[0], 0)).sum()) if self.trace > 0 else 0
        self.values, self.vectors = values[: min(components, self.rank)], vectors[:, : min(components, self.rank)]
        self.weights = self.vectors / np.sqrt(self.values)
        self.identity_error = 0.0
        if len(self.values):
            weights = self.weights
            mean = _mean(fit, lambda x: _centred(x, n, total) @ weights, len(self.values)) / n
            found = _covariance(fit, lambda x: _centred(x, n, total) @ weights - mean) / n
            self.identity_error = float(np.abs(found - np.eye(len(found))).max())

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.total) @ self.weights

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n * x - S)^2 per row; None where it is beyond a long."""
        n, total = self.n, self.total
        bound = n * self.most + max(map(abs, total))
        if bound * bound * len(total) <= _LONG:
            y = n * x - np.array(total, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = (sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x.tolist())
        return [d if d <= _LONG else None for d in exact]


def _mean(fit: DataFrame, project, width: int) -> np.ndarray:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total = total + project(_matrix(batch.column("x"))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["place", "value"])

    summed = fit.select("x").mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    return summed.toArrow().sort_by("place").column("value").to_numpy()


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = 4, scale: int = SCALE) -> DataFrame:
    """One row per vector and component, numbered from 1 by falling eigenvalue.

    Nulls: vectors that are null, empty or hold null or non-finite entries have no rows; a null id is kept. Each distinct
    vector counts once in the fit, whatever its copies; repeated rows are each whitened. Among equal eigenvalues any basis may
    stand, the same for all rows. Directions without variance have no component, so a table of equal vectors gives no rows, as
    does an empty one. Vectors of different lengths are fitted and whitened apart. A deviation beyond a long is null.
    Extra columns are not looked at.
    """
    rows = whole(vectors, scale)
    spark = rows.sparkSession
    fit = staged(rows.select(F.size("x").alias("dim"), "x").distinct(), "whitening")
    dims = [r["dim"] for r in fit.select("dim").distinct().collect()]  # one row per length in use
    fitted = {d: Whitener(fit.filter(F.col("dim") == d), d, components) for d in sorted(dims)}
    release(fit)
    if not fitted:
        return spark.createDataFrame([], _OUT)
    table = spark.sparkContext.broadcast(fitted)  # the square of the dimension at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                f, x = table.value[int(dim)], _matrix(part.column("x"))
                deviation, scores = pa.array(f.deviation(x), pa.int64()), f.whiten(x)
                for k, value in enumerate(f.values):
                    same = [np.full(len(x), z) for z in (f.n, value / f.trace, f.identity_error)]
                    columns = [
                        part.column("vec_id"), pa.array(np.full(len(x), k + 1, dtype=np.int32)), pa.array(same[0], pa.int64()),
                        deviation, pa.array(np.ascontiguousarray(scores[:, k])), pa.array(same[1]), pa.array(same[2]),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    return rows.select("vec_id", F.size("x").alias("dim"), "x").mapInArrow(run, _OUT)
