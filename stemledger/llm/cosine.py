"""Near copies among embeddings: spherical k-means cells, and blocked cosine products of cells within reach of each other.

Every vector lives in the cell of its nearest centroid. Two vectors at cosine ``least`` or more are at most ``reach`` apart, so
if a border lies between them, their distances from it add up to ``reach`` at most. Cells are packed into shelves, and large ones
cut by hash over several. A vector visits each shelf with a cell whose border is within ``reach`` of it, and each pair of
shelves is a task of bounded size. There each two cells meet block by block, vectors next to the border first, and only
as far as distances add up to ``reach``: no link over a border is lost, and each pair meets in one task only. Cosines are
bounded by products of half the components before they are computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemledger.llm.shared import components, staged
from stemledger.llm.vectors import by_length, kmeans, nearest, sound, unit

#: Vectors per cell that are aimed at, the most cells, and the most vectors per block.
CELL = 4096
MOST_CELLS = 512
BLOCK = 4096
#: Shelves that are aimed at (of two blocks at least), the most numbers per shelf, and the most tasks.
SHELVES = 16
NUMBERS = 4_000_000
TASKS = 10_000
#: Vectors that meet a block at a time, the share of pairs (1 in so many) up to which a bound on cosines is of use, and
#: numbers that are multiplied at a time where pairs are computed again.
STRIP = 256
FEW = 256
AGAIN = 1_000_000
#: Cosines this close to the threshold are computed again, pair by pair; distances from borders get as much leeway.
CLOSE = 1e-9

_FOUND = pa.schema([(name, pa.int64()) for name in ("vec_id", "links", "a", "b")])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of the same length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, batch.filter(pa.array(dims == dim))


def _centroids(centres: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """A length that the sample does not have is one cell of its own."""
    return centres.get(dim, np.zeros((1, dim)))


def _homes(centres: dict[int, np.ndarray]):
    """Rows with the cell they live in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in _by_length(batches):
            home = nearest(unit(_matrix(rows.column("embedding"))), _centroids(centres, dim), True)
            yield rows.append_column("cell", pa.array(home, pa.int32()))

    return run


def _shelves(sizes: list[tuple[int, int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length of vectors: the first shelf of each cell, and over how many it is cut. ``sizes``: (dim, cell, rows).

    Numbers of shelves go on from one length to the next, so no shelf has vectors of two lengths.
    """
    total, shelf, laid = sum(n for _, _, n in sizes), 0, {}
    for dim, group in groupby(sorted(sizes), key=lambda size: size[0]):
        room = max(1, min(NUMBERS // dim, max(2 * BLOCK, total // SHELVES)))
        cells = [(cell, n) for _, cell, n in group]
        first, cut = np.zeros((2, cells[-1][0] + 1), dtype=np.int64)
        filled = 0
        for cell, n in cells:
            parts = -(-n // room)
            if filled and (parts > 1 or filled + n // 2 > room):
                shelf, filled = shelf + 1, 0
            first[cell], cut[cell] = shelf, parts
            shelf, filled = (shelf + parts, 0) if parts > 1 else (shelf, filled + n)
        shelf += filled > 0
        laid[dim] = first, cut
    return laid


def _visits(centres: dict[int, np.ndarray], laid: dict[int, tuple[np.ndarray, np.ndarray]], reach: float):
    """Rows with their own shelf and all shelves within reach, their own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, rows in _by_length(batches):
            first, cut = laid[dim]
            c = _centroids(centres, dim)[: len(first)]
            v, home, at = unit(_matrix(rows.column("embedding"))), rows.column("cell").to_numpy(), np.arange(rows.num_rows)
            shelf = first[home] + rows.column("deal").to_numpy() % cut[home]
            # distance from v to the border between its cell and another one, times how far their centroids are apart
            score = v @ c.T
            square = (c * c).sum(axis=1)
            apart = np.sqrt(np.maximum(square[:, None] + square - 2 * c @ c.T, 0) + 1e-14)  # not too small by rounding
            near = score[at, home][:, None] - score <= reach * apart[home] + CLOSE
            lowest = first[cut > 0].min()
            holds = np.zeros((len(first), (first + cut).max() - lowest), dtype=np.float32)
            for cell in np.flatnonzero(cut):
                holds[cell, first[cell] - lowest : first[cell] - lowest + cut[cell]] = 1
            reached = near.astype(np.float32) @ holds > 0
            ends = np.concatenate([[0], reached.sum(axis=1).cumsum()])
            places = np.nonzero(reached)[1] + lowest
            visited = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
            yield rows.drop_columns(["dim", "deal"]).append_column("shelf", pa.array(shelf, pa.int32())).append_column("visited", visited)

    return run


def _compare(centres: dict[int, np.ndarray], least: float, reach: float):
    """Of a pair of shelves: links of every vector (copies counted), and edges to the smallest id that the links connect it with."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own = key[0] == key[1]
        rows = rows.sort_by([("shelf", "ascending"), ("cell", "ascending")]).combine_chunks()
        ids, copies, cell, shelf = (rows.column(c).to_numpy() for c in ("vec_id", "copies", "cell", "shelf"))
        x = unit(_matrix(rows.column("embedding").chunk(0)))
        bounds, centre = _bounds(x), _centroids(centres, x.shape[1])
        ends = np.flatnonzero((np.diff(cell) != 0) | (np.diff(shelf) != 0)) + 1
        parts = [slice(a, b) for a, b in zip([0, *ends], [*ends, len(x)], strict=True)]
        links, forest = np.zeros(len(x), dtype=np.int64), _Forest(len(x))
        for p, left in enumerate(parts):
            for right in parts[p:]:
                if own or shelf[left.start] != shelf[right.start]:
                    across = centre[cell[right.start]] - centre[cell[left.start]]
                    for i, j in _linked(x, bounds, left, right, across, least, reach):
                        np.add.at(links, i, copies[j])
                        np.add.at(links, j, copies[i])
                        forest.add(i, j)
        a, b = forest.stars(ids)
        some = np.flatnonzero(links)
        counts = pa.table({"vec_id": ids[some], "links": links[some]})
        return pa.concat_tables([counts, pa.table({"a": a, "b": b})], promote_options="default").select(_FOUND.names).cast(_FOUND)

    return run


def _bounds(x: np.ndarray) -> np.ndarray:
    """The first half of each row and the length of the rest: a product of two such rows is at least that of the whole rows."""
    half = x.shape[1] // 2
    return np.column_stack([x[:, :half], np.sqrt((x[:, half:] ** 2).sum(axis=1))]).astype(np.float32)


def _linked(x: np.ndarray, bounds: np.ndarray, left: slice, right: slice, across: np.ndarray, least: float, reach: float):
    """Places (i, j) of all linked pairs of two cells, or of one; ``across`` leads from the left one's centroid to the right one's.

    Products are taken in single precision, of ``bounds`` as long as these leave few pairs, else of whole rows. Pairs that
    are still in doubt are computed again in double precision.
    """
    doubt = (x.shape[1] + 8) * 2.0**-23  # twice the most that single precision can be off by for rows at length one
    one, width = left == right, math.sqrt(across @ across)
    rows, columns = np.arange(left.start, left.stop), np.arange(right.start, right.stop)
    if not one:
        from_left, from_right = -(x[left] @ across), x[right] @ across  # distances from the border, times width
        near, close = from_left.argsort(), from_right.argsort()
        rows, columns, from_left, from_right = rows[near], columns[close], from_left[near], from_right[close]
    xs, ys, bounded = bounds[rows], bounds[columns], True
    for at in range(0, len(rows), STRIP):
        end = len(columns) if one else np.searchsorted(from_right, reach * width + CLOSE - from_left[at], "right")
        for start in range(at if one else 0, end, BLOCK):
            stop = min(start + BLOCK, end)
            if bounded:
                score = xs[at : at + STRIP] @ ys[start:stop].T
                hit = np.flatnonzero(score >= least - doubt)
                bounded = len(hit) <= score.size // FEW
                sure = np.zeros(len(hit), dtype=bool)
            if not bounded:
                score = x[rows[at : at + STRIP]].astype(np.float32) @ x[columns[start:stop]].astype(np.float32).T
                hit = np.flatnonzero(score >= least - doubt)
                sure = score.ravel()[hit] >= least + doubt
            if len(hit):
                i, j = np.divmod(hit, score.shape[1])
                i, j, unsure = rows[at + i], columns[start + j], np.flatnonzero(~sure)
                together = max(1, AGAIN // x.shape[1])
                for k in range(0, len(unsure), together):
                    some = unsure[k : k + together]
                    sure[some] = _at_least(x[i[some]], x[j[some]], least)
                if one:
                    sure &= i < j
                yield i[sure], j[sure]


def _at_least(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    score = (x * y).sum(axis=1)
    hit = score >= least
    for k in np.flatnonzero(np.abs(score - least) < CLOSE):
        hit[k] = math.fsum(x[k] * y[k]) >= least
    return hit


class _Forest:
    """Of all pairs of ``n`` places only such as connect the same: a place's first partner, and its later partners with that one."""

    def __init__(self, n: int):
        self.n, self.first, self.kept = n, np.full(n, -1), [np.zeros(0, dtype=np.int64)]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        fresh = np.flatnonzero(self.first[j] < 0)
        places, at = np.unique(j[fresh], return_index=True)
        self.first[places] = i[fresh[at]]
        self.kept.append(self.first[places] * self.n + places)
        later = i * self.n + self.first[j]  # mostly the same again and again
        self.kept.append(np.unique(later[np.diff(later, prepend=-1) != 0]))

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, smallest id that is connected with it) of all places that are connected with a smaller one."""
        order = ids.argsort(kind="stable")
        rank = order.argsort()
        a, b = (rank[x] for x in np.divmod(np.unique(np.concatenate(self.kept)), self.n))
        low, before = np.arange(self.n), None
        while before is None or (low != before).any():
            before, least = low, np.minimum(low[a], low[b])
            low = low.copy()
            for x in (a, b, before[a], before[b]):
                np.minimum.at(low, x, least)
            low = low[low]
        some = np.flatnonzero(low < np.arange(self.n))
        return ids[order[some]], ids[order[low[some]]]


def links(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector: pairs at cosine ``least`` or more are linked, no others.

    Null, empty and zero vectors, those with null or non-finite components, and those without an id link with nothing. Vectors
    of different lengths do not link. Equal vectors are compared as one with its number of copies; repeated rows count as copies
    and each gets the result. Extra columns are not looked at; an empty table gives no rows.
    """
    every = vectors.select("vec_id", "embedding")
    kind = "array<float>" if dict(every.dtypes)["embedding"] == "array<float>" else "array<double>"
    good = sound(every, kind)
    key = F.struct(F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(1), "embedding").alias("two"))  # 128 bits
    keyed = good.withColumn("key", key)
    narrow = staged(keyed.select("vec_id", "key"), "vector-keys")
    groups = narrow.groupBy("key").agg(F.min("vec_id").alias("lead"), F.count("*").alias("copies"))
    copied = staged(groups.filter("copies > 1"), "vector-copies")  # few as a rule, so that the others need not be moved
    ones = keyed.join(copied, "key", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    firsts = keyed.join(copied.withColumnRenamed("lead", "vec_id"), ["key", "vec_id"]).dropDuplicates(["key", "vec_id"])
    reps = ones.unionByName(firsts)

    total = narrow.count()
    picked = {}
    for dim, rows in by_length(good):
        picked[dim] = kmeans(unit(rows), min(MOST_CELLS, max(1, -(-total // CELL))), True)
    reach = math.sqrt(2 - 2 * least)
    row = f"vec_id long, copies long, embedding {kind}"
    reps = reps.select(F.size("embedding").alias("dim"), F.xxhash64("vec_id").alias("deal"), "vec_id", "copies", "embedding")
    placed = staged(reps.mapInArrow(_homes(picked), f"dim int, deal long, {row}, cell int"), "cells")
    laid = _shelves([tuple(r) for r in placed.groupBy("dim", "cell").count().collect()])
    per_length = [int((first + cut).max() - first[cut > 0].min()) for first, cut in laid.values()]
    tasks = min(TASKS, max(1, sum(n * (n + 1) // 2 for n in per_length)))
    rows = placed.mapInArrow(_visits(picked, laid, reach), f"{row}, cell int, shelf int, visited array<int>")
    rows = rows.withColumn("other", F.explode("visited")).drop("visited")
    pairs = rows.select("*", F.least("shelf", "other").alias("low"), F.greatest("shelf", "other").alias("high")).drop("other")
    pairs = pairs.repartition(tasks, "low", "high").groupBy("low", "high")
    met = pairs.applyInArrow(_compare(picked, least, reach), "vec_id long, links long, a long, b long")
    found = staged(met.hint("rebalance"), "cosine-links")  # a few rows of each of many tasks
    counts = found.filter("vec_id is not null").groupBy(F.col("vec_id").alias("lead")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("a is not null").select("a", "b"), "cosine").withColumnRenamed("node", "lead")
    linked = counts.join(parts, "lead", "left")
    led = narrow.join(copied, "key", "left").select(
        "vec_id", F.coalesce("lead", "vec_id").alias("lead"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    per_id = led.join(linked, "lead", "left").groupBy("vec_id").agg(
        F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.min(F.coalesce("component", "lead")).alias("component_id"),
    )
    out = every.select("vec_id").join(per_id, "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
