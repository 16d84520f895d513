"""Nearest neighbours by largest inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample and has a bounded number of leaves; every row is put into a leaf. A query walks the tree with a priority
queue, best centroid first, and visits leaves until their number is that at which calibration queries, compared with
brute force over all rows, reached the wanted recall, and until they hold enough rows. Queries go to the leaves
they visit and are compared with the rows there only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemledger.llm.shared import staged
from stemledger.llm.vectors import by_length, kmeans, matrix, nearest, sound

BRANCHES = 8
LEAVES = 256
#: Queries that calibrate the number of leaves, those with the smallest hashes of their ids.
CALIBRATION = 200
#: Rows and queries that one task compares, about.
ROWS_TOGETHER = 16_384
QUERIES_TOGETHER = 2_048


@dataclass
class Tree:
    """Node i > 0 has a centroid; children by node; leaf number of each node, or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def order(self, query: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves that a best-bin-first walk of this query visits, and more until they hold ``least`` rows."""
        score = self.centres @ query
        queue, found, rows = [(0.0, 0)], [], 0
        while queue and (len(found) < most or rows < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                rows += 0 if held is None else held[self.leaf[node]]
            for child in self.children[node]:
                heapq.heappush(queue, (-score[child], child))
        return found

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by its nearest centroid on every level."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = [n for n in np.unique(node) if self.children[n]]
            if not inner:
                return np.array(self.leaf)[node]
            for n in inner:
                rows = np.flatnonzero(node == n)
                below = np.array(self.children[n])
                node[rows] = below[nearest(x[rows], self.centres[below], False)]


def build(x: np.ndarray, leaves: int = LEAVES) -> Tree:
    """Split the fullest leaf into branches until there are ``leaves``."""
    tree = Tree(np.zeros((1, x.shape[1])), [[]], [0])
    rows, centres = {0: x}, [np.zeros(x.shape[1])]
    while len(rows) + BRANCHES - 1 <= leaves:
        node = max(rows, key=lambda n: len(rows[n]))
        if len(rows[node]) < 4 * BRANCHES:
            break
        part = rows.pop(node)
        found = kmeans(part, BRANCHES, False)
        home = nearest(part, found, False)
        if (home == home[0]).all():
            rows[node] = part[:1]  # equal rows cannot be split
            continue
        for k, c in enumerate(found):
            if not (home == k).any():
                continue  # another centroid is equal
            tree.children[node].append(len(centres))
            rows[len(centres)] = part[home == k]
            centres.append(c)
            tree.children.append([])
    tree.centres = np.stack(centres)
    tree.leaf = [-1] * len(centres)
    for i, node in enumerate(sorted(rows)):
        tree.leaf[node] = i
    return tree


def _top(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's ``k`` best, ties to smaller ids; scores summed pair by pair."""
    s = q @ v.T
    s[qid[:, None] == vid[None, :]] = -np.inf
    if s.shape[1] > k:
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    else:
        floor = np.full(len(s), -np.inf)
    # products of blocks may differ in the last place for equal vectors, so near ties stay in
    floor = np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)
    i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    score = (q[i] * v[j]).sum(axis=1)
    order = np.lexsort((vid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], score[keep]


def _calibrate(rows: DataFrame, queries: pd.DataFrame, trees: dict[int, Tree], k: int, recall: float) -> dict[int, int]:
    """Leaves to visit by length of vectors for ``recall`` on these queries against brute force over all rows of the length."""
    asked = {dim: (matrix(part["embedding"]), part["vec_id"].to_numpy()) for dim, part in queries.groupby("dim")}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if dim in asked:
                    i, j, score = _top(*asked[dim], matrix(part["embedding"]), part["vec_id"].to_numpy(), k)
                    near = part.iloc[j][["vec_id", "leaf"]]
                    yield near.assign(dim=dim, query=i, score=score)[["dim", "query", "vec_id", "leaf", "score"]]

    found = rows.mapInPandas(best, "dim int, query int, vec_id long, leaf int, score double")
    ranked = Window.partitionBy("dim", "query").orderBy(F.desc("score"), "vec_id")
    true = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).toPandas()
    visits = {}
    for dim, part in true.groupby("dim"):
        tree, (q, _) = trees[dim], asked[dim]
        when = np.empty((len(q), tree.leaves), dtype=int)
        for i, query in enumerate(q):
            when[i, tree.order(query, tree.leaves)] = np.arange(1, tree.leaves + 1)
        seen = np.sort(when[part["query"].to_numpy(), part["leaf"].to_numpy()])
        visits[dim] = int(seen[min(len(seen) - 1, int(np.ceil(recall * len(seen))) - 1)])
    return visits


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query, all rows of its length if there are fewer.

    Null, empty and zero vectors, those with null or non-finite components and those without an id take no part. Vectors of each
    length have a tree of their own; a length that the sample lacks is searched whole. A query's own id is no candidate.
    Repeated rows of an id are one candidate and one query, by the largest of the longest vectors.
    Extra columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    parts = by_length(sound(vectors))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trees = {dim: tree for dim, picked in parts if (tree := build(picked)).leaves > 1}  # other lengths are one leaf

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                leaf = trees[dim].place(matrix(part["embedding"])).astype(np.int32) if dim in trees else np.int32(0)
                yield part.assign(leaf=leaf)

    rows = staged(_once(vectors).mapInPandas(put, "vec_id long, embedding array<double>, dim int, leaf int"), "leaves")
    asked = _once(queries)
    counts = rows.groupBy("dim", "leaf").count()
    split = F.col("dim").isin(*trees)
    # leaves of the trees, and fuller ones of other lengths
    sizes = {(r["dim"], r["leaf"]): r["count"] for r in counts.filter(split | (F.col("count") > ROWS_TOGETHER)).collect()}
    held = {dim: np.array([sizes.get((dim, i), 0) for i in range(tree.leaves)]) for dim, tree in trees.items()}
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = asked.filter(split).withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= CALIBRATION).toPandas()
    visits = _calibrate(rows.filter(split), some, trees, k, recall) if len(some) else {}

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            visit = [
                # one row more, as the query itself may be among them
                trees[dim].order(np.asarray(v), visits.get(dim, 1), held[dim], k + 1) if dim in trees else [0]
                for dim, v in zip(batch["dim"], batch["embedding"], strict=True)
            ]
            yield batch.assign(visit=visit)

    walked = staged(asked.mapInPandas(walk, "vec_id long, embedding array<double>, dim int, visit array<int>"), "visits")
    visiting = walked.withColumn("leaf", F.explode("visit")).drop("visit")
    busy = visiting.groupBy("dim", "leaf").count().filter(F.col("count") > QUERIES_TOGETHER).collect()

    # only rows of visited leaves meet a query; what is too much for one task is spread: rows by salt, queries by block
    salts = {at: -(-n // ROWS_TOGETHER) for at, n in sizes.items() if n > ROWS_TOGETHER}
    blocks = {(r["dim"], r["leaf"]): -(-r["count"] // QUERIES_TOGETHER) for r in busy}
    spread = [(*at, salts.get(at, 1), blocks.get(at, 1)) for at in sorted({*salts, *blocks})]
    spread = spark.createDataFrame(spread, "dim int, leaf int, salts int, blocks int")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.join(F.broadcast(spread), ["dim", "leaf"], "left")  # fewer rows than there are groups
        mine = F.pmod(F.xxhash64("vec_id"), F.coalesce(f"{own}s", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1))
        return met.withColumn(own, mine).withColumn(other, every).drop("salts", "blocks")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        q, qid = matrix(left["embedding"]), left["vec_id"].to_numpy()
        v, vid = matrix(right["embedding"]), right["vec_id"].to_numpy()
        out = []
        for at in range(0, len(q), 128):
            part = slice(at, at + 128)
            i, j, score = _top(q[part], qid[part], v, vid, k)
            out.append(pd.DataFrame({"query_id": qid[at + i], "vec_id": vid[j], "score": score}))
        return pd.concat(out)

    key = ["dim", "leaf", "salt", "block"]
    found = (
        dealt(visiting, "block", "salt")
        .groupBy(*key)
        .cogroup(dealt(rows, "salt", "block").groupBy(*key))
        .applyInPandas(compare, "query_id long, vec_id long, score double")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _once(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of sound vectors, one row per id."""
    longest = F.max(F.struct(F.size("embedding").alias("dim"), "embedding")).alias("v")
    return sound(vectors).groupBy("vec_id").agg(longest).select("vec_id", "v.embedding", "v.dim")
