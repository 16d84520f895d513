"""Exact Jaccard self-join of documents on word shingles, by signature trees.

1. Copies of a text are one class. Of each class the shingle hashes are taken once, and of these the smaller half in hash order goes into
   buckets, packed as arrays. Two sets that are similar enough share a known least number of that half, so a document stays only if
   enough of it also stands in other classes; most documents leave here.
2. The rarest shared shingles of those that stay tie them into coarse groups: linked documents are always in one group.
3. Each group is joined by a tree whose nodes hold OR-combined bitmaps and size ranges; pairs of nodes are visited together and left
   when the largest possible overlap is too small. Pairs of documents that remain are compared exactly. A large group is cut
   into chunks, and pairs of chunks are tasks of their own, so no task holds a whole group.

All of this is exact whatever the hash order and sizes; there is no cap on group, bucket or candidates.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemledger.llm.shared import components, staged

WORDS = 5
#: Link if PARTS * intersection >= LEAST * union.
LEAST, PARTS = 75, 100
#: Shingles a map task packs at once, and bytes of text per bucket.
PACKED_TOGETHER = 3_000_000
TEXT_PER_BUCKET = 12_000_000
#: A shingle met so often in one pack is common for sure; its places are settled there and only one note goes to its bucket.
OFTEN = 32
COMMON = 1 << 30
#: Documents of a group that one task holds per side.
CHUNK = 1024
BITS = 2048
FANOUT = 8
PAIRS_TOGETHER = 4096
#: Bits of the bitmap of documents in coarse groups; it is broadcast, so its size is fixed.
BITMAP = 1 << 24

TOKEN = np.dtype([("hash", "<u8"), ("doc", "<u4")])
COUNTED = np.dtype([("hash", "<u8"), ("doc", "<u4"), ("df", "<u4")])
PLACE = np.dtype([("hash", "<u8"), ("doc", "<i8")])
NOTE = np.uint32(0xFFFFFFFF)


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of ``n`` must share with any set it links to."""
    return -(-LEAST * n // PARTS)


def taken(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the smallest hashes of a set go into buckets, and how many of them any linked set shares.

    Of sets with k1 and k2 hashes beyond the least overlap left out, the first n - needed + l of each share l at least.
    """
    extra = np.maximum(1, n // 4)
    smallest_partner = -(-LEAST * n // PARTS)
    return np.minimum(n, n - needed(n) + extra), np.minimum(extra, np.maximum(1, smallest_partner // 4))


class Hasher(dict):
    """64-bit hashes of words, kept for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(texts: list[str | None], known: Hasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are lower-cased, words end at ASCII white space."""
    out = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not words:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        ids = np.array(array("Q", map(known.__getitem__, words)), dtype=np.uint64)
        m = len(ids) - WORDS + 1
        if m < 1:
            value = np.array([len(ids)], dtype=np.uint64)
            for x in ids:
                value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(value)
            continue
        value = ids[:m].copy()
        for k in range(1, WORDS):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m]
        out.append(np.unique(_mix(value)))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packer(buckets: int):
    """Texts to packs: per bucket the (hash, place in the pack) of the taken shingles, and one row on the pack's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, size, part = Hasher(), [], 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            rid = np.array([r for r, _ in held], dtype=np.int64)
            n = np.array([len(s) for _, s in held], dtype=np.int64)
            k, _ = taken(n)
            tokens = np.empty(int(k.sum()), dtype=TOKEN)
            tokens["hash"] = np.concatenate([s[:x] for (_, s), x in zip(held, k, strict=True)])
            tokens["doc"] = np.repeat(np.arange(len(held)), k)
            tokens.sort(order="hash", kind="stable")
            first = np.flatnonzero(np.append(True, tokens["hash"][1:] != tokens["hash"][:-1]))
            times = np.diff(np.append(first, len(tokens)))
            often = np.repeat(times >= OFTEN, times)
            settled = tokens[often]
            notes = tokens[first[times >= OFTEN]]
            notes["doc"] = NOTE
            sent = np.concatenate([tokens[~often], notes])
            of = (sent["hash"] >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(buckets + 1))
            sent, pack = sent[order], f"{task}-{part}"
            rows = [
                (b, pack, sent[cut[b] : cut[b + 1]].tobytes(), None, None) for b in range(buckets) if cut[b] < cut[b + 1]
            ]
            rows.append((hash(part) % buckets, pack, settled.tobytes(), rid.tobytes(), n.tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "pack", "tokens", "rids", "sizes"])

        for batch in batches:
            for rid, text in zip(batch["rid"], batch["text"], strict=True):
                found = shingles([text], known)[0]
                held.append((rid, found))
                size += len(found)
                if size >= PACKED_TOGETHER:
                    yield flush()
                    held, size, part = [], 0, part + 1
        if held:
            yield flush()

    return run


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """Shingles of a bucket that more than one class has, back to their packs with the number of classes."""
    about = group[group["rids"].notna()]
    rows = [(p, t, r, s) for p, t, r, s in zip(about["pack"], about["tokens"], about["rids"], about["sizes"], strict=True)]
    packs = group[group["rids"].isna()]
    parts = [np.frombuffer(t, dtype=TOKEN) for t in packs["tokens"]]
    if parts:
        tokens = np.concatenate(parts)
        pack = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(tokens["hash"], kind="stable")
        tokens, pack = tokens[order], pack[order]
        first = np.flatnonzero(np.append(True, tokens["hash"][1:] != tokens["hash"][:-1]))
        times = np.diff(np.append(first, len(tokens)))
        note = np.logical_or.reduceat(tokens["doc"] == NOTE, first)
        df = np.repeat(np.where(note, COMMON, times), times)
        keep = (df > 1) & (tokens["doc"] != NOTE)
        out = np.empty(int(keep.sum()), dtype=COUNTED)
        out["hash"], out["doc"], out["df"] = tokens["hash"][keep], tokens["doc"][keep], df[keep]
        pack = pack[keep]
        order = np.argsort(pack, kind="stable")
        cut = np.searchsorted(pack[order], np.arange(len(parts) + 1))
        out, names = out[order], list(packs["pack"])
        rows += [(names[i], out[cut[i] : cut[i + 1]].tobytes(), None, None) for i in range(len(parts)) if cut[i] < cut[i + 1]]
    return pd.DataFrame(rows, columns=["pack", "tokens", "rids", "sizes"])


def _sift(buckets: int):
    """Of a pack: the size of every document, the rarest shared shingles of those that can link, by bucket and each once for
    its smallest document, and edges from the other documents to that one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        about = group[group["rids"].notna()].iloc[0]
        rid, n = np.frombuffer(about["rids"], dtype=np.int64), np.frombuffer(about["sizes"], dtype=np.int64)
        settled = np.frombuffer(about["tokens"], dtype=TOKEN)
        own = np.empty(len(settled), dtype=COUNTED)
        own["hash"], own["doc"], own["df"] = settled["hash"], settled["doc"], COMMON
        parts = [np.frombuffer(t, dtype=COUNTED) for t in group.loc[group["rids"].isna(), "tokens"]]
        tokens = np.concatenate([own, *parts])
        _, least = taken(n)
        shared = np.bincount(tokens["doc"], minlength=len(n))
        stays = (shared >= least) & (n > 0)
        tokens = tokens[stays[tokens["doc"]]]
        tokens = tokens[np.lexsort((tokens["hash"], tokens["df"], tokens["doc"]))]
        start = np.concatenate([[0], np.cumsum(np.bincount(tokens["doc"], minlength=len(n)))[:-1]])
        nth = np.arange(len(tokens)) - start[tokens["doc"]]
        tokens = tokens[nth < (shared - least + 1)[tokens["doc"]]]
        places = np.empty(len(tokens), dtype=PLACE)
        places["hash"], places["doc"] = tokens["hash"], rid[tokens["doc"]]
        places, edges = _led(places)  # one place a shingle leaves the pack
        of = (places["hash"] >> np.uint64(40)) % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(buckets + 1))
        places = places[order]
        held = [(b, places[cut[b] : cut[b + 1]].tobytes()) for b in range(buckets) if cut[b] < cut[b + 1]]
        none, tied = [None] * len(held), [None] * len(edges)
        return pd.DataFrame(
            {
                "rid": pd.array([*rid, *none, *tied], dtype="Int64"),
                "n": pd.array([*n, *none, *tied], dtype="Int64"),
                "bucket": pd.array([None] * len(rid) + [b for b, _ in held] + tied, dtype="Int32"),
                "places": [None] * len(rid) + [p for _, p in held] + tied,
                "a": pd.array([None] * len(rid) + none + list(edges[:, 0]), dtype="Int64"),
                "b": pd.array([None] * len(rid) + none + list(edges[:, 1]), dtype="Int64"),
            }
        )

    return run


def _led(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the smallest document of every shingle, and edges from the other documents to it."""
    places = places[np.lexsort((places["doc"], places["hash"]))]
    first = np.flatnonzero(np.append(True, places["hash"][1:] != places["hash"][:-1])[: len(places)])
    lead = np.repeat(places["doc"][first], np.diff(np.append(first, len(places))))
    edges = np.unique(np.stack([places["doc"], lead], axis=1), axis=0)
    return places[first], edges[edges[:, 0] != edges[:, 1]]


def _tie(group: pd.DataFrame) -> pd.DataFrame:
    """Edges from documents with a shingle of this bucket to the smallest document that has it."""
    places = np.concatenate([np.frombuffer(p, dtype=PLACE) for p in group["places"]])
    return pd.DataFrame(_led(places)[1], columns=["a", "b"])


class Tree:
    """Signature tree over sets, in the order of their smallest hashes so that like sets stand together."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = np.array([len(s) for s in sets], dtype=np.int64)
        bits = np.zeros((len(sets), BITS // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            at = (s % np.uint64(BITS)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, loose = self.levels[-1]
            cut = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(b, cut),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(loose, cut),
                )
            )


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some set below node i can overlap some set below node j enough."""
    bx, lx, hx, sx = (v[i] for v in x)
    by, ly, hy, sy = (v[j] for v in y)
    sizes = (PARTS * hx >= LEAST * ly) & (PARTS * hy >= LEAST * lx)
    overlap = np.bitwise_count(bx & by).sum(axis=1, dtype=np.int64) + np.minimum(sx, sy)
    return sizes & ((LEAST + PARTS) * np.minimum(overlap, np.minimum(hx, hy)) >= LEAST * (lx + ly))


def tree_links(one: list[np.ndarray], other: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Edges that connect just what the linked pairs of sets connect: within ``one``, or between ``one`` and ``other``.

    Both trees are walked together from their roots. Pairs already connected are not compared.
    """
    x = Tree(one)
    y = x if other is None else Tree(other)
    if not x.sets or not y.sets:
        return []
    parent = np.arange(len(x.sets) + (0 if other is None else len(y.sets)))
    shift = 0 if other is None else len(x.sets)
    found: list[tuple[int, int]] = []

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    top = max(len(x.levels), len(y.levels)) - 1
    stack = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS_TOGETHER:
            half = len(i) // 2
            stack += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
            continue
        lx, ly = x.levels[min(level, len(x.levels) - 1)], y.levels[min(level, len(y.levels) - 1)]
        keep = _possible(lx, ly, i, j)
        i, j = i[keep], j[keep]
        if level:
            i, j = _children(i, j, FANOUT if level < len(x.levels) else 1, FANOUT if level < len(y.levels) else 1)
            nx, ny = (len(t.levels[min(level - 1, len(t.levels) - 1)][1]) for t in (x, y))
            keep = (i < nx) & (j < ny) & ((i <= j) if other is None else True)
            if level == 1 and other is None:
                keep &= i != j
            i, j = i[keep], j[keep]
            if len(i):
                stack.append((level - 1, i, j))
            continue
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ra, rb = root(a), root(b + shift)
            if ra != rb and _linked(x.sets[a], y.sets[b]):
                parent[max(ra, rb)] = min(ra, rb)
                found.append((a, b))
    return found


def _children(i: np.ndarray, j: np.ndarray, fx: int, fy: int) -> tuple[np.ndarray, np.ndarray]:
    a = (i[:, None] * fx + np.arange(fx)).repeat(fy, axis=1)
    b = np.tile(j[:, None] * fy + np.arange(fy), (1, fx))
    return a.ravel(), b.ravel()


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return PARTS * both >= LEAST * (len(a) + len(b) - both)


def _join(group: pd.DataFrame) -> pd.DataFrame:
    """Edges of all chunk pairs that came to this task."""
    edges = []
    for (_, i, j), rows in group.groupby(["unit", "i", "j"]):
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        rid, side = rows["rid"].to_numpy(), rows["side"].to_numpy()
        order = sorted(range(len(sets)), key=lambda k: (sets[k][0], len(sets[k]), rid[k]))
        left = [k for k in order if side[k] == 0]
        right = [k for k in order if side[k] == 1]
        pairs = tree_links([sets[k] for k in left], None if i == j else [sets[k] for k in right])
        to = left if i == j else right
        edges += [(rid[left[a]], rid[to[b]]) for a, b in pairs]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = Hasher()
    for batch in batches:
        sets = shingles(list(batch["text"]), known)
        yield batch.drop(columns="text").assign(shingles=[s.tobytes() for s in sets])


def _likely(given: DataFrame, members: DataFrame) -> DataFrame:
    """``given`` without most rows that are not members, by a bitmap of fixed size: their texts need not be moved.

    A row whose bit another member set stays; the join behind drops it.
    """
    at = F.pmod(F.xxhash64("rid"), F.lit(BITMAP))
    bits = members.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )  # BITMAP bits in all
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = given.withColumn("part", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "part")
    return met.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select(*given.columns)


def join(docs: DataFrame) -> DataFrame:
    """(text_hash, n_shingles, component_id) per distinct text of documents with an id.

    ``text_hash`` is the MD5 of the text; component_id is the smallest id reachable. A null text, and one without words, has no shingles
    and no class here. Rows with one id are one document of several texts. Extra columns are not looked at; an empty table gives no rows.
    """
    given = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("rid"), "text")
    given = given.withColumn("text_hash", F.md5(F.col("text").cast("binary")))
    first = Window.partitionBy("text_hash").orderBy("rid")
    reps = given.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, size // TEXT_PER_BUCKET)
    packs = reps.select("rid", "text").mapInPandas(
        _packer(buckets), "bucket int, pack string, tokens binary, rids binary, sizes binary"
    )
    counted = packs.groupBy("bucket").applyInPandas(_count, "pack string, tokens binary, rids binary, sizes binary")
    sifted = staged(
        counted.groupBy("pack").applyInPandas(
            _sift(buckets), "rid long, n long, bucket int, places binary, a long, b long"
        ),
        "sifted",
    )
    led = sifted.filter("bucket is not null").select("bucket", "places")
    ties = led.groupBy("bucket").applyInPandas(_tie, "a long, b long")
    ties = ties.union(sifted.filter("a is not null").select("a", "b"))
    coarse = components(ties, "coarse").withColumnsRenamed({"node": "rid", "component": "unit"})

    sizes = coarse.groupBy("unit").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = staged(coarse.join(sizes, "unit"), "members")
    tasks = max(8, -(-members.count() // CHUNK))
    known = _likely(given, members).join(members, "rid").select("rid", "text_hash", "text", "unit", "chunks")
    # one row per class again: the copies of a text have other ids and no unit
    sets = known.dropDuplicates(["rid", "text_hash"]).select("rid", "unit", "chunks", "text").mapInPandas(
        _shingled, "rid long, unit long, chunks int, shingles binary"
    )
    mine = F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int")
    spread = sets.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select(
        "unit", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"),
        F.when(F.col("mine") > F.col("with"), 1).otherwise(0).alias("side"), "rid", "shingles",
        F.when(F.col("chunks") > 1, F.xxhash64("unit", F.least("mine", "with"), F.greatest("mine", "with")))
        .otherwise(F.pmod(F.xxhash64("unit"), F.lit(tasks))).alias("task"),
    )
    edges = spread.groupBy("task").applyInPandas(_join, "a long, b long")
    linked = components(edges, "linked").withColumnRenamed("node", "rid")
    smallest = given.groupBy("text_hash").agg(F.min("rid").alias("rid"))
    out = smallest.join(sifted.filter("rid is not null and n > 0").select("rid", "n").distinct(), "rid", "left")
    return out.join(linked, "rid", "left").select(
        "text_hash",
        F.coalesce("n", F.lit(0)).alias("n_shingles"),
        F.coalesce("component", "rid").alias("component_id"),
    )


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_shingles`` and ``component_id`` (columns of these names are replaced).

    A document without text or words is its own component; one without an id has that of its text's class, or null.
    """
    found = join(docs).select(
        F.col("text_hash").alias("_hash"), F.col("n_shingles").alias("_n"), F.col("component_id").alias("_component")
    )
    rows = docs.drop("n_shingles", "component_id").withColumn("_hash", F.md5(F.col("text").cast("binary")))
    out = rows.join(found, "_hash", "left")
    lonely = F.coalesce("_n", F.lit(0)) == 0
    return out.withColumn("n_shingles", F.coalesce("_n", F.lit(0)).cast("long")).withColumn(
        "component_id", F.when(lonely, F.col("doc_id")).otherwise(F.col("_component"))
    ).drop("_hash", "_n", "_component")


def survivors(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies, that with the smallest id; groups of one stay.

    Repeated rows of the one that stays are one row; a document without an id stays.
    """
    kept = classes(docs).filter("doc_id is null or component_id = doc_id").drop("n_shingles", "component_id")
    nth = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.col("text"))
    same = kept.filter("doc_id is not null").withColumn("_nth", F.row_number().over(nth)).filter("_nth = 1").drop("_nth")
    return same.unionByName(kept.filter("doc_id is null"))
