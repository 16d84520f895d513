"""Removal of repeated byte strings by hash-compared suffix sorting.

1. Anchors: in every window of ``WINDOW`` bytes the piece of ``PIECE`` bytes with the smallest hash is chosen, so equal
   windows have equal anchors at equal places. Anchors that stand at one place of one text only are dropped; most of a corpus leaves here.
2. Around each remaining anchor the segment of its windows is cut out. Equal segments are one, with a count.
3. Per anchor, the suffixes that start at the windows are sorted by mergesort (a frequent anchor's segments in slices, those
   of frequent bytes as single windows, which are told apart by digest alone). Two suffixes are compared by binary search for
   their common extension on prefix polynomial hashes, then by the byte behind it. Neighbours that agree on
   a whole window are repeats; their bytes are compared to rule out collisions.
4. Covered stretches go back to the texts by join, and are removed.

Copies of a text are one text with a count: with two or more, every window of it is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemledger.llm.shared import staged

WINDOW = 400
PIECE = 200
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TOGETHER = 1_000_000
#: Segments that one task sorts, about, and suffixes that it sorts at once.
SEGMENTS_TOGETHER = 2_000
SUFFIXES_TOGETHER = 300_000
#: Anchors with more distinct segments than this are dealt out further, by the bytes that SLICE windows share, and those
#: bytes, if they have more distinct surroundings than this, by single windows.
FREQUENT = 4_000
SLICE = 25
#: Rows that a map task holds before it hands them on.
ROWS_TOGETHER = 10_000


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Prefix polynomial hashes of a buffer: the hash of any stretch in a few operations."""

    def __init__(self, data: np.ndarray):
        self.data = data
        terms = (data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over x[i : i + width] for every i where that fits."""
    reach = 1
    while 2 * reach <= width:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place of the anchor, first and last window that chose it, hash) of texts; places within their text."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = np.repeat(begin + size, size) - np.arange(len(data))  # bytes from here to the end of the text
    hashes = Hashes(data)
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.arange(len(data) - PIECE + 1)
    h = np.minimum(mixed(hashes.of(at, PIECE)), most - np.uint64(1))
    h[left[: len(h)] < PIECE] = most
    width = WINDOW - PIECE + 1
    low = _slide(h, width, np.minimum)
    fits = left[: len(low)] >= WINDOW
    # windows one after another with the same smallest hash are a run
    cut = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (fits[1:] != fits[:-1])]))
    last = np.append(cut[1:], len(low)) - 1
    cut, last = cut[fits[cut]], last[fits[cut]]
    # a run may also go over the end of a text: windows of two texts are never both whole there, so it does not
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), np.where(fits, low, 0), np.zeros(width - 1, dtype=np.uint64)])
    place = np.flatnonzero((h == _slide(padded, width, np.maximum)[: len(h)]) & (h != most))
    a, b = np.searchsorted(place, cut), np.searchsorted(place, last + width - 1, side="right")
    run = np.repeat(np.arange(len(cut)), b - a)
    p = place[np.arange(len(run)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[run]]
    same = h[p] == low[cut[run]]
    run, p = run[same], p[same]
    first, final = np.maximum(cut[run], p - width + 1), np.minimum(last[run], p)
    ok = first <= final
    p, first, final = p[ok], first[ok], final[ok]
    text = np.searchsorted(begin, p, side="right") - 1
    # empty texts share their beginning with the next one, which is the later index
    return text, p - begin[text], first - begin[text], final - begin[text], h[p]


def repeated(segments: list[bytes], ahead: np.ndarray, back: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the largest and smallest distance from its anchor back to a repeated window; -1 if there is none.

    ``ahead`` is the distance from the anchor back to the segment's first window, ``back`` that to its last.
    """
    n = len(segments)
    far, near = np.full(n, -1, dtype=np.int64), np.full(n, WINDOW + 1, dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum([len(s) for s in segments])[:-1]]).astype(np.int64)
    hashes = Hashes(np.frombuffer(b"".join(segments), dtype=np.uint8))
    _, group = np.unique(anchor, return_inverse=True)
    step = max(1, SUFFIXES_TOGETHER // max(1, n))
    for low in range(0, WINDOW - PIECE + 1, step):  # suffixes at different distances are never compared
        high = np.minimum(ahead, low + step - 1)
        some = np.flatnonzero(np.maximum(back, low) <= high)
        if len(some):
            first = offset[some] + ahead[some] - high[some]
            _mark(hashes, some, first, high[some], np.maximum(back, low)[some], group[some], far, near)
    near[far < 0] = -1
    return far, near


def _mark(hashes: Hashes, which: np.ndarray, first: np.ndarray, ahead: np.ndarray, back: np.ndarray, group: np.ndarray, far: np.ndarray, near: np.ndarray) -> None:
    """Widen ``far`` and ``near`` of segments ``which`` by their repeated windows from ``ahead`` to ``back``."""
    count = ahead - back + 1
    seg = np.repeat(np.arange(len(which)), count)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start, distance = first[seg] + nth, ahead[seg] - nth
    # suffixes are only compared within one anchor and one distance
    key = group[seg] * (WINDOW + 1) + distance
    met = _met_twice(mixed(hashes.of(start, WINDOW) ^ mixed(key.astype(np.uint64))))
    key, start, seg, distance = key[met], start[met], seg[met], distance[met]
    order = np.argsort(key, kind="stable")
    key, start, seg, distance = key[order], start[order], seg[order], distance[order]
    base = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(base, len(key)))
    several = np.repeat(size > 1, size)
    start, seg, distance = start[several], seg[several], distance[several]
    size = size[size > 1]
    if not len(size):
        return
    base = np.repeat(np.cumsum(size) - size, size)
    size = np.repeat(size, size)
    order = _mergesort(hashes, start, base, size)
    start, seg, distance = start[order], seg[order], distance[order]
    whole = hashes.of(start, WINDOW)
    equal = (base[1:] == base[:-1]) & (whole[1:] == whole[:-1])
    pair = np.flatnonzero(equal)
    pair = pair[_verified(hashes.data, start, seg, distance, pair)]
    hit = np.zeros(len(start), dtype=bool)
    hit[pair] = hit[pair + 1] = True
    np.maximum.at(far, which[seg[hit]], distance[hit])
    np.minimum.at(near, which[seg[hit]], distance[hit])


def _met_twice(hashes: np.ndarray) -> np.ndarray:
    """Where a hash may stand that stands elsewhere too: all of these and, as buckets are few, some others.

    A window whose hash occurs once equals no other one, so its suffix need not be sorted.
    """
    bits = np.uint64(max(1, int(8 * len(hashes)).bit_length()))
    bucket = (hashes >> (np.uint64(64) - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(bucket)[bucket] > 1) if len(hashes) else np.zeros(0, dtype=np.int64)


def _mergesort(hashes: Hashes, start: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes within their classes (``base``: first place of the class, ``size``: its members).

    All runs of a width are merged at once: each suffix finds its rank in the neighbouring run by binary search.
    """
    order = np.arange(len(start))
    whole = hashes.of(start, WINDOW)
    width = 1
    while width < size.max():
        at = np.arange(len(order)) - base
        run = at // width
        other = (run ^ 1) * width
        low = np.minimum(other, size)
        high = np.minimum(other + width, size)
        first_run = run % 2 == 0
        lo, hi = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            x, y = order[open_], order[base[open_] + mid]
            sign = _compare(hashes, start, whole, y, x)
            # equal suffixes keep their order: those of the left run come first
            below = np.where(first_run[open_], sign < 0, sign <= 0)
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        place = base + (run & ~1) * width + (at - run * width) + (lo - low)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def _compare(hashes: Hashes, start: np.ndarray, whole: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the window at suffix x is less than, equal to or greater than that at y."""
    sign = np.zeros(len(x), dtype=np.int8)
    differ = np.flatnonzero(whole[x] != whole[y])
    a, b = start[x[differ]], start[y[differ]]
    lo, hi = np.zeros(len(a), dtype=np.int64), np.full(len(a), WINDOW - 1, dtype=np.int64)
    while len(a) and (lo < hi).any():  # the common extension lies between lo and hi
        mid = (lo + hi + 1) // 2
        same = hashes.of(a, mid) == hashes.of(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    sign[differ] = np.where(hashes.data[a + lo] < hashes.data[b + lo], -1, 1)
    return sign


def _verified(data: np.ndarray, start: np.ndarray, seg: np.ndarray, distance: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which neighbours have equal bytes. Windows one after another of the same two segments are compared as one stretch."""
    if not len(pair):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((-distance[pair], seg[pair + 1], seg[pair]))
    p = pair[order]
    cut = np.concatenate(
        [[True], (seg[p][1:] != seg[p][:-1]) | (seg[p + 1][1:] != seg[p + 1][:-1]) | (distance[p][1:] != distance[p][:-1] - 1)]
    )
    first = np.flatnonzero(cut)
    runs = np.diff(np.append(first, len(p)))
    good = np.zeros(len(runs), dtype=bool)
    for block in range(0, len(runs), 2000):
        part = slice(block, block + 2000)
        length = runs[part] + WINDOW - 1
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        a = np.repeat(start[p[first[part]]], length) + within
        b = np.repeat(start[p[first[part]] + 1], length) + within
        good[part] = np.logical_and.reduceat(data[a] == data[b], np.cumsum(length) - length)
    out = np.empty(len(pair), dtype=bool)
    out[order] = np.repeat(good, runs)
    # a stretch with a collision in it is compared window by window
    for k in np.flatnonzero(~out):
        a, b = start[pair[k]], start[pair[k] + 1]
        out[k] = (data[a : a + WINDOW] == data[b : b + WINDOW]).all()
    return out


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors of texts; a text longer than TOGETHER goes in blocks that overlap, so that each window is whole in one."""
    for batch in batches:
        held, size, keys, begins = [], 0, [], []

        def flush() -> pd.DataFrame:
            text, place, first, last, h = anchors(held)
            return pd.DataFrame(
                {
                    "anchor": h.view(np.int64),
                    "text_hash": np.array(keys, dtype=object)[text],
                    "place": (place + np.array(begins, dtype=np.int64)[text]).astype(np.int32),
                    "ahead": (place - first).astype(np.int16),
                    "back": (place - last).astype(np.int16),
                }
            )

        for key, text in zip(batch["text_hash"], batch["text"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for begin in range(0, max(1, len(data) - WINDOW + 1), TOGETHER):
                held.append(data[begin : begin + TOGETHER + WINDOW - 1])
                keys.append(key)
                begins.append(begin)
                size += len(held[-1])
                if size > TOGETHER:
                    yield flush()
                    held, size, keys, begins = [], 0, [], []
        if held:
            yield flush()


def _cut_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per anchor its segment's digest; the segment's bytes only where they are first met in a while."""
    names = ["anchor", "text_hash", "place", "ahead", "back", "segment", "bytes"]
    seen, rows = set(), []
    for batch in batches:
        for key, text, found in zip(batch["text_hash"], batch["text"], batch["found"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for a in found:
                anchor, place, ahead, back = a["anchor"], a["place"], a["ahead"], a["back"]
                segment = data[place - ahead : place - back + WINDOW]
                name = _named(segment, anchor, ahead, back)
                rows.append((anchor, key, place, ahead, back, name, None if name in seen else segment))
                seen.add(name)
                if len(rows) > ROWS_TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    seen, rows = set(), []
    yield pd.DataFrame(rows, columns=names)


def _named(data: bytes, anchor: int, ahead: int, back: int) -> bytes:
    return hashlib.blake2b(data + b"%d %d %d" % (anchor, ahead, back), digest_size=16).digest()


def _slices(width: int):
    """Segments into slices of ``width`` distances, with the hash of the bytes that all windows of a slice share.

    Equal windows lie in slices that share these bytes, so they still meet. The slice's bytes are
    given only where they are first met in a while.
    """
    names = ["anchor", "segment", "ahead", "back", "slice", "bytes", "deal"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = set(), []
        for batch in batches:
            given = zip(batch["anchor"], batch["ahead"], batch["back"], batch["segment"], batch["bytes"], strict=True)
            for anchor, ahead, back, segment, data in given:
                for low in range(back - back % width, ahead + 1, width):
                    far, near = min(ahead, low + width - 1), max(back, low)
                    part = data[ahead - far : ahead - near + WINDOW]
                    name = _named(part, anchor, far, near)
                    core = data[ahead - low : ahead - low - width + 1 + WINDOW]
                    deal = int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True)
                    rows.append((anchor, segment, far, near, name, None if name in seen else part, deal))
                    seen.add(name)
                if len(rows) > ROWS_TOGETHER:
                    yield pd.DataFrame(rows, columns=names)
                    seen, rows = set(), []
        yield pd.DataFrame(rows, columns=names)

    return run


def _sorted(group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates(["segment", "ahead"])
    ahead, back = group["ahead"].to_numpy(dtype=np.int64), group["back"].to_numpy(dtype=np.int64)
    far, near = repeated(list(group["bytes"]), ahead, back, group["anchor"].to_numpy())
    hit = far >= 0
    return pd.DataFrame({"segment": group["segment"][hit], "far": far[hit], "near": near[hit]})


def _sliced(segments: DataFrame, width: int) -> DataFrame:
    return segments.select("anchor", "segment", "ahead", "back", "bytes").mapInPandas(
        _slices(width), "anchor long, segment binary, ahead short, back short, slice binary, bytes binary, deal long"
    )


def _widest(found: DataFrame) -> DataFrame:
    """(segment, far, near) with one row per segment: the repeated windows between lie over the anchor, without a gap."""
    return found.groupBy("segment").agg(F.max("far").alias("far"), F.min("near").alias("near"))


def _met_again(slices: DataFrame, found: DataFrame | None) -> DataFrame:
    """(segment, far, near) of what the segments' slices tell: ``found`` within slices, and slices that two segments have."""
    ends = F.max("ahead").cast("int").alias("far"), F.min("back").cast("int").alias("near")
    shared = slices.groupBy("slice").agg(F.min("segment").alias("a"), F.max("segment").alias("b"), *ends)
    shared = shared.filter("a != b").select("slice", "far", "near")
    if found is not None:
        shared = shared.union(found.select(F.col("segment").alias("slice"), "far", "near"))
    shared = staged(shared, "shared")  # as for ``common``: a slice of many segments can be split
    return slices.select("segment", "slice").join(shared, "slice").select("segment", "far", "near")


def spans(docs: DataFrame) -> DataFrame:
    """(text_hash, spans) of texts that have repeated windows; spans are array<struct<start, end>> in bytes, not yet merged."""
    given = docs.filter("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), "text")
    given = given.filter(F.octet_length("text") >= WINDOW)
    texts = given.groupBy("text_hash").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"))
    copied = texts.filter("copies > 1").select("text_hash")
    rows = given.mapInPandas(_anchor_rows, "anchor long, text_hash string, place int, ahead short, back short")
    rows = staged(rows, "anchors")
    where = F.xxhash64("text_hash", "place")
    common = rows.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a != b").select("anchor")
    common = staged(common, "common")  # the join is then not tied to the aggregate's tasks, and a frequent anchor can be split
    # texts with copies are covered whole, but still make their windows repeats elsewhere
    found = rows.join(common, "anchor", "left_semi").groupBy("text_hash").agg(
        F.collect_set(F.struct("anchor", "place", "ahead", "back")).alias("found")
    )
    lead = found.join(texts, "text_hash")
    to_cut = given.join(lead.select("text_hash", "lead", "found"), "text_hash").filter("doc_id <=> lead")
    segments = staged(
        to_cut.select("text_hash", "text", "found").mapInPandas(
            _cut_segments,
            "anchor long, text_hash string, place int, ahead short, back short, segment binary, bytes binary",
        ),
        "segments",
    )
    kept = segments.filter("bytes is not null").select("anchor", "ahead", "back", "segment", "bytes")
    kept = kept.dropDuplicates(["segment"])  # each map task has given the bytes
    frequent = (
        segments.select("anchor", "segment").distinct().groupBy("anchor").count().filter(F.col("count") > FREQUENT)
    )
    frequent = staged(frequent.select("anchor"), "frequent")
    plain = kept.join(frequent, "anchor", "left_anti").withColumn("deal", F.col("anchor"))
    slices = staged(_sliced(kept.join(frequent, "anchor", "left_semi"), SLICE), "slices")
    cores = slices.select("deal", "slice").distinct().groupBy("deal").count().filter(F.col("count") > FREQUENT)
    cores = staged(cores.select("deal"), "cores")
    parts = slices.filter("bytes is not null").drop("segment").withColumnRenamed("slice", "segment")
    parts = parts.dropDuplicates(["segment"])
    windows = _sliced(parts.join(cores, "deal", "left_semi"), 1).drop("bytes", "deal")
    windows = staged(windows, "windows")
    to_sort = plain.unionByName(parts.join(cores, "deal", "left_anti"))
    given_bytes = segments.filter("bytes is not null").count() + slices.filter("bytes is not null").count()
    tasks = max(8, -(-given_bytes // SEGMENTS_TOGETHER))
    sorted_ = staged(
        to_sort.withColumn("task", F.pmod(F.xxhash64("deal"), F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(_sorted, "segment binary, far int, near int"),
        "sorted",
    )
    # back from windows to slices, and from slices to segments
    in_slices = _widest(sorted_.union(_met_again(windows, None)))
    in_segments = _widest(sorted_.union(_met_again(slices, in_slices)))
    # equal segments at two places: all their windows are repeats
    twice = segments.groupBy("segment").agg(
        F.min(where).alias("a"), F.max(where).alias("b"), F.max("ahead").alias("far"), F.min("back").alias("near")
    )
    twice = twice.filter("a != b").select("segment", F.col("far").cast("int"), F.col("near").cast("int"))
    covered = staged(_widest(in_segments.union(twice)), "covered")  # as for ``common``: a segment of many texts can be split
    places = segments.select("segment", "text_hash", "place").join(covered, "segment")
    span = F.struct((F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near") + WINDOW).alias("end"))
    out = places.groupBy("text_hash").agg(F.collect_set(span).alias("spans"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end")))
    return out.join(copied, "text_hash", "left_anti").union(copied.select("text_hash", whole.alias("spans")))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans) per document: its bytes without the repeated ones, and the removed stretches, merged.

    A null text counts as empty, and a text shorter than a window keeps all. Repeated rows are repeats of each other. Null ids stay null.
    Texts of any length and alphabet are treated as their UTF-8 bytes. Extra columns are not looked at; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("text_hash"))
    joined = rows.join(spans(docs), "text_hash", "left").select(F.col("doc_id").cast("string"), "text", "spans")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], min(s["end"], len(data))) for s in (found if found is not None else [])):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                kept, at = [], 0
                for start, end in merged:
                    kept.append(data[at:start])
                    at = end
                kept.append(data[at:])
                out.append((len(data), b"".join(kept), [tuple(m) for m in merged]))
            frame = pd.DataFrame(out, columns=["n_bytes", "kept", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    # ids go as text: pandas would round long ones beside a null
    out = joined.mapInPandas(cut, "doc_id string, n_bytes long, kept binary, spans array<struct<start: int, end: int>>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    found = remove(docs)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
