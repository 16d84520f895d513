"""Alignment of the tokens that two tokenizers make of the same texts, and how firmly token ids are linked over the corpus.

1. Each text is encoded by both tokenizers; the running sums of the tokens' byte lengths are their end arrays.
2. ``align`` walks both arrays at once. As long as ends agree at the current index shift, exponential probing jumps whole
   one-to-one stretches by comparing slices of doubling length. Where they disagree the irregular group is resolved
   locally, token by token, and the shift is updated.
3. A link is a pair of an A and a B token in one group. How many documents hold a pair of ids is counted over the corpus:
   tasks send each pair once per block of documents, with its count there.
4. Each block of documents meets the counts of its own pairs, sent to it once, and sums them up per document.

A pair that every document holds costs one row per block, so no key gathers documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemledger.llm.shared import staged

#: Distinct stretches of text whose ids a task remembers before it starts anew.
REMEMBERED = 300_000
#: Characters of text after which a task closes a block of documents; a longer text has a block of its own.
BLOCK_CHARS = 8_000_000
#: Links of one group above which its ids are counted first and never paired token by token.
WIDE = 4096
#: One-to-one tokens taken one by one before slices are probed.
NEAR = 8
#: Both tokenizers end a token before a space that follows a character other than white space.
_SPACE = re.compile(r"(?<=\S) ")
#: White space behind which they may not.
_RUNS = [f"{c} " for c in map(chr, range(0x3001)) if c.isspace()]


class BytePairs:
    """Byte-level BPE from a ``tokenizers`` file; special tokens' strings inside texts are plain text.

    The vocabulary is run by ``tiktoken``, whose merges by rank give the same ids several times faster.
    """

    #: Fixed value: the pattern that byte-level BPE of this kind splits texts by.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        pieces = {i: bytes(map(letters.__getitem__, p)) for p, i in spec["model"]["vocab"].items() if i not in special}
        self.bytes_of = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        ranks = {b: i for i, b in pieces.items()}
        self.encoding = tiktoken.Encoding("pairs", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        return [self.encoding.encode_ordinary(f" {t}") for t in texts]


class SentencePieces:
    """A ``sentencepiece`` model that puts a space before each text and falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [self._bytes(i) for i in range(len(self.model))]
        self.space = self.model.piece_to_id("▁")

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it; the model itself adds none to an empty text."""
        return [ids if t else [self.space] for t, ids in zip(texts, self.model.encode(texts, num_threads=1), strict=True)]


def _byte_letters() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers on whole texts. Stretches between such spaces are met again and again, so a bounded number is kept."""

    def __init__(self, a: Callable, b: Callable):
        self.a, self.b = a, b
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.changed: set[str] = set()  # stretches whose tokens do not give back their bytes
        self.length_a = np.array([len(x) for x in a.bytes_of], dtype=np.int64)
        self.length_b = np.array([len(x) for x in b.bytes_of], dtype=np.int64)
        # names of ids for the digest, followed by what can stand behind them
        self.name_a = np.array([f"{i}{s}" for i in range(len(a.bytes_of)) for s in ",|"], dtype=object)
        self.name_b = np.array([f"{i}{s}" for i in range(len(b.bytes_of)) for s in ",;"], dtype=object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """A and B ids of a text with a space before it; None if their bytes are not those of the text."""
        words = _stretches(text)
        found = list(map(self.known_a.get, words))
        if None in found:
            new = list(dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None))
            if len(self.known_a) + len(new) > REMEMBERED:
                for kept in (self.known_a, self.known_b, self.changed):
                    kept.clear()
                new = list(dict.fromkeys(words))
            self._learn(new)
            found = list(map(self.known_a.__getitem__, words))
        # tokens can only lose bytes, so that stretches with other bytes cannot make up for each other
        if self.changed and not self.changed.isdisjoint(words):
            return None
        a, b = b"".join(found), b"".join(map(self.known_b.__getitem__, words))
        return np.frombuffer(a, dtype="<i4"), np.frombuffer(b, dtype="<i4")

    def _learn(self, words: list[str]) -> None:
        ids = self.a(words), self.b(words)
        for known, own in zip((self.known_a, self.known_b), ids, strict=True):
            flat = np.fromiter(chain.from_iterable(own), dtype="<i4").tobytes()
            ends = (4 * np.cumsum(list(map(len, own)))).tolist()
            known.update(zip(words, map(flat.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        want = [f" {w}".encode() for w in words]
        for coder, own in zip((self.a, self.b), ids, strict=True):
            piece = coder.bytes_of.__getitem__
            if b"".join(map(piece, chain.from_iterable(own))) != b"".join(want):
                self.changed.update(w for w, x, y in zip(words, want, own, strict=True) if x != b"".join(map(piece, y)))


def _stretches(text: str) -> list[str]:
    """The text cut at the spaces before which both tokenizers end a token, without these spaces."""
    if text.startswith(" ") or any(r in text for r in _RUNS):
        words = _SPACE.split(f" {text}")
        words[0] = words[0][1:]
        return words
    return text.split(" ")


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """Kept as long as the Python worker lives, over its tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(BytePairs(path_a), SentencePieces(path_b))
    return _PAIRS[path_a, path_b]


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each array, whether a group ends with that token. Both arrays rise and have the same last value."""
    n = len(ends_a)
    closes_a, closes_b = bytearray(n), bytearray(len(ends_b))
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    flat_a, flat_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    i = shift = 0  # the next tokens are list_a[i] and list_b[i + shift]
    while i < n:
        j = i + shift
        if list_a[i] == list_b[j]:
            # a one-to-one stretch: a few steps, then probe slices of doubling length, then halve down to its end
            end, near = i + 1, min(n, i + NEAR)
            while end < near and list_a[end] == list_b[end + shift]:
                end += 1
            step, grow = NEAR * (end == near < n), True
            while step:
                to = end + step
                if to <= n and flat_a[8 * end : 8 * to] == flat_b[8 * (end + shift) : 8 * (to + shift)]:
                    end = to
                    step = step * 2 if grow else step // 2
                else:
                    grow = False
                    step //= 2
            closes_a[i:end] = closes_b[j : end + shift] = b"\1" * (end - i)
            i = end
        else:
            x, y = list_a[i], list_b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = list_a[i]
                else:
                    j += 1
                    y = list_b[j]
            closes_a[i] = closes_b[j] = 1
            i += 1
            shift = j + 1 - i
    return np.frombuffer(closes_a, dtype=np.bool_), np.frombuffer(closes_b, dtype=np.bool_)


def _starts(closes: np.ndarray) -> np.ndarray:
    """Index of each group's first token, and the number of tokens."""
    return np.concatenate(([0], np.flatnonzero(closes) + 1))


def links(a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs as A id * 2**16 + B id, ascending, and how often each is linked."""
    starts_a, starts_b = _starts(closes_a), _starts(closes_b)
    size_a, size_b = np.diff(starts_a), np.diff(starts_b)
    wide = size_a * size_b > WIDE
    each = np.where(wide, 0, size_b)  # links of each A token of a group
    group = np.cumsum(closes_a) - closes_a
    repeats = each[group]
    first = np.repeat(starts_b[group] - (np.cumsum(repeats) - repeats), repeats)
    codes = (np.repeat(a, repeats).astype(np.int64) << 16) | b[first + np.arange(len(first))]
    codes, counts = np.unique(codes, return_counts=True)
    if wide.any():
        parts, numbers = [codes], [counts]
        for g in np.flatnonzero(wide):
            ids_a, n_a = np.unique(a[starts_a[g] : starts_a[g + 1]], return_counts=True)
            ids_b, n_b = np.unique(b[starts_b[g] : starts_b[g + 1]], return_counts=True)
            parts.append(((ids_a.astype(np.int64)[:, None] << 16) | ids_b[None, :]).ravel())
            numbers.append((n_a[:, None] * n_b[None, :]).ravel())
        codes, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(len(codes), dtype=np.int64)
        np.add.at(total, where, np.concatenate(numbers))
        counts = total
    return codes, counts.astype(np.int64)


def rendered(pair: Pair, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    starts_a, starts_b = _starts(closes_a), _starts(closes_b)
    out = np.empty(len(a) + len(b), dtype=object)
    # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its group's
    out[np.arange(len(a)) + starts_b[np.cumsum(closes_a) - closes_a]] = pair.name_a[2 * a + closes_a]
    out[np.arange(len(b)) + starts_a[np.cumsum(closes_b) - closes_b + 1]] = pair.name_b[2 * b + closes_b]
    return "".join(out.tolist())[:-1]


def _planes(values: np.ndarray) -> bytes:
    """Bytes of like weight side by side, which compress well where numbers are small."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


_DOC = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_BLOCK = pa.schema(
    [
        ("block", pa.string()), ("doc_id", pa.int64()), *_DOC, ("places", pa.binary()), ("times", pa.binary()),
        ("pairs", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())),
    ]
)
_BLOCK_DDL = (
    "block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "places binary, times binary, pairs array<long>, held array<long>"
)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its figures and its links as places in the pairs of its block; per block one row with these pairs and
    the number of the block's documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pair(path_a, path_b)
        task, number, chars = TaskContext.get().partitionId(), 0, 0
        ids, rows, codes, times = [], [], [], []
        for batch in batches:
            for at, text in enumerate(batch.column("text").to_pylist()):
                if chars and chars + len(text or "") > BLOCK_CHARS:
                    yield _block(f"{task}-{number}", ids, rows, codes, times)
                    ids, rows, codes, times = [], [], [], []
                    number, chars = number + 1, 0
                row, found, counts = _document(coder, text)
                ids.append(batch.column("doc_id")[at])
                rows.append(row)
                codes.append(found)
                times.append(counts)
                chars += len(text or "")
        if rows:
            yield _block(f"{task}-{number}", ids, rows, codes, times)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCK_DDL)


_NOTHING = np.zeros(0, dtype=np.int64)


def _document(coder: Pair, text: str | None) -> tuple[tuple, np.ndarray, np.ndarray]:
    if not text:
        return (0, 0, 0, 0, ""), _NOTHING, _NOTHING
    found = coder.ids(text)
    if found is None:
        return (0, 0, 0, 0, ""), _NOTHING, _NOTHING
    a, b = found
    closes_a, closes_b = align(np.cumsum(coder.length_a[a]), np.cumsum(coder.length_b[b]))
    codes, counts = links(a, b, closes_a, closes_b)
    digest = hashlib.sha256(rendered(coder, a, b, closes_a, closes_b).encode()).hexdigest()
    return (len(a), len(b), int(closes_a.sum()), int(counts.sum()), digest), codes, counts


def _block(name: str, ids: list, rows: list[tuple], codes: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
    pairs, where, held = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(c) for c in codes])[:-1]
    # codes of a document rise, so its places do: their steps are small numbers
    places = [_planes(np.diff(p, prepend=0)) for p in np.split(where, ends)]
    n = len(rows) + 1
    columns = [
        pa.array([name] * n, pa.string()),
        pa.array([*(i.as_py() for i in ids), None], pa.int64()),
        *(pa.array([*(r[k] for r in rows), None], kind) for k, (_, kind) in enumerate(_DOC)),
        pa.array([*places, None], pa.binary()),
        pa.array([*map(_planes, times), None], pa.binary()),
        pa.array([None] * len(rows) + [pairs.tolist()], pa.list_(pa.int64())),
        pa.array([None] * len(rows) + [held.tolist()], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_BLOCK)


def pair_counts(blocked: DataFrame) -> DataFrame:
    """(pair, held, best): how many documents hold each linked pair of ids, and whether that is the most of its A id."""
    held = blocked.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("p"))
    counted = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held").alias("held"))
    # as many rows per A id as it has partners in the other vocabulary
    own = Window.partitionBy(F.shiftright("pair", 16))
    return counted.withColumn("best", F.col("held") == F.max("held").over(own))


_OUT = pa.schema([("doc_id", pa.int64()), *_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: tokens of A and B, groups, links, links of the A id's most frequent pairs, the counts of all links
    summed, and the digest of the groups.

    Nulls: null texts, empty texts and texts whose tokens do not give back their bytes have zeros and an empty digest; a
    null id is kept. Texts of any length are aligned whole. Ties for the most frequent pair all count. Repeated rows are
    documents of their own. Extra columns are not looked at. An empty table gives no rows.
    """
    blocked = staged(blocks(docs, path_a, path_b), "aligned")
    counts = staged(pair_counts(blocked), "pair-counts")
    wanted = blocked.filter("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    one = F.struct("place", "held", "best")
    weights = wanted.join(counts, "pair").groupBy("block").agg(F.sort_array(F.collect_list(one)).alias("w"))
    weights = weights.select(F.col("block").alias("of"), F.col("w.held").alias("held"), F.col("w.best").alias("best"))
    rows = blocked.filter("pairs is null").drop("pairs", "held")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        held = best = _NOTHING
        if right.num_rows:
            held = right.column("held").combine_chunks()[0].values.to_numpy(zero_copy_only=False)
            best = right.column("best").combine_chunks()[0].values.to_numpy(zero_copy_only=False).astype(np.int64)
        n_best, count_sum = [], []
        for places, times in zip(left.column("places"), left.column("times"), strict=True):
            where, n = np.cumsum(_values(places.as_py())), _values(times.as_py())
            n_best.append(int(n @ best[where]) if len(n) else 0)
            count_sum.append(int(n @ held[where]) if len(n) else 0)
        kept = left.select(["doc_id", *(name for name, _ in _DOC)])
        kept = kept.append_column("n_best", pa.array(n_best, pa.int64()))
        return kept.append_column("count_sum", pa.array(count_sum, pa.int64())).cast(_OUT)

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(weigh, out)
