"""Packing of tokenised documents into sequences, shortest pack first over the length histogram.

1. Every document is tokenised once, in batches, and cut into pieces of at most ``size`` tokens.
2. The histogram of piece lengths (at most ``size`` entries, whatever the corpus) is what the driver
   sees. Lengths are placed longest first, each onto the emptiest pattern it fits, and only pattern counts change.
3. Pieces are ranked within their length and joined to the patterns' rank ranges: no sequence is ever gathered.

Ranks are dealt out by salt, so a length that a third of all pieces share is numbered by many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemledger.llm.shared import staged

#: Distinct white-space separated words whose ids a task remembers before it lets those go that were not met lately.
REMEMBERED_WORDS = 150_000
#: Pieces of one length and salt that one task numbers, about.
RANKED_TOGETHER = 20_000


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, the same as encoding it whole.

    For vocabularies that lower the case, drop white space and never join words over it (``word_bpe_49k``), a text's ids are
    those of its words one after another. Words are met again and again, so the ids of a bounded number are kept. A text with one
    of the few characters that Python and the vocabulary take differently for white space or lower case is encoded whole.
    """

    ODD = re.compile("[\x1c-\x1f\u03a3\u0130]")
    #: Words of small letters that no step before the model changes.
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # the vocabulary writes the bytes of these letters beyond ASCII as characters of their own
        self.shown = str.maketrans({chr(b): c for b, c in _byte_letters().items()})

    def __call__(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._each([text])[0]
        # special tokens are told by their case, and then words are looked up as they stand
        words = (text if "<|" in text else text.lower()).split()
        found = list(map(self.known.get, words))
        if None in found:
            kept = self.known
            self._learn(list(dict.fromkeys(w for w, ids in zip(words, found, strict=True) if ids is None)))
            if self.known is not kept:  # generations have turned
                self._learn([w for w in dict.fromkeys(words) if w not in self.known])
            found = list(map(self.known.__getitem__, words))
        return b"".join(found)

    def _learn(self, words: list[str]) -> None:
        """Ids of words that are not known; those that were known a while ago are taken over."""
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        new = []
        for w in words:
            ids = self.older.get(w)
            if ids is None:
                new.append(w)
            else:
                self.known[w] = ids
        # a plain word and a stop behind it are two words to the vocabulary
        bare = {w: w[:-1] for w in new if w[-1] in ".," and self.PLAIN(w[:-1])}
        wanted = dict.fromkeys([".", ",", *(bare.get(w, w) for w in new)])
        missing = [w for w in wanted if w not in self.known]
        self.known.update(zip(missing, self._encode(missing), strict=True))
        self.known.update((w, self.known[b] + self.known[w[-1]]) for w, b in bare.items())

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word. Plain words go to the model at once: the steps before it only write their bytes as characters."""
        tokenize, plain = self.tokenizer.model.tokenize, self.PLAIN
        found = {}
        for w in words:
            if plain(w):
                shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.shown)
                found[w] = array("I", [t.id for t in tokenize(shown)]).tobytes()
        rest = [w for w in words if w not in found]
        if rest:
            found.update(zip(rest, self._each(rest), strict=True))
        return [found[w] for w in words]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [_as_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes a byte as: itself if it is printable in Latin-1, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


#: Kept as long as the Python worker lives, over its tasks.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of each document's ids with ``end_id`` behind them; null text has only that id."""
    end = _as_bytes([end_id])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (encode(text) if isinstance(text, str) else b"") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    crc = zlib.crc32(part)
                    rows.append((doc_id, start, len(part) // 4, crc, total))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    # ids go as text: pandas would round long ones beside a null
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
    out = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(cut, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, how many sequences have it), by shortest pack first.

    A length goes onto the pattern with the most room left; all equal patterns take it at once.
    """
    room: dict[int, list[list]] = {}  # tokens left -> patterns [lengths, count]
    open_rooms: list[int] = []  # ascending
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = open_rooms[-1] if open_rooms else 0
            if most >= length:
                lengths, count = room[most].pop()
                if not room[most]:
                    open_rooms.pop()
                    del room[most]
                fits = max(1, min(most // length, left // count))
                used = min(count, left)
                if count > used:
                    _put(room, open_rooms, most, lengths, count - used)
                _put(room, open_rooms, most - length * fits, (*lengths, *[length] * fits), used)
                left -= used * fits
            else:
                fits = min(size // length, left)
                count = left // fits
                _put(room, open_rooms, size - length * fits, (length,) * fits, count)
                left -= count * fits
    return [(lengths, count) for patterns in room.values() for lengths, count in patterns]


def _put(room: dict, open_rooms: list[int], left: int, lengths: tuple, count: int) -> None:
    if left not in room:
        open_rooms.insert(bisect_right(open_rooms, left), left)
        room[left] = []
    room[left].append([lengths, count])


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Nulls: a null text counts as empty; a null id is kept as null. Empty texts hold one token, the end
    id. Very long texts are cut into full pieces and a rest. Repeated rows are packed each for itself. Extra columns are
    not looked at. An empty table gives no rows.
    """
    cut = staged(pieces(docs, vocabulary, size, end_id), "pieces")
    total = cut.count()
    salts = max(1, -(-total // RANKED_TOGETHER))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("rank"))

    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    place = _placer(plan_patterns(histogram, size))
    shown = ranked.select(F.col("doc_id").cast("string"), "start", "length", "ids_crc32", "doc_tokens", "rank")
    out = shown.mapInPandas(
        place, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _placer(patterns: list[tuple[tuple[int, ...], int]]):
    """Maps (length, rank) to its sequence: each pattern's slot of a length holds a range of ranks."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            slots.setdefault(length, []).append((first, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    table = {k: np.array(v, dtype=np.int64).T for k, v in slots.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence_id = np.zeros(len(batch), dtype=np.int64)
            offset = np.zeros(len(batch), dtype=np.int64)
            rank = batch["rank"].to_numpy()
            for length, where in batch.groupby("length").indices.items():
                first, start, at = table[length]
                slot = np.searchsorted(first, rank[where], side="right") - 1
                sequence_id[where] = start[slot] + rank[where] - first[slot]
                offset[where] = at[slot]
            yield batch.drop(columns="rank").assign(sequence_id=sequence_id, offset=offset)

    return place
