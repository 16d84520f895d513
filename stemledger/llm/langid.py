"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

Words are runs of letters, and of marks behind a letter. Each is scored per language by hashed letter n-grams (1 to 3, with word starts); a language is a candidate
for a word only if it was seen in the word's script. A switching penalty makes the best path keep a language
until several words speak against it, so texts of several languages fall into spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last code point of the main letter ranges of scripts; other letters count as one script.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
BUCKETS = 1 << 16
SMOOTHING = 0.1
#: Nats that a change of language costs.
SWITCH = 12.0
#: Score of a language never seen in a word's script.
UNSEEN = -1e4
#: Characters scored together, and texts labelled together: a task holds some 50 MB for them.
SCORED_TOGETHER = 250_000
LABELLED_TOGETHER = 2_000_000
UNDETERMINED = "und"


@dataclass
class Model:
    """Log probabilities by n-gram bucket and language, and which languages were seen in which script."""

    languages: list[str]
    table: np.ndarray  # BUCKETS x languages
    seen: np.ndarray  # scripts x languages


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 1 if it is a letter, 2 if it is a mark, else 0; and its script's number."""
    word = np.array(["LM".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)], dtype=np.uint8)
    script = np.zeros(0x110000, dtype=np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return word, script


def _fold(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_words(kind: np.ndarray) -> np.ndarray:
    """Which characters of these kinds stand in a word: letters, and marks that continue a word."""
    if not (kind == 2).any():
        return kind == 1
    at = np.arange(len(kind))
    last_letter = np.maximum.accumulate(np.where(kind == 1, at, -1))
    last_other = np.maximum.accumulate(np.where(kind == 0, at, -1))
    return (kind > 0) & (last_letter > last_other)


def _grams(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of texts one after another: n-gram buckets by letter (3 columns), word starts, word ends, their text, their script."""
    word, script = _letters()
    codes = np.frombuffer("\n".join(map(_fold, texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _in_words(word[codes])
    c = np.where(letter, codes, 0).astype(np.uint32)
    one = np.concatenate([[0], c[:-1]]).astype(np.uint32)
    two = np.where(one > 0, np.concatenate([[0, 0], c[:-2]])[: len(c)], 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    a, b, d = c[at], one[at], two[at]
    h1 = a * np.uint32(2654435761)
    h2 = (h1 ^ (b + np.uint32(1)) * np.uint32(2246822519)) * np.uint32(3266489917)
    h3 = (h2 ^ (d + np.uint32(2)) * np.uint32(668265263)) * np.uint32(374761393)
    buckets = np.stack([h1 >> 16, h2 >> 16, h3 >> 16], axis=1)
    first = np.flatnonzero(one[at] == 0)  # of the letters
    starts = at[first]
    ends = at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else starts
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, starts, side="right") - 1
    return buckets, first, starts - bounds[text], ends - bounds[text], text, script[codes[starts]]


def _blocks(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts[first:]:
        yield first, texts[first:]


def fit(labelled: DataFrame, max_docs: int = 20_000) -> Model:
    """Learn from the texts of at most ``max_docs`` labelled documents, those with the smallest hashes of their ids.

    Whole texts are counted in tasks; what comes to the driver is one row per language and bucket.
    """
    given, place = labelled.filter("text is not null and lang is not null"), F.xxhash64("doc_id")
    # hashes are spread evenly: the smallest ones lie in twice their share of the range, so that tasks pass on no more than that
    share = min(1.0, 2 * max_docs / max(1, given.count()))
    sample = given.filter(place <= F.lit(-(2**63) + int(share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    sample = sample.orderBy(place, "doc_id").limit(max_docs)
    sample = sample.select("text", "lang").repartition(16)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                grams = np.zeros(BUCKETS, dtype=np.int64)
                scripts = np.zeros(len(NAMES), dtype=np.int64)
                for _, block in _blocks(list(texts), SCORED_TOGETHER):
                    buckets, _, _, _, _, script = _grams(block)
                    grams += np.bincount(buckets.ravel(), minlength=BUCKETS)
                    scripts += np.bincount(script, minlength=len(NAMES))
                both = np.concatenate([grams, scripts])
                at = np.flatnonzero(both)
                yield pd.DataFrame({"lang": lang, "at": at, "n": both[at]})

    counts = sample.mapInPandas(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # languages times buckets at most
    languages = sorted(rows["lang"].unique())
    table = np.zeros((BUCKETS + len(NAMES), max(1, len(languages))))
    column = {lang: i for i, lang in enumerate(languages)}
    table[rows["at"].to_numpy(dtype=int), rows["lang"].map(column).to_numpy(dtype=int)] = rows["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    # a stray word of another script does not make a language one of that script
    return Model(languages, logs, scripts > 0.001 * scripts.sum(axis=0))


def _viterbi(scores: np.ndarray, first: np.ndarray, length: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every word; texts (first word, number of words) go forward side by side, longest first."""
    path = np.zeros(len(scores), dtype=np.int16)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return path
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # texts with more than t words
    came = np.empty(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = scores[first].astype(np.float64)
    top = value.argmax(axis=1)
    path[first] = top
    for t in range(1, length[0]):
        n = active[t]
        value, top, at = value[:n], top[:n], first[:n] + t
        change = (value[np.arange(n), top] - switch)[:, None]
        stays = value >= change
        came[at] = np.where(stays, own, top[:, None])
        value = np.where(stays, value, change) + scores[at]
        top = value.argmax(axis=1)
        path[at] = top
    for t in range(length[0] - 1, 0, -1):
        at = first[: active[t]] + t
        path[at - 1] = came[at, path[at]]
    return path


def _scored(texts: list[str], model: Model) -> tuple[np.ndarray, ...]:
    """Scores, text, start and end of every word of ``texts``."""
    parts = []
    for offset, block in _blocks(texts, SCORED_TOGETHER):
        buckets, first, start, end, text, script = _grams(block)
        if not len(first):
            continue
        letters = model.table[buckets[:, 0]] + model.table[buckets[:, 1]] + model.table[buckets[:, 2]]
        score = np.add.reduceat(letters, first, axis=0)
        fits = model.seen[script]
        known = fits.any(axis=1)
        score = np.where(fits, score, np.float32(UNSEEN))
        score[~known] = 0  # a script that no language has tells nothing
        parts.append((score, text + offset, start, end))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros((0, len(model.languages)), dtype=np.float32), none, none, none
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def label(texts: list[str | None], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) per text; a span is (first character, end, language) of words in one language."""
    out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
    given = [t if isinstance(t, str) else "" for t in texts]
    if not model.languages:
        return out
    for offset, block in _blocks(given, LABELLED_TOGETHER):
        score, text, start, end = _scored(block, model)
        first = np.searchsorted(text, np.arange(len(block)))
        length = np.searchsorted(text, np.arange(len(block)), side="right") - first
        path = _viterbi(score, first, length, switch)
        letters = np.zeros((len(block), len(model.languages)))
        np.add.at(letters, (text, path), end - start)
        best = letters.argmax(axis=1)
        turn = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (path[1:] != path[:-1]))) if len(text) else []
        spans: list[list] = [[] for _ in block]
        for a, b in zip(turn, np.append(turn[1:], len(text)) if len(text) else [], strict=True):
            spans[text[a]].append((int(start[a]), int(end[b - 1]), model.languages[path[a]]))
        for i in np.flatnonzero(length):
            out[offset + i] = (model.languages[best[i]], float(letters[i, best[i]] / letters[i].sum()), spans[i])
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (share of letters in spans of that language) and ``spans`` per document.

    Only the text is looked at. A null or empty text, or one without a letter, is ``und`` with score 0; so is every text if
    nothing was learned. Letters of scripts that no learned language has follow the words around them. Texts of any length are
    labelled whole, repeated rows each for itself, null ids stay null. Extra columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = label(list(batch["text"]), shared.value, switch)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "spans": [f[2] for f in found],
                }
            )

    # ids go as text: pandas would round long ones beside a null
    schema = "doc_id string, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"
    out = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def held_out() -> Column:
    """Documents never learned from: the checksum of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, max_docs: int = 20_000) -> Model:
    """The model learned from documents that are not held out; those without an id are not learned from either."""
    return fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), max_docs)


def accepted(docs: DataFrame, model: Model, least: float = 0.3, switch: float = SWITCH) -> DataFrame:
    """``docs`` without those that have no language, or less than ``least`` of their letters in the leading one.

    The decision is made beside the rows, in one pass, so repeated rows and rows without an id are judged one by one. All
    columns pass as they are, nulls and long ids too. Among languages with equally many letters the first in text order leads.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label(batch.column(at).to_pylist(), shared.value, switch)
            kept = [lang != UNDETERMINED and score >= least for lang, score, _ in found]
            yield batch.filter(pa.array(kept, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
