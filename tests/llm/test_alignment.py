"""Alignment of two tokenizers against whole-text encoding and brute-force grouping."""

import hashlib
from collections import Counter

import compare
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stemledger.llm import alignment, queries

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers on whole texts, by the libraries the files are for."""
    import sentencepiece

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def run(text):
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        parts_a, parts_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        want = f" {text}".encode()
        if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
            return [], [], []
        return ids_a, ids_b, groups(ids_a, ids_b, np.cumsum([*map(len, parts_a)]), np.cumsum([*map(len, parts_b)]))

    return run


def groups(a, b, ends_a, ends_b):
    out, i, j = [], 0, 0
    for end in sorted(set(map(int, ends_a)) & set(map(int, ends_b))):
        x, y = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        out.append((tuple(map(int, a[i:x])), tuple(map(int, b[j:y]))))
        i, j = x, y
    return out


def brute(whole, texts):
    """Rows of the query, without ids."""
    found = [whole(t or "") for t in texts]
    linked = [Counter((p, q) for x, y in g for p in x for q in y) for _, _, g in found]
    counts = Counter(pair for c in linked for pair in c)
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(n, most.get(p, 0))
    rows = []
    for (a, b, g), c in zip(found, linked):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(n for (p, q), n in c.items() if counts[p, q] == most[p])
        rows.append((len(a), len(b), len(g), sum(c.values()), digest, best, sum(n * counts[k] for k, n in c.items())))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, pairs int")


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\n  foo", "x\t   y", "x　 y", "a▁b c", "▁", "\0",
    "<|endoftext|> <s></s><unk> <0x41>", "don't 'LL we'll", "क़ ড় שׁ", "字漢 漢字", "😀😀 👩‍👩‍👧 x",
    "Ａ ﬁ é é", "ab" * 3000, "a" * 5001, "\x85 \x1c x   y", "1234567890 12 3.14", "​﻿ a",
]


def test_odd_texts_like_whole_encoding(spark, whole):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(2**53 + 1, "a b"), (None, "a b"), (7, "a b"), (7, "a b")]
    got = alignment.alignment(frame(spark, rows), A, B).collect()
    want = [(i, *r) for (i, _), r in zip(rows, brute(whole, [t for _, t in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert alignment.alignment(frame(spark, []), A, B).count() == 0


def test_whole_table_over_many_blocks(spark, whole, monkeypatch):
    docs = queries.table(spark, compare.DATA, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted((i, *r) for (i, _), r in zip(rows, brute(whole, [t for _, t in rows])))
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 20_000)
    got = alignment.alignment(docs.repartition(3), A, B).collect()
    assert sorted(map(tuple, got)) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .'s\n\t ▁é字1́", max_size=30))
def test_stretches_encode_like_whole_texts(text):
    pair = alignment.pair(A, B)
    if not text:
        return
    tokenizer = test_stretches_encode_like_whole_texts.tokenizer = getattr(
        test_stretches_encode_like_whole_texts, "tokenizer", None
    ) or Tokenizer.from_file(A)
    found = pair.ids(text)
    want = pair.b.model.encode(text)
    assert (found is None) == (b"".join(map(pair.b.bytes_of.__getitem__, want)) != f" {text}".encode())
    if found is not None:
        assert found[0].tolist() == tokenizer.encode(f" {text}", add_special_tokens=False).ids
        assert found[1].tolist() == want


def test_wide_groups_are_counted_first(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 50)
    closes_a, closes_b = np.zeros(40, bool), np.zeros(50, bool)
    closes_a[[0, 20, 39]] = closes_b[[4, 30, 49]] = True
    want = alignment.links(a, b, closes_a, closes_b)
    monkeypatch.setattr(alignment, "WIDE", 10)
    for x, y in zip(alignment.links(a, b, closes_a, closes_b), want):
        assert x.tolist() == y.tolist()


@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.randoms(use_true_random=False))
def test_align_finds_all_common_ends(lengths, random):
    ends_a = np.cumsum(lengths)
    total = int(ends_a[-1])
    ends_b = np.array(sorted({total, *random.sample(range(1, total + 1), random.randint(0, total))}))
    closes_a, closes_b = alignment.align(ends_a, ends_b)
    common = set(ends_a.tolist()) & set(ends_b.tolist())
    assert set(ends_a[closes_a].tolist()) == set(ends_b[closes_b].tolist()) == common
