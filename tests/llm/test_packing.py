import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from helpers import documents, odd_documents
from stemledger.llm import packing
from stemledger.llm.queries import vocabulary


def check(docs, packed, size):
    tokenizer = Tokenizer.from_file(vocabulary())
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    rows = packed.collect()
    sequences, cut = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(
            len(ids) == r["doc_tokens"]
            and zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            for ids in want[r["doc_id"]]
        )
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        cut[r["doc_id"]].append(r["length"])
    for doc, lengths in cut.items():
        assert sum(lengths) == sum(map(len, want[doc]))
    assert set(cut) == set(want)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    return total, len(sequences)


def test_pieces_patterns_and_padding(spark):
    words = "the onon ing of thation -- 12 été l'eau café's".split()
    texts = [" ".join(words[(i * j) % len(words)] for j in range(i % 37)) for i in range(300)]
    docs = documents(spark, texts)
    total, n = check(docs, packing.pack(docs, vocabulary(), 64), 64)
    assert n <= -(-total // 64) * 1.05 + 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(docs, packing.pack(docs, vocabulary()), 4096)
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


def test_words_are_encoded_as_whole_texts(spark):
    texts = ["a\x1cb \x1f c", "x y z", "A <|endoftext|>b", "it's O'Neil'S 'll", "é ́a", "ΟΔΥΣΣΕΥΣ ΣΑΣ"]
    encode, plain = packing.WordEncoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for text in texts:
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_many_equal_lengths_are_ranked_by_salt(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 20)
    docs = documents(spark, ["one two three"] * 150 + ["four"] * 50)
    total, n = check(docs, packing.pack(docs, vocabulary(), 16), 16)
    assert n == -(-total // 16)


def test_patterns_hold_every_length_once():
    histogram = {1: 7, 3: 5, 5: 4, 8: 2, 16: 1}
    plan = packing.plan_patterns(histogram, 16)
    held = defaultdict(int)
    for lengths, count in plan:
        assert sum(lengths) <= 16
        for x in lengths:
            held[x] += count
    assert dict(held) == histogram
    assert packing.plan_patterns({}, 16) == []
