"""Long ids beside nulls come back as they were, and every code point is encoded as by the whole tokenizer."""

import sys
import zlib

import numpy as np
import pytest

import corpus_pipeline
from stemledger.llm import alignment, langid, nearsets, packing, pii, queries, repeats, rules, secrets, warc

LONG = [2**53 + 1, -(2**53) - 1, None, 2**63 - 1, 5]
TEXT = "the first word and the second word of a text that is long enough to be told"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{TEXT} {k}", "en", "s", 1) for k, i in enumerate(LONG)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


OPERATORS = {
    "op1": lambda d: packing.pack(d, queries.vocabulary()),
    "op2": pii.digest,
    "op3": secrets.digest,
    "op6": nearsets.classes,
    "op9": repeats.digest,
    "op10": lambda d: langid.identify(d, langid.train(d)),
    "op12": rules.ledger,
    "op13": lambda d: alignment.alignment(d, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")),
    "language": lambda d: corpus_pipeline.language(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_ids_beside_a_null(docs, name):
    assert sorted((r["doc_id"] for r in OPERATORS[name](docs).collect()), key=str) == sorted(LONG, key=str)


def test_archives_are_read_alike_however_files_are_split(spark, folder):
    rows = [(i, f"u{i}", f"page {i} " + "WARC/1.0\r\nx " * (i % 5) + "y" * (i * 7 % 900)) for i in range(600)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{folder}/w")
    want = sorted((i, len(h.encode())) for i, _, h in rows)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        plan = warc.page_records(spark, f"{folder}/w")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
        assert sorted((r["page_id"], r["payload_bytes"]) for r in plan.collect()) == want
        chunks = warc.read(spark, f"{folder}/w")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert chunks.count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_every_code_point_is_encoded_as_in_the_whole_text():
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(queries.vocabulary()), packing.WordEncoder(queries.vocabulary())
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 64 == 0)]
    for shape in (" ab{}.", "{}b, c{}d.", "x{}"):
        for first in range(0, len(points), 2000):
            texts = [shape.replace("{}", c) for c in points[first : first + 2000]]
            got = [np.frombuffer(encode(t), "<u4").tolist() for t in texts]
            want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
            assert got == want, [t for t, a, b in zip(texts, got, want) if a != b][:5]


def test_words_forgotten_and_met_again(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 40)
    encode, whole = packing.WordEncoder(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = " ".join(f"w{chr(97 + k)}{'é' * (k % 3)}{'.' * (k % 2)}" for k in rng.integers(0, 26, 30))
        ids = np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert zlib.crc32(encode(text)) == zlib.crc32(ids)
