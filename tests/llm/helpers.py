"""Small frames with the columns of the tables, and odd rows that every operator must take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, **columns):
    rows = [
        (start + i, t, columns.get("lang", "en"), f"src{i % 3}", None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(30_000))
    rows = [
        (None, "no id here", "en", "a", 10),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "   \n\t ", "en", "b", 6),
        (4, long, "de", "b", len(long)),
        (5, "same row", "en", "a", 8),
        (5, "same row", "en", "a", 8),
        (6, "same row", "en", "a", 8),
        (7, "Ünï İ K \U0001f600 日本語", "fr", "c", 5),
    ]
    extra = ", length long, rank int, count int, _block int, spans string, secrets string, salt int, component long, text_hash long"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", "y", 5, 6, 7) for r in rows], DOCUMENTS + extra)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
