"""What fitted operators are worth: held-out accuracy of languages, what they learn from, and recall at the default."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from stemledger.llm import langid, queries, treesearch

SMALL = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = queries.table(spark, SMALL, "documents")
    found = queries.QUERIES["op10_langid"](spark, SMALL).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("lang")).first()
    assert n > 100 and right / n > 0.97


def test_held_out_texts_have_no_influence(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source")
    other = docs.withColumns(
        {
            "text": F.when(langid.held_out(), F.lit("qqq www zzz")).otherwise(F.col("text")),
            "lang": F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")),
            "source": F.lit("elsewhere"),
        }
    )
    one, two = vars(langid.train(docs)), vars(langid.train(other))
    assert one.keys() == two.keys()
    for name in one:
        a, b = one[name], two[name]
        assert np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b


def test_recall_at_the_default(spark):
    rows = queries.table(spark, SMALL, "embeddings").select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    frame = queries.table(spark, SMALL, "embeddings")
    got: dict = {}
    for r in treesearch.search(frame, frame.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        best = set(ids[np.argsort(-score, kind="stable")[:20]].tolist())
        hits, total = hits + len(best & got[q]), total + len(best)
    assert hits / total >= 0.9


def test_language_labels_need_little_memory():
    """Every worker of an executor holds this beside what earlier stages left in it."""
    dice = random.Random(1)
    words = ["".join(dice.choices("abcdefghijklmnop", k=dice.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(dice.choices(words, k=330)) for _ in range(5000)]
    table = np.random.default_rng(0).normal(size=(langid.BUCKETS, 4)).astype(np.float32)
    model = langid.Model(list("abcd"), table, np.ones((len(langid.NAMES), 4), dtype=bool))
    whole = langid.label(texts[:50], model)
    tracemalloc.start()
    found = langid.label(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:50] == whole
    assert peak < 80e6
