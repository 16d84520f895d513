import corpus_pipeline
import pytest
from helpers import odd_documents
from stemledger.llm import langid, mixing, nearsets, packing, secrets
from stemledger.llm.queries import QUERIES, table, vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages_take_odd_rows_and_keep_the_columns(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.collect()


def test_each_stage_does_what_its_operator_says(spark):
    docs = table(spark, SMALL, "documents")
    kept = corpus_pipeline.language(spark, docs, SMALL)
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["lang_pred"] != "und" and r["score"] >= 0.3}
    near = corpus_pipeline.near_copies(spark, kept, SMALL)
    groups = nearsets.classes(kept).collect()
    assert sorted(r["doc_id"] for r in near.collect()) == sorted({r["component_id"] for r in groups})
    masked = corpus_pipeline.secret_scan(spark, near, SMALL)
    assert masked.count() == near.count()
    left = secrets.digest(masked).agg({"n_hex": "sum", "n_access": "sum", "n_assign": "sum"}).first()
    assert sum(left) == 0
    mixed = corpus_pipeline.mixture(spark, masked, SMALL)
    assert mixed.count() == mixing.mix(masked).count()
    out = corpus_pipeline.run(spark, SMALL).collect()
    want = packing.pieces(mixed, vocabulary()).collect()
    strip = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert strip(out) == strip(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
