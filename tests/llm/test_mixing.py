import math
from collections import defaultdict

from helpers import documents, odd_documents
from pyspark.sql import functions as F
from stemledger.llm import mixing


def spread(spark, sizes):
    texts = [(f"s{k}", "x" * (4 * (1 + i % 5))) for k, n in enumerate(sizes) for i in range(n)]
    docs = documents(spark, [t for _, t in texts])
    names = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(texts)], "doc_id long, source string")
    return docs.drop("source").join(names, "doc_id")


def test_budgets_are_met_to_less_than_a_document(spark):
    docs = spread(spark, [600, 200, 60, 20])
    rows = mixing.mix(docs, repetition=3.0, block_tokens=50).collect()
    tokens, drawn, copies = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in docs.withColumn("t", mixing.estimated_tokens()).collect():
        tokens[r["source"]] += r["t"]
    for r in rows:
        drawn[r["source"]] += r["_tokens"]
        assert r["_epoch"] not in copies[r["doc_id"]]
        copies[r["doc_id"]].add(r["_epoch"])
    x = mixing.exponent(docs.withColumn("tokens", mixing.estimated_tokens()).groupBy("source").agg(F.sum("tokens").alias("tokens")), repetition=3.0)
    total = sum(tokens.values())
    power = {s: (t / total) ** x for s, t in tokens.items()}
    for s, t in tokens.items():
        budget = math.floor(power[s] / sum(power.values()) * total + 0.5)
        assert abs(drawn[s] - budget) < 5, (s, budget, drawn[s])
        assert budget / t <= 3.0 + 1e-3
    assert max(len(c) for c in copies.values()) == 3


def test_no_source_vanishes_with_its_only_document(spark):
    for sizes in ([400, 400], [4000, 40], [40, 400, 4000, 40000]):
        docs = documents(spark, ["x" * n for n in sizes]).withColumn("source", F.concat(F.lit("s"), "doc_id"))
        assert {r["source"] for r in mixing.mix(docs).collect()} == {f"s{i}" for i in range(len(sizes))}


def test_entropy_target(spark):
    sizes = spark.createDataFrame([("a", 80.0), ("b", 15.0), ("c", 5.0)], "source string, tokens double")
    x = mixing.exponent(sizes, repetition=None, entropy=0.9)
    power = [p**x for p in (0.8, 0.15, 0.05)]
    w = [p / sum(power) for p in power]
    assert abs(-sum(p * math.log(p) for p in w) - 0.9) < 1e-6
    assert mixing.exponent(sizes, repetition=None, entropy=0.1) == 1.0


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = mixing.mix(docs, repetition=1.0)
    assert out.count() == docs.count()
    assert [c for c in out.columns if c in docs.columns] == docs.columns[:8] + docs.columns[9:] + ["_block"]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_query_matches_sql(spark):
    import compare
    from stemledger.llm.queries import ORACLES, QUERIES

    con = compare.duck(compare.DATA)
    df = QUERIES["op7_mixing"](spark, compare.DATA)
    assert compare.spark_rows(df) == compare.duck_rows(con, ORACLES["op7_mixing"])
