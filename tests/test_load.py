"""Loading: one pass stages, counts and judges; a failing table is refused by the plans."""

import pytest

from stemledger.operators import gate, mapping
from stemledger.plans import harmonize as plans
from stemledger.plans.load import StructureError, load, load_frame
from stemledger.plans.submission import Submission


def write(path, text):
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return path


def test_one_pass_over_the_source(spark, folder):
    reads = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("CAST(id AS STRING) AS plot", "CAST(NULL AS STRING) AS diam").mapInArrow(watched, "plot string, diam string")
    loaded = load_frame(df)
    assert reads.value == 100
    assert (loaded.n_rows, loaded.filled) == (100, {"plot": 100, "diam": 0})
    assert loaded.suggestions == {"plot": "PlotID", "diam": "DBH"}
    assert len(loaded.preview) == 10
    assert loaded.table.count() == 100 and reads.value == 100


def test_all_problems_of_a_file(spark, folder):
    path = write(f"{folder}/a.csv", "A,,A,spacer,tree\n1,2,3,,5\n1,2,3,,5\n")
    loaded = load(spark, path)
    assert [(e.problem, e.header) for e in loaded.errors] == [
        ("duplicate_header", "A"), ("blank_header", ""), ("all_null_column", "spacer"),
    ]
    assert loaded.header == ["A", "", "A", "spacer", "tree"]
    assert [r.problem for r in loaded.report().orderBy("ordinal").collect()] == [None, None, None, "all_null_column", None]


def test_same_verdict_as_the_gate(spark, folder):
    for i, text in enumerate(["a,b\n", "a,b\n1,2\n", "a,a\n,\n", "a\n\n", ""]):
        path = write(f"{folder}/{i}.csv", text)
        loaded = load(spark, path)
        expected = gate.check(loaded.table, loaded.header) if loaded.table.columns else [gate.GateError("empty")]
        assert list(loaded.errors) == expected


def test_plans_refuse_a_failing_table(spark, folder):
    submission = Submission("in_a", [mapping.Column(c, c) for c in ("PlotID", "TreeID", "YR", "DBH")])
    good = load(spark, write(f"{folder}/good.csv", "PlotID,TreeID,YR,DBH\nP,T,2000,1\n"))
    assert plans.harmonize(good, submission).prepared.count() == 1
    bad = load(spark, write(f"{folder}/bad.csv", "PlotID,TreeID,YR,DBH,x\nP,T,2000,1,\n"))
    with pytest.raises(StructureError, match="'x'"):
        plans.harmonize(bad, submission)
    with pytest.raises(StructureError):
        plans.diagnose(bad, "in_a")
