"""Many datasets mapped by one table of mappings."""

import time

import pytest
from pyspark.sql import functions as F

from stemledger.operators import many, mapping
from stemledger.plans import harmonize as plans
from stemledger.plans.submission import Metadata, Submission, load_mappings, mapping_table, save_submission

IDS = [mapping.Column("p", "PlotID"), mapping.Column("t", "TreeID"), mapping.Column("y", "YR"), mapping.Column("d", "DBH")]


def raw(spark, rows):
    return spark.createDataFrame(rows, "dsn string, cells map<string, string>")


def test_same_rows_as_one_plan_per_dataset(spark):
    cells = [
        {"p": f"P{i % 3}", "t": f"T{i % 7}", "y": str(2000 + i % 4) if i % 9 else "n.d.", "d": str(i) if i % 5 else "NA",
         "s": "ABC"[i % 3], "k": f"{i % 4}.0"}
        for i in range(80)
    ]
    codes = [mapping.StatusCode("A", "0"), mapping.StatusCode("B", "1")]
    subs = [
        Submission("in_a", IDS, metadata=Metadata(dbh_unit="mm")),
        Submission("in_b", [*IDS, mapping.Column("s", "Status"), mapping.Literal("oak", "Species")], codes),
        Submission("in_c", IDS, metadata=Metadata(census_type="single")),
        Submission("in_d", [*IDS[:2], mapping.Concat(["p", "t"], "Species", prefix="Q")], wide_pairs=[("d", 2001), ("k", 2005)]),
    ]
    work = plans.harmonize_many(raw(spark, [(s.dsn, c) for s in subs for c in cells]), mapping_table(spark, subs), tie_break=["DBH"])
    out = ["dsn", "PlotID", "TreeID", "YR", "PrevYR", "DBH", "Status"]
    got = [tuple(r) for r in work.prepared.select(*out).collect()]
    want, found = [], []
    names = ", ".join(f"{c} string" for c in cells[0])
    for sub in subs:
        one = spark.createDataFrame([tuple(c.values()) for c in cells], names)
        single = plans.harmonize(one, sub, tie_break=["DBH"])
        frame = single.prepared if "PrevYR" in single.prepared.columns else single.prepared.withColumn("PrevYR", F.lit(None).cast("int"))
        want += [tuple(r) for r in frame.select(*out).collect()]
        found += [(r.dsn, r.rule, r.row_count) for r in single.findings().collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted((r.dsn, r.rule, r.row_count) for r in work.findings().collect()) == sorted(found)


def test_lookups_are_one_join_and_repeat_rows(spark):
    exprs = [*IDS, mapping.Lookup("x.csv", "k", "key", "a", "PA"), mapping.Lookup("x.csv", "k", "key", "b", "Latitude"),
             mapping.Literal("1.5", "Longitude")]
    cells = {"p": "P", "t": "T", "y": "2000", "d": "1", "k": "01.0"}
    lookups = spark.createDataFrame(
        [("in_a", "1", 0.5, 7.0, 9.0), ("in_a", "1", 0.25, 8.0, 9.0), ("in_b", "1", 9.0, 9.0, 9.0), ("in_a", "2", 3.0, 3.0, 3.0)],
        "dsn string, lookup_key string, PA double, Latitude double, Longitude double",
    )
    df = many.map_datasets(raw(spark, [("in_a", cells)]), mapping_table(spark, [Submission("in_a", exprs)]), lookups)
    assert sorted((r.PA, r.Latitude, r.Longitude) for r in df.collect()) == [("0.25", "8.0", "1.5"), ("0.5", "7.0", "1.5")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


@pytest.mark.parametrize(
    ("sub", "problem"),
    [
        (Submission("a", IDS, [mapping.StatusCode("x", "0"), mapping.StatusCode("x", "0")]), "code listed twice: x"),
        (Submission("a", [*IDS, mapping.Literal("1", "DBH")]), "field mapped twice: DBH"),
        (Submission("a", [mapping.Column("p", "Nope")]), "not a field: Nope"),
        (Submission("a", IDS, wide_pairs=[("a", 2000), ("b", 2000)]), "census listed twice: 2000"),
        (Submission("a", []), "no mapping: a"),
        (Submission("a", IDS, metadata=Metadata(dbh_unit="inch")), "unknown unit: inch"),
        (Submission("a", [*IDS, mapping.Lookup("f", "k", "key", "v", "PA")]), "no lookup table: PA"),
    ],
)
def test_ambiguous_mappings_are_refused(spark, sub, problem):
    with pytest.raises(many.BadMappings, match=problem):
        plans.harmonize_many(raw(spark, [("a", {"p": "1"})]), mapping_table(spark, [sub]))


def test_a_dataset_mapped_twice_is_refused(spark):
    with pytest.raises(many.BadMappings, match="dataset mapped twice"):
        many.check_mappings(mapping_table(spark, [Submission("a", IDS), Submission("a", IDS)]))


def test_stored_mappings_are_read_as_rows(spark, folder):
    for dsn in ("in_a", "in_b"):
        save_submission(spark, Submission(dsn, IDS, [mapping.StatusCode("x", "1")]), f"{folder}/m")
    rows = load_mappings(spark, f"{folder}/m").orderBy("dsn").collect()
    assert [r.dsn for r in rows] == ["in_a", "in_b"]
    assert [(e.target, e.kind, e.sources) for e in rows[0].exprs][:1] == [("PlotID", "column", ["p"])]


def test_a_thousand_datasets_are_one_small_plan(spark):
    def planned(n):
        subs = [
            Submission(f"d{i}", [mapping.Column(f"{c}{i}", t) for c, t in zip("ptyd", ("PlotID", "TreeID", "YR", "DBH"))])
            for i in range(n)
        ]
        cells = [
            (f"d{i}", {f"p{i}": "P", f"t{i}": f"T{j}", f"y{i}": str(y), f"d{i}": "3"})
            for i in range(n) for j in (1, 2) for y in (1, 2)
        ]
        mappings, rows = mapping_table(spark, subs), raw(spark, cells)
        start = time.perf_counter()
        final = plans.harmonize_many(rows, mappings).final()
        final._jdf.queryExecution().executedPlan()
        return final, time.perf_counter() - start

    few, warm = planned(5)
    final, seconds = planned(1000)
    # on an idle machine both take a few seconds; what counts is that the number of datasets adds little
    assert seconds < 2 * warm + 3
    nodes = lambda d: d._jdf.queryExecution().analyzed().toString().count("\n")
    assert nodes(final) == nodes(few)
    assert final.count() == 2000


def test_a_code_listed_twice_in_a_table_fails_the_job(spark):
    df = spark.createDataFrame([("d", "x")], "dsn string, Status string")
    codes = spark.createDataFrame([("d", "x", "0"), ("d", "x", "1")], "dsn string, source string, target string")
    with pytest.raises(Exception, match="listed twice"):
        mapping.remap_status_by_table(df, codes).collect()


def test_exact_keys(spark):
    same = [["1", "1.0", "01", " 1e0 ", "10e-1", "+1"], ["0", "-0", "0.000"], ["120", "1.2e2", "0120.0"], ["-5e-7", "-0.0000005"]]
    apart = ["1.0000001", "1.0000002", "1e-7", "2e-7", "123456789012345678901", "123456789012345678902", "x1", "1e99999999999", ""]
    texts = [t for group in same for t in group] + apart
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    keys = {r.t: r.k for r in df.select("t", mapping.exact_key(F.col("t"), df.schema["t"].dataType).alias("k")).collect()}
    assert [len({keys[t] for t in group}) for group in same] == [1] * len(same)
    assert len({keys[t] for t in [*(g[0] for g in same), *apart]}) == len(same) + len(apart)
    n = spark.createDataFrame([(0, 0.0), (120, 120.0), (-300, -300.0), (7, 7.0), (10**15, 1e15)], "i bigint, d double")
    types = {f.name: f.dataType for f in n.schema}
    for r in n.select(*[mapping.exact_key(F.col(c), types[c]).alias(c) for c in "id"]).collect():
        assert r.i == r.d


def test_rows_of_few_datasets_are_not_dealt_out_by_dataset(spark):
    """Three datasets would be three tasks, with all rows among them."""
    subs = [Submission(d, [IDS[0], mapping.YearOf("y")]) for d in "abc"]
    rows = raw(spark, [(d, {"p": "1", "y": "2001", "z": "7", "a": None}) for d in "abc"])
    df = many.map_datasets(rows, mapping_table(spark, subs))
    assert "Exchange hashpartitioning(dsn" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.PlotID, r.YR, [tuple(e) for e in r.extras]) for r in df.collect()] == [("1", "2001", [("a", None), ("y", "2001"), ("z", "7")])] * 3


def test_rows_are_mapped_once(spark):
    """Trees, plots and rows are read from the staged rows, not mapped again for each."""
    work = plans.harmonize_many(raw(spark, [("a", {"p": "1", "t": "2", "y": "2001", "d": "3"})]), mapping_table(spark, [Submission("a", IDS)]))
    assert "cells" not in work.prepared._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.PlotID, r.TreeID, r.YR, r.DBH) for r in work.final().collect()] == []  # a lone first row without a link goes
    assert [(r.PlotID, r.TreeID, r.YR, r.DBH) for r in work.prepared.collect()] == [("1", "2", 2001, 3.0)]
