"""Rule cases, verdicts, flags and the export clean-up."""

import pytest

from stemledger.operators import census, finalize, validate

SCHEMA = "dsn string, PlotID string, TreeID string, YR int, PrevYR int, Status string, DBH double"


def frame(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], SCHEMA)


CASES = {
    "clean": ([("P1", "T1", 2010, None, "0", 10.0), ("P1", "T1", 2015, 2010, "0", 11.0)], []),
    "dead with diameter": ([("P1", "T1", 2015, 2010, "1", 10.0)], ["DeadTreeHasDbh"]),
    "recruit without diameter": (
        [("P1", "T1", 2015, None, "2", None)], ["RecruitMissingDbh", "RecruitAtMinYear"],
    ),
    "orphan dead": ([("P1", "T1", 2010, None, "1", None)], ["OrphanDeadFirstCensus"]),
    "unknown status": ([("P1", "T1", 2015, 2010, "alive", 12.0)], ["UnknownStatus"]),
    "null status": ([("P1", "T1", 2015, 2010, None, 12.0)], []),
    "copies": (
        [("P1", "T1", 2015, 2010, "0", 1.0), ("P1", "T1", 2015, 2010, "0", 2.0)],
        ["DuplicateTreeWithinPlotYear"],
    ),
    "copies without plot": (
        [(None, "T1", 2015, 2010, "0", 1.0), (None, "T1", 2015, 2010, "0", 2.0)], [],
    ),
    "recruit after the first year": (
        [("P1", "T1", 2010, None, "0", 1.0), ("P1", "T1", 2015, 2010, "2", 2.0)], [],
    ),
}


@pytest.mark.parametrize("name", list(CASES))
def test_rules(spark, name):
    rows, expected = CASES[name]
    found = validate.findings(frame(spark, *rows)).orderBy("position").collect()
    assert [f.rule for f in found] == expected
    assert all(f.row_count == 1 for f in found)


def test_single_census_needs_no_link(spark):
    df = frame(spark, ("P1", "T1", 2015, None, "0", 10.0), ("P1", "T2", 2015, None, "1", None))
    assert validate.findings(df.drop("PrevYR"), "single").count() == 0


def test_linkage_rule_fires_only_without_repeated_trees(spark):
    apart = frame(spark, ("P", "A", 2000, None, "0", 1.0), ("P", "B", 2005, None, "0", 1.0))
    found = validate.findings(apart, check_linkage=True).first()
    assert (found.rule, found.row_count) == ("NoPersistentTreeId", 2)
    linked = apart.unionByName(frame(spark, ("P", "A", 2005, 2000, "0", 1.0)))
    assert validate.findings(linked, check_linkage=True).count() == 0


def test_unknown_values_are_counted_in_the_message_and_listed_as_rows(spark):
    df = frame(spark, *[("P", f"T{i}", 2000, None, f"code{i}", 1.0) for i in range(70)])
    assert validate.with_unknown_values(validate.findings(df), df).first().message.endswith("Found 70 values.")
    assert validate.unknown_values(df).count() == 70


def test_verdict_covers_clean_datasets(spark):
    bad = frame(spark, ("P", "T", 2000, 1995, "1", 1.0))
    clean = frame(spark, ("P", "T", 2000, 1995, "0", 1.0)).replace("d", "e", "dsn")
    both = bad.unionByName(clean)
    got = {r.dsn: (r.is_clean, r.has_blocking) for r in validate.verdict(validate.findings(both), both).collect()}
    assert got == {"d": (False, False), "e": (True, False)}


def test_flags_name_every_broken_rule(spark):
    df = frame(
        spark,
        ("P", "A", 2000, None, "2", None),
        ("P", "A", 2000, None, "1", 4.0),
        ("P", "A", 2005, 2000, "0", 4.0),
    )
    got = {r.Status: r.flags for r in validate.flag_rows(df).collect()}
    assert got == {
        "2": ["DuplicateTreeWithinPlotYear", "RecruitMissingDbh", "RecruitAtMinYear"],
        "1": ["DuplicateTreeWithinPlotYear", "DeadTreeHasDbh", "OrphanDeadFirstCensus"],
    }


def test_vocabulary_column_falls_back(spark):
    df = frame(spark, ("P", "A", 2000, None, "x", 1.0))
    assert validate.vocabulary_column(df) == "Status"
    assert validate.vocabulary_column(df.withColumnRenamed("Status", "fate"), mapped="fate") == "fate"
    with pytest.raises(ValueError):
        validate.vocabulary_column(df, "nothing")


def test_anchor_rows_are_dropped(spark):
    df = frame(
        spark,
        ("P1", "T1", 2010, None, "0", 10.0),
        ("P1", "T1", 2015, 2010, "0", 11.0),
        ("P1", "T2", 2010, None, "0", 8.0),
    )
    assert finalize.drop_anchors(df).count() == 1


def test_unknown_and_null_status_become_missing(spark):
    df = frame(spark, ("P", "T", 2015, 2010, "n/a", 10.0), ("P", "U", 2015, 2010, None, 10.0))
    assert [r.Status for r in finalize.recode_unknown(df).collect()] == ["9", "9"]


def test_finalize_is_one_filter_and_keeps_only_valid_rows(spark):
    df = frame(
        spark,
        ("P", "A", 2010, None, "0", 1.0),
        ("P", "A", 2015, 2010, "1", 1.0),
        ("P", "B", 2015, None, "1", None),
        ("P", "C", 2015, None, "2", None),
        ("P", "D", 2015, None, None, 3.0),
    )
    final = finalize.finalize(df)
    got = {r.TreeID: (r.Status, r.DBH) for r in final.collect()}
    assert got == {"A": (1, None), "D": (9, 3.0)}
    assert dict(final.dtypes)["Status"] == "int"
    assert final._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1
    assert finalize.finalize(df, "single").count() == 4


def test_each_dataset_is_judged_and_cleaned_by_its_own_census_type(spark):
    rows = [
        ("s", "P", "A", 2000, None, "0", 1.0), ("s", "P", "B", 2000, None, "1", None),
        ("m", "P", "A", 2000, None, "0", 1.0), ("m", "P", "A", 2005, 2000, "0", 2.0),
        ("m", "P", "B", 2000, None, "1", None), ("n", "P", "A", 2000, None, "0", 1.0),
    ]
    types = spark.createDataFrame([("s", "single"), ("m", None), ("x", "single")], "dsn string, census_type string")
    df = census.with_census_type(spark.createDataFrame(rows, SCHEMA), types)
    kind = df["census_type"]
    found = validate.findings(df, kind, check_linkage=True).collect()
    assert {(f.dsn, f.rule) for f in found} == {("m", "OrphanDeadFirstCensus"), ("n", "NoPersistentTreeId")}
    assert {(r.dsn, r.TreeID) for r in validate.flag_rows(df, kind).collect()} == {("m", "B")}
    kept = finalize.finalize(df, kind).collect()
    assert {(r.dsn, r.TreeID, r.YR) for r in kept} == {("s", "A", 2000), ("s", "B", 2000), ("m", "A", 2005)}
    linked = {(r.dsn, r.TreeID, r.YR): r.PrevYR for r in census.prepare(df, kind).collect()}
    assert linked[("m", "A", 2005)] == 2000 and linked[("s", "A", 2000)] is None


def test_flags_of_rows_that_are_not_linked_yet(spark):
    rows = [
        ("P", "A", 2000, None, "2", None), ("P", "A", 2000, None, "1", 4.0), ("P", "A", 2005, 2000, "1", None),
        ("P", "B", None, None, "1", None), ("P", "B", None, None, "1", None), ("P", "B", 2001, None, "2", 1.0),
        (None, "C", 2001, None, "0", 1.0), (None, "C", 2001, None, "0", 1.0), ("P", None, 2001, None, "1", None),
        ("P", "D", 2001, None, "0", 1.0), ("P", "D", 2002, 2001, "0", 1.0),
    ]
    df = frame(spark, *rows)
    key = lambda r: (str(r.TreeID), str(r.YR), r.Status, str(r.DBH))
    linked = sorted((key(r), r.flags) for r in validate.flag_rows(df).collect())
    unlinked = sorted((key(r), r.flags) for r in validate.flag_rows(df.drop("PrevYR")).collect())
    assert linked == unlinked
    assert dict((k, f) for k, f in linked)[("B", "None", "1", "None")] == ["DuplicateTreeWithinPlotYear", "OrphanDeadFirstCensus"]
    found = lambda d: sorted((f.rule, f.row_count) for f in validate.findings(d).collect())
    assert found(df) == found(df.drop("PrevYR"))
    assert [r.flags for r in validate.flag_rows(df.drop("PrevYR", "Status")).collect()] == [["DuplicateTreeWithinPlotYear"]] * 4


def test_flags_need_two_scans_and_one_join(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/flags"
    frame(spark, ("P", "A", 2000, None, "2", None)).write.mode("overwrite").parquet(path)
    plan = validate.flag_rows(spark.read.parquet(path).drop("PrevYR"))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan") <= 2
    assert sum("Join" in line for line in initial.splitlines()) == 1


def test_few_trees_found_again_are_a_finding_too(spark):
    rows = [("P", f"A{y}-{i}", y, None, "0", 1.0) for y in (2000, 2005) for i in range(30)]
    rows += [("P", "same", y, None, "0", 1.0) for y in (2000, 2005)]
    df = frame(spark, *rows, ("Q", "x", 2001, None, "0", 1.0), ("Q", "x", None, None, "0", 1.0))
    assert [tuple(r) for r in validate.linkage_rates(df).collect()] == [("d", 2000, 2005, 31, 1)]
    assert [(f.rule, f.row_count) for f in validate.linkage_findings(df).collect()] == [("NoPersistentTreeId", 30)]
    assert validate.linkage_findings(df, least=0.01).count() == 0
    assert validate.linkage_findings(df, "single").count() == 0
    assert validate.findings(df, check_linkage=True).where("rule = 'NoPersistentTreeId'").count() == 0
