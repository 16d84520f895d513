"""Folders of text files with headers of their own: read by name, catalogued, as many datasets."""

import os

import pytest

from stemledger.operators import gate
from stemledger.sources import folders, readers


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_values_are_taken_by_name(spark, folder):
    write(f"{folder}/t.csv/a.csv", "PlotID,TreeID\nP1,T1\n")
    write(f"{folder}/t.csv/b.csv", "TreeID,PlotID\nT2,P2\n")
    df = readers.read_table(spark, f"{folder}/t.csv")
    assert df.columns == ["PlotID", "TreeID"]
    assert rows(df) == [("P1", "T1"), ("P2", "T2")]


def test_columns_missing_extra_repeated_blank_and_in_another_case(spark, folder):
    write(f"{folder}/x y/a.csv", 'PlotID,"d, cm",\nP1,1,z\n\nP2,2\n')
    write(f"{folder}/x y/b%20c.csv", "﻿note,plotid,note\nn1,P3,n2,beyond\nnote,plotid,note\n", "utf-8")
    df = readers.read_table(spark, f"{folder}/x y", "csv")
    assert df.columns == ["PlotID", "d, cm", "_c2", "note0", "note2"]
    assert rows(df) == [
        ("P1", "1", "z", None, None), ("P2", "2", None, None, None),
        ("P3", None, None, "n1", "n2"), ("plotid", None, None, "note", "note"),
    ]


def test_folder_header_keeps_what_any_file_does_wrong(spark, folder):
    write(f"{folder}/t/a.csv", "A,B\n1,2\n")
    write(f"{folder}/t/b.csv", "B,,A,A\n1,2,3,4\n")
    header = readers.raw_header(spark, f"{folder}/t", "csv")
    assert header == ["A", "A", "B", ""]
    assert [e.problem for e in gate.header_errors(header)] == ["duplicate_header", "blank_header"]


def test_files_that_agree_are_read_without_a_join(spark, folder):
    for i in range(3):
        write(f"{folder}/t/{i}.csv", f"a,b\n{i},x\n")
    df = readers.read_table(spark, f"{folder}/t", "csv")
    assert rows(df) == [("0", "x"), ("1", "x"), ("2", "x")]
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_files_have_one_header_over_all_their_splits(spark, folder):
    n = 4000
    write(f"{folder}/t/a.csv", "k,v\n" + "".join(f"{i},a{i}\n" for i in range(n)))
    write(f"{folder}/t/b.csv", "v,k\n" + "".join(f"b{i},{i}\n" for i in range(n)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = readers.read_table(spark, f"{folder}/t", "csv")
        assert df.rdd.getNumPartitions() > 4
        assert rows(df) == sorted([(str(i), f"{f}{i}") for i in range(n) for f in "ab"], key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_comments_multiline_tsv_and_patterns(spark, folder):
    write(f"{folder}/t/a.tsv", "# made by\na\tb\n1\t\"two\nlines\"\n")
    write(f"{folder}/t/b.tsv", "b\ta\n3\t4\n")
    df = readers.read_table(spark, f"{folder}/t/*.tsv", multiline=True, comment="#")
    assert rows(df) == [("1", "two\nlines"), ("4", "3")]


def test_partition_columns_and_empty_files_stay(spark, folder):
    write(f"{folder}/t/dsn=x/a.csv", "a,b\n1,2\n")
    write(f"{folder}/t/dsn=y/b.csv", "b,a\n3,4\n")
    write(f"{folder}/t/dsn=y/c.csv", "")
    df = readers.read_table(spark, f"{folder}/t", "csv")
    assert rows(df) == [("1", "2", "x"), ("4", "3", "y")]


def test_catalogue_keeps_files_of_the_same_name_apart(spark, folder):
    for name in ("a.csv", "A2.CSV", "sub/a.csv", "sub/b.csv", "sub/b.tsv", "c d/e%f+g.csv"):
        write(f"{folder}/t/{name}", "x,y\n1,2\n")
    got = readers.header_catalogue(spark, f"{folder}/t").collect()
    assert {r.dsn for r in got} == {"a", "A2", "sub/a", "sub/b.csv", "sub/b.tsv", "c d/e%f+g"}
    assert sorted((r.ordinal, r.header) for r in got if r.dsn == "sub/a") == [(0, "x"), (1, "y")]
    assert [(r.ordinal, r.header) for r in got if r.dsn == "sub/b.tsv"] == [(0, "x,y")]


def test_each_file_as_a_dataset(spark, folder):
    write(f"{folder}/t/a.csv", "x,y\n1,2\n")
    write(f"{folder}/t/sub/b.csv", "z\n3\n4\n")
    got = {(r.dsn, tuple(sorted(r.cells.items()))) for r in folders.read_datasets(spark, f"{folder}/t", "csv").collect()}
    assert got == {("a", (("x", "1"), ("y", "2"))), ("sub/b", (("z", "3"),)), ("sub/b", (("z", "4"),))}


def test_upper_case_workbooks_are_found(spark, folder):
    from stemledger.sinks.provenance import Provenance
    from stemledger.sinks.writers import workbook_bytes

    import pandas as pd

    with open(f"{folder}/X.XLSX", "wb") as out:
        out.write(workbook_bytes(pd.DataFrame({"a": ["1"]}), Provenance.draft("d", "2024-01-31T00:00:00+00:00")))
    assert rows(readers.read_table(spark, f"{folder}/X.XLSX")) == [("1",)]


def test_a_missing_folder_is_reported(spark, folder):
    with pytest.raises(Exception, match="(?i)does not exist|path"):
        readers.read_table(spark, f"{folder}/none.csv").count()


def test_header_lines_are_found_without_sorting_lines(spark, folder):
    for i in range(30):
        write(f"{folder}/f{i:02}.csv", f"\n \na{i},b\n" + "1,2\n" * (25_000 if i == 3 else i))
    found = folders.layouts(spark, folder)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.dsn, r.header) for r in found.collect()) == [(f"f{i:02}", [f"a{i}", "b"]) for i in range(30)]
