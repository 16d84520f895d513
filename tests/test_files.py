"""Reading and writing files: formats, headers, provenance, workbooks, logs, whole plans."""

import glob
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from stemledger.operators import census, gate, mapping, status
from stemledger.plans import harmonize as plans
from stemledger.plans.submission import Metadata, Submission, load_submission, save_submission
from stemledger.sinks import curation_log, writers
from stemledger.sinks.provenance import Provenance, draft_name
from stemledger.sources import readers, workbook
from stemledger.streaming.intake import collect_arrivals, collect_unread

STAMP = Provenance.draft("in_per_ruiz_2020_m", "2024-01-31T00:00:00+00:00")


def write(path, text):
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
    return str(path)


# --- sources -------------------------------------------------------------------------


def test_csv_is_text_with_quotes_and_nulls(spark, folder):
    path = write(f"{folder}/a.CSV", 'Plot,Tag,d\nP1,"say ""x"", y",007\nP2,,\n')
    rows = readers.read_table(spark, path).collect()
    assert [tuple(r) for r in rows] == [("P1", 'say "x", y', "007"), ("P2", None, None)]


def test_tsv_and_multiline(spark, folder):
    path = write(f"{folder}/a.tsv", "a\tb\n1\t2\n")
    assert readers.read_table(spark, path).first().b == "2"
    broken = write(f"{folder}/b.csv", 'a,b\n"two\nlines",3\n')
    assert readers.read_table(spark, broken, multiline=True).first().a == "two\nlines"


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_table(spark, "/tmp/x.docx")


def test_raw_header_keeps_blanks_and_repeats(spark, folder):
    path = write(f"{folder}/a.csv", "A,,A,column_4\n1,2,3,4\n")
    assert readers.raw_header(spark, path) == ["A", "", "A", "column_4"]


def test_header_catalogue_reads_every_file(spark, folder):
    for i in range(3):
        write(f"{folder}/set{i}.csv", f'Plot,"a, b",c{i}\n1,2,3\n')
    write(f"{folder}/tab.tsv", "x\ty\n")
    got = readers.header_catalogue(spark, folder).collect()
    assert {(r.dsn, r.ordinal): r.header for r in got} == {
        **{(f"set{i}", j): h for i in range(3) for j, h in enumerate(["Plot", "a, b", f"c{i}"])},
        ("tab", 0): "x", ("tab", 1): "y",
    }


def test_preview_is_text(spark):
    rows = readers.preview(spark.range(30).selectExpr("id", "CAST(NULL AS INT) AS n"), 10).collect()
    assert len(rows) == 10 and rows[0].n is None and isinstance(rows[0].id, str)


# --- workbooks -----------------------------------------------------------------------


def test_workbook_round_trip(spark, folder):
    df = spark.createDataFrame(
        [("in_a", "P1", "T & <1>", 2010, 10.5, True), ("in_a", "P1", " T2 ", 2015, None, False),
         ("in_b", "P1", "T1", 2010, 7.0, None)],
        "dsn string, PlotID string, TreeID string, YR int, DBH double, ok boolean",
    )
    done = writers.write_workbooks(df, folder, lambda dsn, file: f"{dsn}.xlsx", STAMP).collect()
    assert {(r.dsn, r.row_count) for r in done} == {("in_a", 2), ("in_b", 1)}
    assert not glob.glob(f"{folder}/*.partial")
    back = readers.read_table(spark, f"{folder}/in_a.xlsx")
    assert back.columns == df.columns
    assert sorted(tuple(r) for r in back.collect()) == [
        ("in_a", "P1", " T2 ", "2015", None, "false"), ("in_a", "P1", "T & <1>", "2010", "10.5", "true"),
    ]
    with zipfile.ZipFile(f"{folder}/in_b.xlsx") as book:
        stamp = book.read("xl/worksheets/sheet2.xml").decode()
    assert "in_b" in stamp and "draft" in stamp and STAMP.timestamp in stamp
    everything = workbook.read_workbooks(spark, f"{folder}/*.xlsx")
    assert everything.count() == 5
    headers = workbook.workbook_catalogue(spark, folder)
    assert {r.dsn for r in headers.collect()} == {"in_a", "in_b"}


def test_large_dataset_becomes_several_workbooks(spark, folder):
    df = spark.range(300).selectExpr(
        "'x' AS dsn", "concat('P', id % 7) AS PlotID", "concat('T', id) AS TreeID", "2000 AS YR"
    )
    done = writers.write_workbooks(df, folder, lambda d, f: f"{d}_{f}.xlsx", STAMP, rows_per_workbook=100).collect()
    assert len(done) == 3 and sum(r.row_count for r in done) == 300


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>  </t></is></c></row>
<row r="3"><c r="B3"><v>10</v></c><c r="D3" t="b"><v>1</v></c></row>
<row r="4"><c r="B4"><v>2.50</v></c></row>{more}</sheetData></worksheet>"""


def foreign_workbook(path, sheet=SHEET.format(more="")):
    """A workbook as other programs write it: shared strings, offsets, sparse rows."""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", writers._WORKBOOK)
        book.writestr("xl/_rels/workbook.xml.rels", writers._WORKBOOK_RELATIONS)
        book.writestr(
            "xl/sharedStrings.xml",
            '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
            "<si><t>Plot</t></si><si><r><t>Tr</t></r><r><t>ee</t></r></si></sst>",
        )
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return path


def test_foreign_workbook(spark, folder):
    path = foreign_workbook(f"{folder}/f.xlsx")
    assert readers.raw_header(spark, path) == ["Plot", "Tree", ""]
    rows = [tuple(r) for r in readers.read_table(spark, path).collect()]
    assert rows == [("10", None, "true"), ("2.5", None, None)]
    table = readers.read_table(spark, path)
    assert [(e.problem, e.header) for e in gate.check(table, readers.raw_header(spark, path))] == [
        ("blank_header", ""), ("all_null_column", "Tree"),
    ]


def test_workbook_without_rows_is_refused(spark, folder):
    only_header = SHEET.format(more="").split('<row r="3">')[0] + "</sheetData></worksheet>"
    path = foreign_workbook(f"{folder}/f.xlsx", only_header)
    with pytest.raises(Exception, match="no data rows"):
        readers.read_table(spark, path).collect()


# --- sinks ---------------------------------------------------------------------------


def census_rows(spark, n=500):
    return spark.range(n).selectExpr(
        "concat('P', id % 3) AS PlotID", "concat('T', id) AS TreeID", "2000 AS YR",
        "IF(id % 5 = 0, NULL, id / 2) AS DBH", "IF(id % 2 = 0, 'a, \"b\"', '') AS Species",
        "concat('in_', id % 2) AS dsn",
    )


def test_csv_parts_carry_provenance_and_header(spark, folder):
    df = census_rows(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    writers.write_csv(df, f"{folder}/x.csv", STAMP)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [open(p).read().splitlines() for p in sorted(glob.glob(f"{folder}/x.csv/part-*"))]
    parts = [p for p in parts if p]
    assert len(parts) > 1
    for lines in parts:
        assert lines[0] == STAMP.comment_line() and lines[1] == "PlotID,TreeID,YR,DBH,Species,dsn"
    back = readers.read_table(spark, f"{folder}/x.csv", fmt="csv", comment="#")
    text = [c for c in df.columns]
    assert sorted(back.collect()) == sorted(df.select(*[df[c].cast("string") for c in text]).collect())
    order = [tuple(line.split(",")[-1:] + line.split(",")[:2]) for p in parts for line in p[2:]]
    assert order == sorted(order)


def test_empty_csv_still_has_its_preamble(spark, folder):
    writers.write_csv(census_rows(spark).where("false"), f"{folder}/x.csv", STAMP)
    lines = [r.value for r in spark.read.text(f"{folder}/x.csv").collect()]
    assert lines == [STAMP.comment_line(), "PlotID,TreeID,YR,DBH,Species,dsn"]


def test_csv_by_dataset(spark, folder):
    df = census_rows(spark)
    writers.write_csv_by_dataset(df, f"{folder}/all", STAMP, rows_per_file=100)
    files = glob.glob(f"{folder}/all/dsn=*/file=*/part-*")
    assert len(files) == 6
    for path in files:
        dsn = path.split("dsn=")[1].split("/")[0]
        lines = open(path).read().splitlines()
        assert lines[0] == Provenance.draft(dsn, STAMP.timestamp).comment_line()
        assert lines[1].startswith("PlotID,")
        keys = [line.split(",")[:2] for line in lines[2:]]
        assert keys == sorted(keys) and all(line.endswith(dsn) for line in lines[2:])
    back = spark.read.option("header", True).option("comment", "#").option("escape", '"').csv(
        f"{folder}/all/dsn=*/file=*/")
    assert back.count() == 500


def test_files_are_full_but_for_the_last_whatever_the_trees(spark, folder):
    """One tree with copies of one measurement fills files like any other rows; a dataset without rows gets a header."""
    df = spark.range(1000).selectExpr(
        "CASE WHEN id < 900 THEN 'hot' ELSE 'small' END AS dsn", "'P' AS PlotID",
        "CASE WHEN id < 700 THEN 'T' ELSE concat('T', id) END AS TreeID", "2000 AS YR", "id AS DBH",
    )
    datasets = spark.createDataFrame([("hot",), ("small",), ("none",)], "dsn string")
    writers.write_csv_by_dataset(df, f"{folder}/all", STAMP, rows_per_file=100, datasets=datasets)
    sizes = {}
    for path in glob.glob(f"{folder}/all/dsn=*/file=*/part-*"):
        lines = open(path).read().splitlines()
        dsn, file = path.split("dsn=")[1].split("/")[0], path.split("file=")[1].split("/")[0]
        assert lines[0].startswith("#") and lines[1] == "dsn,PlotID,TreeID,YR,DBH"
        assert (dsn, file) not in sizes
        sizes[dsn, file] = len(lines) - 2
    assert sizes == {**{("hot", str(i)): 100 for i in range(9)}, ("small", "0"): 100, ("none", "0"): 0}
    done = writers.write_workbooks(df, folder, lambda d, f: f"{d}_{f}.xlsx", STAMP, rows_per_workbook=450).collect()
    assert sorted((r.dsn, r.file, r.row_count) for r in done) == [("hot", 0, 450), ("hot", 1, 450), ("small", 0, 100)]


def test_export_without_rows_writes_what_it_names(spark, folder):
    raw = spark.createDataFrame([("P", "T", 2000, "0", 1.0)], "PlotID string, TreeID string, YR int, Status string, DBH double")
    submission = Submission("in_a", [mapping.Column(c, c) for c in raw.columns])
    written = plans.export(plans.harmonize(raw, submission), submission, folder, "b", strict=False)
    assert all(os.path.exists(path) for path in written)
    with zipfile.ZipFile(f"{folder}/b_DRAFT.xlsx") as book:
        assert book.read("xl/worksheets/sheet1.xml").count(b"<row") == 1


def test_cells_have_references_and_numbers_a_sheet_can_hold(folder):
    import pandas as pd

    book = writers.workbook_bytes(pd.DataFrame({"a": [1.5, float("inf")], "b": ["x", "y"]}), STAMP)
    with open(f"{folder}/x.xlsx", "wb") as out:
        out.write(book)
    with zipfile.ZipFile(f"{folder}/x.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="A2"><v>1.5</v></c>' in sheet and '<c r="B3"' in sheet and "inf" not in sheet


def test_parquet_footer_and_sidecar_carry_provenance(spark, folder):
    writers.write_parquet(census_rows(spark), f"{folder}/x_DRAFT.parquet", STAMP)
    back = spark.read.parquet(f"{folder}/x_DRAFT.parquet")
    assert back.schema["PlotID"].metadata["provenance"]["dsn"] == STAMP.dsn
    sidecar = spark.read.text(f"{folder}/x_DRAFT.provenance.json").first().value
    assert json.loads(sidecar) == dict(STAMP.items())


def test_draft_marks():
    assert draft_name("x", "csv") == "x_DRAFT.csv"
    assert STAMP.build == "draft"
    assert STAMP.comment_line().startswith("# build=draft app_version=")


def test_log_layout(spark):
    datasets = spark.createDataFrame([("in_a", "Peru", "Ana Ruiz")], "dsn string, country string, contributor string")
    notes = spark.createDataFrame([("in_a", "EXCLUSIONS", 1, "plot 7")], "dsn string, section string, position int, line string")
    log = curation_log.curation_logs(datasets, [notes], "C. Urator", "2024-01-31").first().log
    assert log.startswith("DATASET: in_a\nCOUNTRY: Peru\nSITE: \nPI: \nCONTRIBUTOR: Ana Ruiz\nCURATOR: C. Urator\n")
    assert "--- EXCLUSIONS ---\n  plot 7\n--- NOTES ---\n" in log
    bare = curation_log.curation_logs(datasets, [], "", "").first().log
    assert bare.count("---\n\n") == len(curation_log.SECTIONS)


# --- whole plans ---------------------------------------------------------------------

LONG = "Plot,Tag,Year,Diam\n" + "".join(
    f"P1,{tag},{year},{dbh}\n"
    for tag, values in {
        "A": "100 110 120", "B": "NA 50 60", "D": "100 NA NA", "E": ". . .", "F": "100 110",
    }.items()
    for year, dbh in zip((2000, 2005, 2010), values.split())
) + "P1,A,2005,999\n"
WIDE = "Plot,Tag,d_2000,d_2005,d_2010\nP1,A,100,110,120\nP1,B,NA,50,60\nP1,D,100,,\n"
IDS = [mapping.Column("Plot", "PlotID"), mapping.Column("Tag", "TreeID")]


def long_submission(**metadata):
    exprs = [*IDS, mapping.Column("Year", "YR"), mapping.Column("Diam", "DBH"), mapping.Literal("1", "PA")]
    return Submission("in_per_ruiz_2020_m", exprs, metadata=Metadata(dbh_unit="mm", **metadata))


def statuses(df):
    rows = sorted(df.collect(), key=lambda r: (r.TreeID, r.YR))
    out = {}
    for r in rows:
        out[r.TreeID] = out.get(r.TreeID, "") + r.Status
    return out


def test_long_table_to_files(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", LONG))
    submission = long_submission(country="Peru", pi="A. Ruiz", census_years=(2000, 2005, 2010))
    work = plans.harmonize(raw, submission, "dead")
    assert statuses(work.prepared) == {"A": "000", "B": "920", "D": "011", "E": "999", "F": "001"}
    assert work.prepared.where("TreeID = 'A' AND YR = 2005").first().DBH == 11.0
    found = {r.rule: r.row_count for r in work.findings().collect()}
    assert found == {"DuplicateTreeWithinPlotYear": 1}
    with pytest.raises(plans.BlockedExport):
        plans.export(work, submission, folder, "ruiz")
    written = plans.export(
        work, submission, folder, "ruiz", curator="C. Urator", timestamp=STAMP.timestamp,
        strict=False, dataset_column="dataset",
    )
    assert [os.path.basename(p) for p in written] == [
        "ruiz_DRAFT.parquet", "ruiz_DRAFT.csv", "ruiz_DRAFT.xlsx", "ruiz_metadata.json",
        "ruiz_curation_log.txt",
    ]
    final = spark.read.parquet(written[0])
    assert "dataset" in final.columns and dict(final.dtypes)["Status"] == "int"
    rows = {(r.TreeID, r.YR): (r.Status, r.DBH) for r in final.collect()}
    assert rows == {
        ("A", 2005): (0, 11.0), ("A", 2010): (0, 12.0), ("B", 2000): (9, None), ("B", 2005): (2, 5.0),
        ("B", 2010): (0, 6.0), ("D", 2005): (1, None), ("D", 2010): (1, None), ("F", 2005): (0, 11.0),
        ("F", 2010): (1, None), **{("E", y): (9, None) for y in (2000, 2005, 2010)},
    }
    assert readers.read_table(spark, written[1], comment="#").count() == len(rows)
    assert readers.read_table(spark, written[2]).count() == len(rows)
    log = "\n".join(r.value for r in spark.read.text(written[4]).collect())
    assert "PI: A. Ruiz" in log and "DATE PROCESSED: 2024-01-31" in log


def test_log_holds_what_was_declared_and_left_open(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", LONG))
    base = long_submission()
    submission = Submission(
        base.dsn, base.exprs, [mapping.StatusCode("felled", "1", "logged in 2003")], metadata=base.metadata
    )
    work = plans.harmonize(raw, submission, "leave")
    written = plans.export(work, submission, folder, "x", [], strict=False, source_name="in.csv")
    log = "\n".join(r.value for r in spark.read.text(written[-1]).collect())
    assert "--- SOURCE FORMAT ---\n  in.csv\n--- PIVOT" in log
    assert "  1 trees are absent from the last census and were left unresolved." in log
    assert log.rstrip().endswith("Status 'felled' was mapped to 1: logged in 2003")


def test_many_datasets_are_delivered_at_once(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", LONG))
    ids = [Submission(f"in_{i}", long_submission().exprs, metadata=Metadata(country=f"C{i}")) for i in range(3)]
    mapped = plans.map_submission(raw, ids[0])
    for submission in ids[1:]:
        mapped = mapped.unionByName(plans.map_submission(raw, submission))
    prepared = status.derive_full(census.prepare(mapped), "none", years_from=mapped)
    notes = curation_log.disappeared_lines(status.derive_summary(census.prepare(mapped)))
    written = plans.deliver(
        prepared, plans.metadata_table(spark, ids), folder, "all", ["parquet", "csv", "xlsx"],
        curator="C. Urator", timestamp=STAMP.timestamp, notes=[notes],
    )
    final = spark.read.parquet(written[0])
    per_dataset = {r.dsn: r["count"] for r in final.groupBy("dsn").count().collect()}
    assert per_dataset == {f"in_{i}": 11 for i in range(3)}
    assert len(glob.glob(f"{written[1]}/dsn=*/file=0/part-*")) == 3
    assert readers.read_table(spark, f"{written[2]}/in_2_1_DRAFT.xlsx").count() == 11
    log = "\n".join(r.value for r in spark.read.text(f"{written[3]}/dsn=in_1").collect())
    assert "COUNTRY: C1" in log and "1 trees are absent from the last census" in log


def test_delivery_reads_census_types_judges_copies_and_leaves_blocked_datasets_out(spark, folder):
    rows = [
        ("one", "P", "A", 2000, "0", 1.0), ("one", "P", "B", 2000, "0", 2.0),
        ("two", "P", "A", 2000, "0", 1.0), ("two", "P", "A", 2005, "1", 2.0),
        ("bad", "P", "A", 2000, "0", 1.0), ("bad", "P", "A", 2005, "0", 1.0), ("bad", "P", "A", 2005, "0", 2.0),
    ]
    mapped = spark.createDataFrame(rows, "dsn string, PlotID string, TreeID string, YR int, Status string, DBH double")
    ids = [Submission("one", [], metadata=Metadata(census_type="single")), *(Submission(d, []) for d in ("two", "bad"))]
    datasets = plans.metadata_table(spark, ids)
    prepared = census.prepare(census.with_census_type(mapped, datasets), F.col("census_type")).drop("census_type")
    out = plans.deliver(prepared, datasets, folder, "all", ["parquet"], mapped=mapped)
    kept = spark.read.parquet(out[0]).select("dsn", "TreeID", "YR", "DBH").collect()
    assert {tuple(r) for r in kept} == {("one", "A", 2000, 1.0), ("one", "B", 2000, 2.0), ("two", "A", 2005, None)}
    assert [(r.dsn, r.rule) for r in spark.read.json(out[3]).collect()] == [("bad", "DuplicateTreeWithinPlotYear")]
    flagged = sorted((r.dsn, r.YR, r.DBH, r.flags) for r in spark.read.parquet(out[4]).collect())
    copies = [("bad", 2005, d, ["DuplicateTreeWithinPlotYear"]) for d in (1.0, 2.0)]
    assert flagged == [*copies, ("two", 2005, 2.0, ["DeadTreeHasDbh"])]


def test_every_unknown_status_value_is_written_beside_the_outputs(spark, folder):
    rows = [("one", "P", f"T{i}", 2000, f"odd {i % 70}", 1.0) for i in range(140)]
    mapped = spark.createDataFrame(rows, "dsn string, PlotID string, TreeID string, YR int, Status string, DBH double")
    submission = Submission("one", [], metadata=Metadata(census_type="single"))
    expected = {("one", f"odd {i}", 2) for i in range(70)}
    written = plans.export(plans.diagnose(mapped, "one", "single"), submission, folder, "x", ["parquet"], strict=False)
    delivered = plans.deliver(census.prepare(mapped), plans.metadata_table(spark, [submission]), folder, "all", ["parquet"])
    for files, name in ((written, "x"), (delivered, "all")):
        path = f"{folder}/{name}_unknown_values.json"
        assert path in files
        assert {(r.dsn, r.Status, r.row_count) for r in spark.read.json(path).collect()} == expected


def test_unknown_export_format_is_refused(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", LONG))
    work = plans.harmonize(raw, long_submission())
    with pytest.raises(ValueError, match="sas"):
        plans.export(work, long_submission(), folder, "x", ["sas"])


def test_wide_table_keeps_looked_up_columns(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", WIDE))
    plots = write(f"{folder}/plots.csv", "id,lat\nP1,-12.5\n")
    submission = Submission(
        "in_x", [*IDS, mapping.Lookup(plots, "Plot", "id", "lat", "Latitude")],
        wide_pairs=[("d_2000", 2000), ("d_2005", 2005), ("d_2010", 2010)],
    )
    work = plans.harmonize(raw, submission)
    assert statuses(work.prepared) == {"A": "000", "B": "920", "D": "011"}
    assert {r.Latitude for r in work.prepared.collect()} == {-12.5}


def test_single_census_without_status(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", "Plot,Tag,Year,Diam\nP,A,2000,5\nP,B,2000,NA\n"))
    work = plans.harmonize(raw, long_submission(census_type="single"))
    assert statuses(work.prepared) == {"A": "0", "B": "9"}
    assert work.final().count() == 2


def test_mapped_status_is_remapped_not_derived(spark, folder):
    raw = readers.read_table(spark, write(f"{folder}/in.csv", "Plot,Tag,Year,Diam,s\nP,A,2000,5,live\nP,A,2005,6,gone\n"))
    base = long_submission()
    submission = Submission(
        base.dsn, [*base.exprs, mapping.Column("s", "Status")],
        [mapping.StatusCode("live", "0"), mapping.StatusCode("dead", "1")],
    )
    work = plans.harmonize(raw, submission)
    assert statuses(work.prepared) == {"A": "0gone"}
    found = work.findings().first()
    assert found.rule == "UnknownStatus" and found.message.endswith("Found 1 values.")


def test_diagnose_reports_without_changing(spark):
    rows = [("P", "A", "2000", "x", "NA"), ("P", "A", "2000", "1", "4")]
    raw = spark.createDataFrame(rows, "PlotID string, TreeID string, YR string, Status string, DBH string")
    work = plans.diagnose(raw.selectExpr("*", "CAST(NULL AS STRING) AS PrevYR"), "d")
    assert work.prepared.count() == 2
    assert {r.rule for r in work.findings().collect()} == {
        "DuplicateTreeWithinPlotYear", "UnknownStatus", "DeadTreeHasDbh", "OrphanDeadFirstCensus",
        "NoPersistentTreeId",
    }


def test_saved_mapping_is_reused(spark, folder):
    store = f"{folder}/mappings"
    first = long_submission(census_years=(2000,))
    other = Submission(
        "in_b", [mapping.Concat(("a", "b"), "PlotID", prefix="s"), mapping.YearOf("y")],
        [mapping.StatusCode("felled", "1", "logged in 2003")], [("d_2000", 2000)],
    )
    for submission in (first, other, Submission("in_b", other.exprs, other.codes, other.wide_pairs)):
        save_submission(spark, submission, store)
    back = load_submission(spark, "in_b", store)
    assert back.codes == list(other.codes) and back.wide_pairs == [("d_2000", 2000)]
    assert [type(e).__name__ for e in back.exprs] == ["Concat", "YearOf"]
    assert load_submission(spark, first.dsn, store).metadata.dbh_unit == "mm"
    assert load_submission(spark, "in_c", store) is None


def test_arrivals_count_once(spark, folder):
    inbox, table, state = f"{folder}/inbox", f"{folder}/table", f"{folder}/state"
    os.mkdir(inbox)
    write(f"{inbox}/a.csv", LONG)

    def run():
        stream = spark.readStream.option("header", True).schema("Plot string, Tag string, Year string, Diam string").csv(inbox)
        collect_arrivals(stream, long_submission(), table, state).awaitTermination()
        return spark.read.parquet(table).count()

    assert run() == 15
    assert run() == 15
    write(f"{inbox}/b.csv", "Plot,Tag,Year,Diam\nP1,Z,2010,70\n")
    assert run() == 16
    assert spark.read.parquet(table).where("TreeID = 'Z'").first().DBH == 7.0
    write(f"{inbox}/c.csv", "Plot,Tag,Year,Diam\nP1,Z,n.d.,70\nP1,Y,2010,ca. 4\n")
    assert run() == 17
    stream = spark.readStream.option("header", True).schema("Plot string, Tag string, Year string, Diam string").csv(inbox)
    collect_unread(stream, long_submission(), f"{folder}/unread", f"{folder}/state2").awaitTermination()
    assert {tuple(r._unread.items()) for r in spark.read.parquet(f"{folder}/unread").collect()} >= {(("YR", "n.d."),)}
