"""Writing delivered datasets as CSV, Parquet and workbooks, each with its provenance."""

from __future__ import annotations

import csv
import io
import math
import zipfile
from collections.abc import Callable, Sequence
from dataclasses import replace
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.operators.census import census_sort
from stemledger.operators.joins import left_join_groups
from stemledger.plans.staging import staged
from stemledger.schema import DSN, ROW_KEYS
from stemledger.sinks.provenance import Provenance

# Fixed value: rows a sheet can hold below its header row.
MAX_SHEET_ROWS = 1_048_575

_CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _csv_header(names: Sequence[str]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(names)
    return out.getvalue()


def _csv_line(names: Sequence[str]) -> Column:
    return F.to_csv(F.struct(*[col(c) for c in names]), _CSV_OPTIONS)


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a one-file dataset, on whatever file system the path names."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(
    df: DataFrame,
    path: str,
    provenance: Provenance,
    dataset_column: str = DSN,
    unique: bool = False,
) -> None:
    """One dataset as CSV part files in census order (see ``census_sort`` for ``unique``).

    Every part file starts with the provenance comment and the header line, so
    each can be used alone. Lines are rendered by Spark; the first row of a
    partition is the one whose running number within it is zero.
    """
    preamble = f"{provenance.comment_line()}\n{_csv_header(df.columns)}"
    by = [dataset_column] if dataset_column in df.columns else []
    rows = census_sort(df, by=by, unique=unique)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = rows.select(_csv_line(df.columns).alias("line"), position.alias("position"))
    first = F.col("position") == 0
    _write_lines(
        lines.select(
            F.when(first, F.concat(F.lit(preamble + "\n"), "line")).otherwise(F.col("line")).alias("value")
        ),
        path,
    )
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        write_text_file(spark, path, preamble)


def _write_lines(lines: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = lines.write.mode("overwrite").option("maxRecordsPerFile", 0)
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)


def with_file_number(df: DataFrame, rows_per_file: int, dataset_column: str = DSN) -> DataFrame:
    """Add ``_place``, a row's number in its dataset in census order, and ``_file``, the file it belongs to.

    Two passes: rows are sorted over all tasks and staged with their number within the task; the rows of each dataset in
    each task are counted, and the running sums of these few counts turn numbers within tasks into places. So every file
    but a dataset's last holds exactly ``rows_per_file`` rows, whatever the data, and no dataset or tree is gathered.
    """
    ordered = df.orderBy(dataset_column, *ROW_KEYS)
    rows = staged(
        ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "places"
    )
    counts = rows.groupBy(dataset_column, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(dataset_column).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    shifts = counts.select(dataset_column, "_part", (earlier - F.col("_first")).alias("_shift"))
    placed = left_join_groups(rows, shifts, [dataset_column, "_part"])
    place = F.col("_at") + F.col("_shift")
    file = F.floor(place / F.lit(rows_per_file)).cast("int")
    return placed.withColumns({"_place": place, "_file": file}).drop("_part", "_at", "_shift")


def csv_lines(
    df: DataFrame, provenance: Provenance, rows_per_file: int = 2_000_000, datasets: DataFrame | None = None
) -> DataFrame:
    """``(dsn, file, place, value)``: the CSV line of each row, with the file's preamble before its first.

    Files are numbered from 0 and full but for a dataset's last. ``datasets`` names datasets that may have no rows left;
    they get a file with the preamble alone.
    """
    names = df.columns
    start, end = replace(provenance, dsn="\0").comment_line().split("\0")
    preamble = F.concat(F.lit(start), F.coalesce(F.col(DSN), F.lit("")), F.lit(f"{end}\n{_csv_header(names)}"))
    line = _csv_line(names)
    first = F.col("_place") % rows_per_file == 0
    numbered = with_file_number(df, rows_per_file).select(
        DSN,
        F.col("_file").alias("file"),
        F.col("_place").alias("place"),
        F.when(first, F.concat_ws("\n", preamble, line)).otherwise(line).alias("value"),
    )
    if datasets is not None:
        hollow = datasets.select(DSN).distinct().join(numbered.select(DSN).distinct(), DSN, "left_anti")
        numbered = numbered.unionByName(
            hollow.select(DSN, F.lit(0).alias("file"), F.lit(0).cast("bigint").alias("place"), preamble.alias("value"))
        )
    return numbered


def write_csv_by_dataset(
    df: DataFrame,
    path: str,
    provenance: Provenance,
    rows_per_file: int = 2_000_000,
    datasets: DataFrame | None = None,
) -> None:
    """Many datasets as CSV under ``dsn=…/file=…``, each file with its own preamble, in census order (see ``csv_lines``)."""
    lines = csv_lines(df, provenance, rows_per_file, datasets)
    together = lines.repartition(DSN, "file").sortWithinPartitions(DSN, "file", "place")
    _write_lines(together.select(DSN, "file", "value"), path, [DSN, "file"])


def write_parquet(
    df: DataFrame, path: str, provenance: Provenance, partition_by: Sequence[str] = ()
) -> None:
    """Parquet with the provenance in the file footers and in a JSON sidecar.

    Footers carry it as metadata of every column, which readers get back in the
    schema. The sidecar stands next to the data: ``x.parquet`` gets
    ``x.provenance.json``.
    """
    stamped = df.select(
        *[col(c).alias(c, metadata={"provenance": dict(provenance.items())}) for c in df.columns]
    )
    writer = stamped.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    sidecar = path.removesuffix(".parquet") + ".provenance.json"
    write_text_file(df.sparkSession, sidecar, provenance.to_json())


# --- workbooks -----------------------------------------------------------------------


def write_workbooks(
    df: DataFrame,
    folder: str,
    name: Callable[[str, int], str],
    provenance: Provenance,
    rows_per_workbook: int = 500_000,
    dataset_column: str = DSN,
) -> DataFrame:
    """One workbook per dataset, or several for a large one, each written by its own task.

    Returns ``(dsn, file, path, row_count)``; the work is done when that is
    executed. A group is at most one sheet, full but for a dataset's last, so a
    task's memory is bounded. ``folder`` must be reachable from every executor.
    """
    if rows_per_workbook > MAX_SHEET_ROWS:
        raise ValueError(f"a sheet holds at most {MAX_SHEET_ROWS} rows")
    names = df.columns

    def write_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dsn, file = str(key[0]), int(key[1])
        ordered = rows.sort_values("_place")[names]
        target = f"{folder.rstrip('/')}/{name(dsn, file)}"
        _save(target, workbook_bytes(ordered, replace(provenance, dsn=dsn)))
        return pd.DataFrame(
            {"dsn": [dsn], "file": [file], "path": [target], "row_count": [len(rows)]}
        )

    return (
        with_file_number(df, rows_per_workbook, dataset_column)
        .groupBy(dataset_column, "_file")
        .applyInPandas(write_one, "dsn string, file int, path string, row_count long")
    )


def write_hollow_workbook(names: Sequence[str], path: str, provenance: Provenance) -> None:
    """A workbook with its header row and provenance alone."""
    _save(path, workbook_bytes(pd.DataFrame(columns=list(names)), provenance))


def _save(path: str, content: bytes) -> None:
    """Write under a private name and move into place, so a retried task leaves one file."""
    import uuid

    from pyarrow import fs

    if "://" in path:
        filesystem, target = fs.FileSystem.from_uri(path)
    else:
        filesystem, target = fs.LocalFileSystem(), path.removeprefix("file:")
    filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
    partial = f"{target}.{uuid.uuid4().hex}.partial"
    with filesystem.open_output_stream(partial) as out:
        out.write(content)
    filesystem.move(partial, target)


# The parts every workbook consists of.
_CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/worksheets/sheet2.xml" ContentType='
    '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
)
_PACKAGE_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="xl/workbook.xml" Type='
    '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>'
)
_WORKBOOK = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
    '<sheet name="data" sheetId="1" r:id="rId1"/>'
    '<sheet name="_provenance" sheetId="2" r:id="rId2"/></sheets></workbook>'
)
_WORKBOOK_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type='
    '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/>'
    '<Relationship Id="rId2" Target="worksheets/sheet2.xml" Type='
    '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>'
)
_SHEET_START = (
    '<?xml version="1.0" encoding="UTF-8"?>'
    '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
)
_SHEET_END = "</sheetData></worksheet>"


def workbook_bytes(rows: pd.DataFrame, provenance: Provenance) -> bytes:
    """A workbook with the sheets ``data`` and ``_provenance``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _CONTENT_TYPES)
        book.writestr("_rels/.rels", _PACKAGE_RELATIONS)
        book.writestr("xl/workbook.xml", _WORKBOOK)
        book.writestr("xl/_rels/workbook.xml.rels", _WORKBOOK_RELATIONS)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            _write_sheet(sheet, [rows.columns.tolist()])
            for number, values in enumerate(rows.itertuples(index=False, name=None), 2):
                sheet.write(_row_xml(values, number))
            sheet.write(_SHEET_END.encode())
        with book.open("xl/worksheets/sheet2.xml", "w") as sheet:
            _write_sheet(sheet, provenance.items())
            sheet.write(_SHEET_END.encode())
    return out.getvalue()


def _write_sheet(sheet, rows) -> None:
    sheet.write(_SHEET_START.encode())
    for number, values in enumerate(rows, 1):
        sheet.write(_row_xml(values, number))


def _row_xml(values, number: int) -> bytes:
    """A row of cells; numbers that a sheet cannot hold are left out, as nulls are."""
    cells = []
    for i, value in enumerate(values):
        if value is None or value is pd.NA or value != value or value in (math.inf, -math.inf):
            continue
        at = f"r={quoteattr(_column_letters(i) + str(number))}"
        if isinstance(value, bool):
            cells.append(f'<c {at} t="b"><v>{int(value)}</v></c>')
        elif isinstance(value, str):
            text = escape(value)
            cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        elif hasattr(value, "__float__"):
            cells.append(f"<c {at}><v>{value}</v></c>")
        else:
            cells.append(f'<c {at} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()


def _column_letters(index: int) -> str:
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(ord("A") + rest) + letters
    return letters
