"""Reading workbooks (.xlsx) in bulk: Spark lists, packs and loads the files."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names inside the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

CELLS_SCHEMA = "file string, row int, cells array<string>"
ROWS_PER_BATCH = 5000


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, cells)`` of the first sheet of every workbook under a path.

    Row 0 is the header. All cells are text, empty ones null. Files are packed
    into tasks by size; a sheet is parsed as a stream, so a task holds one
    compressed file and one batch of rows.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .load(path)
        .select("path", "content")
    )
    return files.mapInPandas(_parse_files, CELLS_SCHEMA)


def workbook_header(spark: SparkSession, path: str) -> list[str]:
    """Header cells of one workbook, blanks as empty text."""
    first = read_workbooks(spark, path).where(F.col("row") == 0).select("cells").first()
    return [(text or "") if (text or "").strip() else "" for text in first.cells]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """One workbook as a table of text columns named by its first row.

    A column without a header is called ``_c`` and its position, as in other text files.
    """
    header = [name or f"_c{i}" for i, name in enumerate(workbook_header(spark, path))]
    repeated = [name for name, n in Counter(header).items() if n > 1]
    if repeated:
        raise ValueError(f"repeated headers in {path}: {repeated}")
    rows = read_workbooks(spark, path).where(F.col("row") > 0)
    return rows.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(header)])


def workbook_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(dsn, ordinal, header)`` of every workbook under a path, for bulk mapping."""
    stem = F.regexp_extract("file", r"(?i)([^/]+)\.xlsx$", 1)
    return (
        read_workbooks(spark, path)
        .where(F.col("row") == 0)
        .select(stem.alias("dsn"), F.posexplode("cells").alias("ordinal", "header"))
        .withColumn("header", F.coalesce("header", F.lit("")))
    )


def _parse_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[list[str | None]] = []
            start = 0
            for cells in sheet_rows(content, path):
                rows.append(cells)
                if len(rows) == ROWS_PER_BATCH:
                    yield _frame(path, start, rows)
                    start, rows = start + len(rows), []
            if start + len(rows) < 2:
                raise ValueError(f"the first sheet of {path} has no data rows")
            if rows:
                yield _frame(path, start, rows)


def _frame(path: str, start: int, rows: list) -> pd.DataFrame:
    numbers = pd.Series(range(start, start + len(rows)), dtype="int32")
    return pd.DataFrame({"file": path, "row": numbers, "cells": rows})


def sheet_rows(content: bytes, path: str) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, aligned to the header row's first column."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        with book.open(_first_sheet(book, path)) as sheet:
            left = None
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != MAIN + "row":
                    continue
                cells = {}
                for position, cell in enumerate(node.findall(MAIN + "c")):
                    at = _column_index(cell.get("r")) if cell.get("r") else position
                    cells[at] = _cell_text(cell, shared)
                node.clear()
                filled = [at for at, text in cells.items() if text is not None]
                if left is None:
                    if not filled:
                        continue
                    left = min(filled)
                width = max(filled, default=left - 1) + 1
                yield [cells.get(at) for at in range(left, width)]


def _first_sheet(book: zipfile.ZipFile, path: str) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f".//{MAIN}sheet")
    if not sheets:
        raise ValueError(f"{path} has no sheets")
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == sheets[0].get(RELATION_ID))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    table = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in table]


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(MAIN + "t"))
    value = cell.findtext(MAIN + "v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n":
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value
