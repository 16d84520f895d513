"""Reading contributor tables: format dispatch, previews, raw headers, header catalogues."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.sources.folders import SEPARATORS, is_folder, layouts, merged_header, read_folder, text_reader
from stemledger.sources.workbook import read_workbook, workbook_header

FORMATS = (*SEPARATORS, "parquet", "xlsx")


def table_format(path: str, fmt: str | None = None) -> str:
    """The format asked for or, failing that, the lower-cased file extension."""
    found = fmt or PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if found not in FORMATS:
        raise ValueError(f"unsupported file type {found!r}; expected one of {', '.join(FORMATS)}")
    return found


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    multiline: bool = False,
    comment: str | None = None,
) -> DataFrame:
    """Read a table by its format.

    Text formats come as strings: types are given once, when the columns are
    mapped, so nothing is inferred from a sample and no extra pass is made. Set
    ``multiline`` for quoted line breaks; such files cannot be split. The files of
    a folder may differ in their columns and the order of these: values are taken
    by name.
    """
    found = table_format(path, fmt)
    if found == "parquet":
        return spark.read.parquet(path)
    if found == "xlsx":
        return read_workbook(spark, path)
    if is_folder(spark, path):
        return read_folder(spark, path, found, multiline, comment)
    return text_reader(spark, found, multiline, comment).option("header", True).csv(path)


def raw_header(spark: SparkSession, path: str, fmt: str | None = None) -> list[str]:
    """The header line as it stands in the file, blanks and repeats included.

    Spark renames blank and repeated headers while reading, so the structural
    gate needs this. Only the first line is read. Of a folder the names of all
    files are given, each as often as the file that repeats it most.
    """
    found = table_format(path, fmt)
    if found == "parquet":
        return spark.read.parquet(path).columns
    if found == "xlsx":
        return workbook_header(spark, path)
    if is_folder(spark, path):
        return merged_header(layouts(spark, path, found))
    first = text_reader(spark, found).option("header", False).csv(path).first()
    return [] if first is None else [value or "" for value in first]


def header_names(spark: SparkSession, path: str, fmt: str | None = None) -> list[str]:
    """Column names of a second file, without reading its rows."""
    return raw_header(spark, path, fmt)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows as text, nulls kept."""
    return df.limit(n).select(*[col(c).cast("string").alias(c) for c in df.columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def header_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(dsn, ordinal, header)`` of every CSV or TSV file below a path.

    A file is named by its path below the root, so files of the same name in two
    folders stay apart.
    """
    return layouts(spark, path, nested=True).select("dsn", F.posexplode("header").alias("ordinal", "header"))
