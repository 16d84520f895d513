"""Folders of text tables: every file has a header of its own, and its values are taken by name.

Spark reads a folder by position and trusts the first file's header. Here the header lines of all files are found in one
scan of the files' first blocks; files that agree are read as they are, others through a map from each output column to
the file's own position. Files are named by Spark alone, so any file system it reads will do.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.plans.staging import staged

# File extensions of text tables and what stands between their cells.
SEPARATORS = {"csv": ",", "tsv": "\t"}
_ANY_CASE = "*.[cCtT][sS][vV]"
_LAYOUT = "file string, dsn string, header array<string>, names array<string>"


def text_reader(spark: SparkSession, fmt: str, multiline: bool = False, comment: str | None = None):
    # A quote inside a quoted value is written twice, not escaped by a backslash. An
    # empty cell is null but a quoted empty one is empty text, so null needs a mark
    # of its own that no cell holds.
    reader = (
        spark.read.option("sep", SEPARATORS[fmt])
        .option("escape", '"')
        .option("nullValue", "\0")
        .option("multiLine", multiline)
    )
    return reader.option("comment", comment) if comment else reader


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path may stand for several files: a directory or a pattern."""
    if any(c in path for c in "*?[{"):
        return True
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(place) and fs.getFileStatus(place).isDirectory())


def _root(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


def safe_names(header: Sequence[str]) -> list[str]:
    """Column names for a header line, as Spark gives them: blanks are numbered, repeats get their position."""
    count = Counter(h.lower() for h in header)
    return [f"_c{i}" if not h else f"{h}{i}" if count[h.lower()] > 1 else h for i, h in enumerate(header)]


def layouts(
    spark: SparkSession, path: str, fmt: str | None = None, comment: str | None = None, nested: bool = False
) -> DataFrame:
    """``(file, dsn, header, names)`` of every file under a path: its raw header line and safe column names.

    ``dsn`` is the path below the root without its extension; files that would share it keep theirs. Without a format
    the files with a known extension are taken, in any case, and read by it. ``nested`` looks into folders below.
    Only the first blocks of the files are looked at, and each task keeps the first line of each of its files as lines go
    by: nothing is sorted or gathered. A header must stand on one line.
    """
    reader = spark.read.option("recursiveFileLookup", nested)
    if fmt is None:
        reader = reader.option("pathGlobFilter", _ANY_CASE)
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    content = F.length(F.trim("value")) > 0
    if comment:
        content &= ~F.col("value").startswith(comment)
    begun = lines.where((F.col("block") == 0) & content).select("file", F.col("value").alias("line"))
    first = begun.mapInArrow(_first_lines, "file string, line string")
    root = _root(spark, path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, line in zip(batch["file"], batch["line"], strict=True):
                below = _below(unquote(file), root)
                known = fmt or below.rsplit(".", 1)[-1].lower()
                header = next(csv.reader([line.removeprefix("﻿").rstrip("\r")], delimiter=SEPARATORS[known]), [])
                rows.append((file, below, header, safe_names(header)))
            yield pd.DataFrame(rows, columns=["file", "dsn", "header", "names"])

    found = first.mapInPandas(parse, _LAYOUT)
    named = found.withColumn("stem", F.regexp_replace("dsn", r"\.[^./]*$", ""))
    named = named.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("stem")))  # as many files as extensions
    dsn = F.when(F.col("n") == 1, F.col("stem")).otherwise(F.col("dsn"))
    return named.select("file", dsn.alias("dsn"), "header", "names")


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each file; a task has a file's first block in one piece and in order."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file")
        if last is not None and file[0] == last and file[-1] == last:
            continue  # within a file
        turn = pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
        at = [i for i in (0, *(np.flatnonzero(turn) + 1)) if i or last is None or file[0] != last]
        yield batch.take(pa.array(at, pa.int64()))
        last = file[-1]


def _below(file: str, root: str) -> str:
    """A file's path below the root; both may write the scheme with one or three slashes."""
    file, root = (p.replace(":///", ":/", 1) for p in (file, root))
    return file[len(root) + 1 :] if file.startswith(f"{root}/") else file.rsplit("/", 1)[-1]


def merged_header(found: DataFrame) -> list[str]:
    """The raw names of all files of a folder in order of appearance: each as often as the file that repeats it most."""
    per_file = found.select("file", F.posexplode("header").alias("at", "name"))
    counted = per_file.groupBy("file", "name").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    names = counted.groupBy("name").agg(F.max("n").alias("n"), F.min(F.struct("file", "at")).alias("first"))
    return [r.name for r in names.orderBy("first").collect() for _ in range(r.n)]  # as many rows as columns


def read_folder(
    spark: SparkSession, path: str, fmt: str, multiline: bool = False, comment: str | None = None
) -> DataFrame:
    """All files of a folder as one table of text columns, whatever the order of columns in each.

    Columns are named by the files' headers, in order of appearance over the sorted files; names that differ only in case
    are one column under its first spelling, and a column that a file lacks is null there. Cells beyond a header are left out.
    """
    found = staged(layouts(spark, path, fmt, comment), "layouts")
    columns = (
        found.select("file", F.posexplode("names").alias("at", "name"), F.size("names").alias("width"))
        .groupBy(F.lower("name").alias("key"))
        .agg(F.min(F.struct("file", "at", "name")).alias("first"), F.max("width").alias("width"))
        .orderBy("first")
        .collect()  # as many rows as the table has columns
    )
    reader = text_reader(spark, fmt, multiline, comment).option("header", True)
    if found.select("header").distinct().limit(2).count() < 2:
        return reader.csv(path)
    width = max(c.width for c in columns)
    cells = [f"_{i}" for i in range(width)]
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(path)
    partitions = [c for c in rows.columns if c not in cells]
    keys = [c.key for c in columns]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [{n.lower(): i for i, n in enumerate(names)} for names in batch["names"]]
            yield pd.DataFrame({"_file": batch["file"], "_places": [[at.get(k) for k in keys] for at in own]})

    places = found.mapInPandas(place, "_file string, _places array<int>")
    joined = rows.withColumn("_own", F.col("_metadata.file_path")).join(places, F.col("_own") == F.col("_file"))
    all_cells = F.array(*[F.col(c) for c in cells])
    taken = [F.get(all_cells, F.col("_places")[k]).alias(c.first.name) for k, c in enumerate(columns)]
    return joined.select(*taken, *[col(c) for c in partitions])


def read_datasets(
    spark: SparkSession, path: str, fmt: str, multiline: bool = False, comment: str | None = None
) -> DataFrame:
    """``(dsn, cells)`` of every row of every file below a path, each file being a dataset with columns of its own.

    ``cells`` maps the file's column names to the row's text, so that one plan can map all datasets (see
    ``operators.many``).
    """
    found = staged(layouts(spark, path, fmt, comment, nested=True), "layouts")
    width = found.agg(F.max(F.size("names")).alias("n")).first().n or 1
    cells = [f"_{i}" for i in range(width)]
    reader = text_reader(spark, fmt, multiline, comment).option("header", True).option("recursiveFileLookup", True)
    rows = reader.schema(", ".join(f"{c} string" for c in cells)).csv(path)
    joined = rows.withColumn("_own", F.col("_metadata.file_path")).join(found, F.col("_own") == F.col("file"))
    own = F.slice(F.array(*[F.col(c) for c in cells]), F.lit(1), F.size("names"))
    return joined.select("dsn", F.map_from_arrays("names", own).alias("cells"))
