"""Structural gate on a raw table: empty, blank or repeated headers, all-null columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.operators.headers import PLACEHOLDER_PREFIX


@dataclass(frozen=True)
class GateError:
    problem: str
    header: str | None = None
    count: int | None = None

    @property
    def message(self) -> str:
        return {
            "empty": "The table has no rows.",
            "blank_header": f"Column {self.header!r} has no usable header; "
            "check for merged cells or a second header row.",
            "duplicate_header": f"The header {self.header!r} occurs more than once; "
            "give one clean table with distinct headers.",
            "all_null_column": f"Column {self.header!r} holds no value at all; "
            "remove spacer columns.",
            "all_null_columns": f"{self.count} columns hold no value at all; "
            "the file seems to hold more than one table.",
        }[self.problem]


def null_profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, column, ordinal, n_rows, n_null)`` in one pass over the table.

    All counts are one map-side aggregate, whatever the number of columns.
    """
    names = [c for c in df.columns if c not in by]
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(col(c)).alias(f"_n{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("ordinal"),
                F.col("n_rows"),
                (F.col("n_rows") - F.col(f"_n{i}")).alias("n_null"),
            )
            for i, c in enumerate(names)
        ]
    )
    return counts.select(*by, F.inline(rows))


def all_null_findings(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, problem, header, n)``: the one all-null column by name, several by number.

    A table without rows gives the single finding ``empty``.
    """
    profile = null_profile(df, by)
    empty = F.col("n_rows") == 0
    all_null = F.col("n_null") == F.col("n_rows")
    summary = profile.groupBy(*by).agg(
        F.max("n_rows").alias("n_rows"),
        F.count_if(all_null).alias("n"),
        F.max(F.when(all_null, F.col("column"))).alias("only"),
    )
    one = F.col("n") == 1
    return summary.where(empty | (F.col("n") > 0)).select(
        *by,
        F.when(empty, "empty")
        .when(one, "all_null_column")
        .otherwise("all_null_columns")
        .alias("problem"),
        F.when(~empty & one, F.col("only")).alias("header"),
        F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("n")).alias("n"),
    )


def header_errors(headers: Sequence[str]) -> list[GateError]:
    """Problems of one raw header line, in order of first occurrence."""
    errors = []
    for header, count in Counter(headers).items():
        if header == "" or header.startswith(PLACEHOLDER_PREFIX):
            errors += [GateError("blank_header", header)] * count
        else:
            errors += [GateError("duplicate_header", header)] * (count - 1)
    return errors


def check(df: DataFrame, headers: Sequence[str] | None = None) -> list[GateError]:
    """All structural problems of one table; an empty list means it passes.

    ``headers`` is the raw header line (see ``sources.readers.raw_header``):
    Spark renames blank and repeated names while reading, so they can only be
    judged before that. One aggregate row reaches the driver.
    """
    found = all_null_findings(df).first()
    if found is not None and found.problem == "empty":
        return [GateError("empty")]
    errors = header_errors(df.columns if headers is None else headers)
    if found is not None:
        count = found.n if found.problem == "all_null_columns" else None
        errors.append(GateError(found.problem, found.header, count))
    return errors


def judged(headers: Sequence[str], n_rows: int, filled: dict[str, int]) -> list[GateError]:
    """The same problems from counts taken elsewhere: rows, and rows with a value per column."""
    if not n_rows:
        return [GateError("empty")]
    hollow = [name for name, n in filled.items() if not n]
    errors = header_errors(headers)
    if len(hollow) == 1:
        errors.append(GateError("all_null_column", hollow[0]))
    elif hollow:
        errors.append(GateError("all_null_columns", count=len(hollow)))
    return errors


def is_ok(df: DataFrame, headers: Sequence[str] | None = None) -> bool:
    return not check(df, headers)
