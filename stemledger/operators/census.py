"""Ordering censuses: keep-first deduplication, previous census year, per-tree and per-plot years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemledger.functions.values import col
from stemledger.operators.joins import left_join_groups
from stemledger.schema import BY, DBH, DSN, PLOT, PREV_YEAR, ROW_KEYS, TREE, YEAR, CensusType, any_multi, is_multi

def dedup_first(
    df: DataFrame, tie_break: Sequence[str | Column] | None = None, by: Sequence[str] = BY
) -> DataFrame:
    """Keep one row per (dataset, plot, tree, year): the first by the tie-break.

    The tie-break defaults to all other columns, which makes the survivor a
    function of the data alone. Spark plans the rank filter as a group limit on
    both sides of the shuffle, so however many copies a measurement has, each
    task sends at most one of them.
    """
    keys = [*tree_partition(by), YEAR]
    order = tie_break or [col(c) for c in df.columns if c not in keys] or [F.lit(0)]
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", first).where(F.col("_rank") == 1).drop("_rank")


def tree_partition(by: Sequence[str] = BY) -> list[str]:
    """The key of a tree, its most distinctive part first.

    Sorting compares a short prefix of the first key and looks further only on a
    tie; dataset and plot would tie most of the time.
    """
    return [TREE, PLOT, *by]


def tree_window(by: Sequence[str] = BY):
    """All rows of a tree in census order, as one frame.

    Every per-tree expression uses this one partitioning and order, so a chain
    of them costs one exchange and one sort.
    """
    return W.partitionBy(*tree_partition(by)).orderBy(YEAR)


def whole_tree(by: Sequence[str] = BY):
    return tree_window(by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def previous_year(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Set ``PrevYR`` to the tree's previous census year; null on its first row.

    Needs deduplicated rows, which also bounds a tree to one row per year.
    """
    return df.withColumn(PREV_YEAR, F.lag(YEAR).over(tree_window(by)))


def prepare(
    df: DataFrame,
    census_type: CensusType | str | Column = CensusType.MULTI,
    tie_break: Sequence[str | Column] | None = None,
    by: Sequence[str] = BY,
) -> DataFrame:
    """Deduplicate and, for a multi-census, link each row to the tree's previous year.

    Copies are removed before rows are gathered by tree, so any number of them is
    safe; that takes two exchanges. In a table of several datasets ``census_type``
    may be a column (see ``with_census_type``); rows of a single census then keep
    the previous year they came with, if any.
    """
    rows = dedup_first(df, tie_break, by)
    if not any_multi(census_type):
        return rows
    if not isinstance(census_type, Column):
        return previous_year(rows, by)
    own = F.col(PREV_YEAR).try_cast("int") if PREV_YEAR in rows.columns else F.lit(None)
    linked = F.lag(YEAR).over(tree_window(by))
    return rows.withColumn(PREV_YEAR, F.when(is_multi(census_type), linked).otherwise(own))


def with_census_type(df: DataFrame, datasets: DataFrame, name: str = "census_type") -> DataFrame:
    """Add each row's census type from the metadata table, which has a row per dataset.

    A dataset without a type, or without metadata, gets null, which counts as a
    multi-census; of several types the first in text order is taken.
    """
    types = datasets.groupBy(DSN).agg(F.min("census_type").alias(name))
    return left_join_groups(df.drop(name), types, [DSN])


def census_sort(
    df: DataFrame,
    tie_break: Sequence[str | Column] | None = None,
    by: Sequence[str] = BY,
    unique: bool = False,
) -> DataFrame:
    """Rows in (dataset, plot, tree, year) order. Meant for the very end of a plan.

    ``unique`` says that a measurement occurs once, as ``prepare`` leaves it; a
    plain range sort then spreads any tree or dataset. Otherwise ties are broken by
    the tie-break, by default all other columns, and at last by a running number, so
    that a measurement with most rows is spread over ranges even if these are
    exact copies. The number follows a sort within each task, by all columns: a task
    that is run again deals the same rows the same way.
    """
    keys = [*by, *ROW_KEYS]
    if unique:
        return df.orderBy(*keys, *(tie_break or ()))
    others = [_sortable(col(f.name), f.dataType) for f in df.schema if f.name not in keys]
    within = df.sortWithinPartitions(*keys, *(tie_break or ()), *others)
    numbered = within.withColumn("_spread", F.monotonically_increasing_id())
    return numbered.orderBy(*keys, *(tie_break or others), "_spread").drop("_spread")


def _sortable(value: Column, dtype: T.DataType) -> Column:
    """The column itself, or its text if it holds maps or variants, which have no order."""
    kind = dtype.simpleString()
    if "map<" in kind:
        return F.to_json(F.struct(value))
    return value.cast("string") if "variant" in kind else value


def with_tree_span(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``tree_first`` and ``tree_last``: first and last year of each tree."""
    tree = whole_tree(by)
    return df.withColumns(
        {"tree_first": F.min(YEAR).over(tree), "tree_last": F.max(YEAR).over(tree)}
    )


def with_valid_span(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Add ``valid_first`` and ``valid_last``: a tree's first and last measured year."""
    tree = whole_tree(by)
    measured = F.when(F.col(DBH).isNotNull(), F.col(YEAR))
    return df.withColumns(
        {"valid_first": F.min(measured).over(tree), "valid_last": F.max(measured).over(tree)}
    )


def plot_years(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, PlotID, plot_first, plot_last)``: a map-side combined aggregate."""
    return df.groupBy(*by, PLOT).agg(
        F.min(YEAR).alias("plot_first"), F.max(YEAR).alias("plot_last")
    )


def dataset_years(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, dataset_first, dataset_last)``."""
    return df.groupBy(*by).agg(
        F.min(YEAR).alias("dataset_first"), F.max(YEAR).alias("dataset_last")
    )
