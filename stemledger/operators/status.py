"""Tree status from census structure, its summary, and rows for trees that disappeared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemledger.functions.values import col, normalised_dbh
from stemledger.operators.census import (
    dataset_years,
    dedup_first,
    plot_years,
    tree_partition,
    tree_window,
    whole_tree,
    with_valid_span,
)
from stemledger.operators.joins import attach_dataset_value, left_join_groups
from stemledger.schema import (
    ALIVE,
    BY,
    DBH,
    DEAD,
    MISSING,
    PLOT,
    PREV_YEAR,
    RECRUIT,
    STATUS,
    TREE_KEYS,
    YEAR,
    CensusType,
    is_multi,
)

# What to do with trees absent from the last census.
DISAPPEARED_CODES = {"dead": DEAD, "missing": MISSING}


def _plot_dimension(df: DataFrame, by: Sequence[str], with_last: bool) -> DataFrame:
    """One row per plot: its first year and, if asked, the dataset's last year.

    The dataset's last year is folded up from the plot aggregate, so both need
    one narrow scan: the filter, true for every plot, makes both sides of the
    join ask for the same two columns, and Spark reuses the one exchange.
    """
    plots = plot_years(df, by)
    if with_last:
        first, last = F.col("plot_first"), F.col("plot_last")
        plots = plots.where(first.isNull() | (first <= last))
        latest = plots.groupBy(*by).agg(F.max("plot_last").alias("dataset_last"))
        plots = attach_dataset_value(plots, latest, "dataset_last", by)
    return plots.drop("plot_last")


def _with_structure(
    df: DataFrame,
    by: Sequence[str],
    years_from: DataFrame | None,
    with_last: bool,
    census_type: CensusType | str | Column,
    where: Column | None = None,
) -> DataFrame:
    """Rows with a clean diameter, their status, and the years it was derived from."""
    dbh = normalised_dbh(F.col(DBH), df.schema[DBH].dataType)
    rows = with_valid_span(df.withColumn(DBH, dbh), by)
    if with_last:
        rows = rows.withColumns(
            {
                "tree_last": F.max(YEAR).over(whole_tree(by)),
                "tree_row": F.row_number().over(tree_window(by)),
            }
        )
    plots = _plot_dimension(df if years_from is None else years_from, by, with_last)
    rows = left_join_groups(rows, plots, [*by, PLOT])

    year, unmeasured = F.col(YEAR), F.col(DBH).isNull()
    entered = (year == F.col("valid_first")) & (F.col("valid_first") > F.col("plot_first"))
    gone = unmeasured & (year > F.col("valid_last"))
    multi = is_multi(census_type)
    status = (
        F.when(multi & entered, RECRUIT).when(multi & gone, DEAD).when(unmeasured, MISSING).otherwise(ALIVE)
    )
    if where is not None:
        status = F.when(where, status).otherwise(F.col(STATUS))
    return rows.withColumn(STATUS, status)


def derive_status(
    df: DataFrame,
    by: Sequence[str] = BY,
    years_from: DataFrame | None = None,
    census_type: CensusType | str | Column = CensusType.MULTI,
    where: Column | None = None,
) -> DataFrame:
    """Set ``Status`` of prepared rows from when trees and plots were measured.

    A tree's first measured year is a recruitment (2) if its plot had a census
    before; without a diameter a row is dead (1) after the tree's last measured
    year and missing (9) otherwise; all other rows are alive (0). A single census
    has no structure: its rows are alive or missing. A column as ``census_type``
    gives each row's own; ``where`` names the rows, by whole datasets, whose status
    is derived, the others keep theirs.

    The tree years are windows over the tree key. The plot's first year is not a
    window, because a plot may hold a large share of the rows: it is a separate
    aggregate joined back. ``years_from`` may name the rows before
    deduplication, which have the same years and are cheaper to scan again.
    """
    rows = _with_structure(df, by, years_from, False, census_type, where)
    return rows.drop("valid_first", "valid_last", "plot_first")


def derive_summary(
    df: DataFrame,
    by: Sequence[str] = BY,
    years_from: DataFrame | None = None,
    census_type: CensusType | str | Column = CensusType.MULTI,
) -> DataFrame:
    """Per dataset: rows per derived status and trees absent from the last census."""
    rows = _with_structure(df, by, years_from, with_last=True, census_type=census_type)

    def rows_with(condition, name):
        return F.count_if(condition).alias(name)

    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        rows_with(F.col(YEAR) == F.col("plot_first"), "first_census"),
        rows_with(F.col(STATUS) == RECRUIT, "recruit"),
        rows_with(F.col(STATUS) == DEAD, "dead"),
        rows_with(F.col(STATUS) == MISSING, "missing"),
        rows_with(
            is_multi(census_type) & (F.col("tree_row") == 1) & (F.col("tree_last") < F.col("dataset_last")),
            "disappeared_trees",
        ),
    )
    others = F.col("first_census") + F.col("recruit") + F.col("dead") + F.col("missing")
    return counts.select(
        *by,
        "first_census",
        "recruit",
        F.greatest(F.lit(0).cast("bigint"), F.col("n_rows") - others).alias("subsequent_alive"),
        "dead",
        "missing",
        "disappeared_trees",
    )


def disappeared_trees(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, PlotID, TreeID, tree_last)`` of trees absent from their dataset's last census."""
    trees = df.groupBy(*by, *TREE_KEYS).agg(F.max(YEAR).alias("tree_last"))
    return attach_dataset_value(trees, dataset_years(df, by), "dataset_last", by).where(
        F.col("tree_last") < F.col("dataset_last")
    ).drop("dataset_last")


def derive_full(
    df: DataFrame,
    disappeared: str = "none",
    by: Sequence[str] = BY,
    years_from: DataFrame | None = None,
    census_type: CensusType | str | Column = CensusType.MULTI,
    where: Column | None = None,
) -> DataFrame:
    """Derive status and add a last-census row for every tree that disappeared.

    ``disappeared`` is ``dead``, ``missing`` or anything else for no added rows.
    An added row copies the tree's last row with the dataset's last year, the
    chosen status and no diameter, and is linked to that last row's year, so no
    second preparation is needed. It is emitted next to the row it copies; the
    plan is not executed twice as a union would do. Nothing disappears from a
    single census, nor from datasets that ``where`` leaves out.
    """
    code = DISAPPEARED_CODES.get(disappeared)
    if code is None:
        return derive_status(df, by, years_from, census_type, where)
    rows = _with_structure(df, by, years_from, True, census_type, where)
    last_row = F.col("tree_last") < F.col("dataset_last")
    return _with_added(rows, df.columns, code, last_row & _may_disappear(census_type, where))


def _may_disappear(census_type: CensusType | str | Column, where: Column | None) -> Column:
    return (F.lit(True) if where is None else where) & is_multi(census_type)


def _with_added(rows: DataFrame, columns: Sequence[str], code: str, disappeared: Column) -> DataFrame:
    """Rows with a status, and beside the last row of each tree that disappeared the row that is added."""
    last_row = disappeared & (F.col(YEAR) == F.col("tree_last"))
    copies = F.when(last_row, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    both = rows.withColumn("_added", F.explode(copies))
    added = F.col("_added")
    changes = {
        YEAR: F.when(added, F.col("dataset_last")).otherwise(F.col(YEAR)),
        STATUS: F.when(added, F.lit(code)).otherwise(F.col(STATUS)),
        DBH: F.when(~added, F.col(DBH)),
    }
    if PREV_YEAR in rows.columns:
        changes[PREV_YEAR] = F.when(added, F.col(YEAR)).otherwise(F.col(PREV_YEAR))
    out = [changes[c].alias(c) if c in changes else col(c) for c in columns]
    if STATUS not in columns:
        out.append(changes[STATUS].alias(STATUS))
    return both.select(*out)


def prepare_and_derive(
    df: DataFrame,
    disappeared: str = "none",
    tie_break: Sequence[str | Column] | None = None,
    by: Sequence[str] = BY,
    census_type: CensusType | str | Column = CensusType.MULTI,
    where: Column | None = None,
) -> DataFrame:
    """``prepare`` and ``derive_full`` in one, for tables with more plots than can be broadcast.

    Joining each row to its plot would move all columns a third time, dealt out by plot, of which one may hold most rows.
    Here plots meet only the keys of trees. Each tree gets one marker row with its plot's first and its dataset's last year,
    which joins the tree's rows on their way to the tree windows. So rows move twice, once to lose their copies and once to
    their tree, whatever the number of plots, and null keys are groups like any other.
    """
    dbh = normalised_dbh(F.col(DBH), df.schema[DBH].dataType)
    trees = left_join_groups(df.select(*by, *TREE_KEYS).distinct(), _plot_dimension(df, by, with_last=True), [*by, PLOT])
    years = [F.col("plot_first").alias("_plot_first"), F.col("dataset_last").alias("_dataset_last")]
    markers = trees.select(*by, *TREE_KEYS, *years, F.lit(True).alias("_marker"))

    rows = dedup_first(df.withColumn(DBH, dbh), tie_break, by).withColumn("_marker", F.lit(False))
    both = rows.unionByName(markers, allowMissingColumns=True)
    # a marker comes first in its tree and has no year, so that no row takes it for an earlier census
    ordered = W.partitionBy(*tree_partition(by)).orderBy(F.desc("_marker"), YEAR)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    multi, linked = is_multi(census_type), F.lag(YEAR).over(ordered)
    own = F.col(PREV_YEAR).try_cast("int") if PREV_YEAR in df.columns else F.lit(None).cast("int")
    measured = F.when(F.col(DBH).isNotNull(), F.col(YEAR))
    known = both.withColumns(
        {
            PREV_YEAR: F.when(multi, linked).otherwise(own),
            "valid_first": F.min(measured).over(whole),
            "valid_last": F.max(measured).over(whole),
            "tree_last": F.max(YEAR).over(whole),
            "plot_first": F.max("_plot_first").over(whole),
            "dataset_last": F.max("_dataset_last").over(whole),
        }
    ).where(~F.col("_marker"))
    unmeasured = F.col(DBH).isNull()
    entered = (F.col(YEAR) == F.col("valid_first")) & (F.col("valid_first") > F.col("plot_first"))
    status = (
        F.when(multi & entered, RECRUIT)
        .when(multi & unmeasured & (F.col(YEAR) > F.col("valid_last")), DEAD)
        .when(unmeasured, MISSING)
        .otherwise(ALIVE)
    )
    known = known.withColumn(STATUS, status if where is None else F.when(where, status).otherwise(F.col(STATUS)))
    columns = [c for c in (*df.columns, *([] if PREV_YEAR in df.columns else [PREV_YEAR]))]
    code = DISAPPEARED_CODES.get(disappeared)
    if code is None:
        return known.select(*[col(c) for c in columns], *([] if STATUS in columns else [STATUS]))
    gone = F.col("tree_last") < F.col("dataset_last")
    return _with_added(known, columns, code, gone & _may_disappear(census_type, where))


def disappeared_rows(
    df: DataFrame, disappeared: str, by: Sequence[str] = BY, years_from: DataFrame | None = None
) -> DataFrame:
    """Only the rows ``derive_full`` adds, before they are linked: ``PrevYR`` is null."""
    code = DISAPPEARED_CODES[disappeared]
    years = dataset_years(df if years_from is None else years_from, by)
    rows = df.withColumn("tree_last", F.max(YEAR).over(whole_tree(by)))
    rows = attach_dataset_value(rows, years, "dataset_last", by).where(
        (F.col(YEAR) == F.col("tree_last")) & (F.col("tree_last") < F.col("dataset_last"))
    )
    changes = {YEAR: F.col("dataset_last"), STATUS: F.lit(code), DBH: F.lit(None).cast("double")}
    if PREV_YEAR in df.columns:
        changes[PREV_YEAR] = F.lit(None).cast("int")
    return rows.withColumns(changes).drop("tree_last", "dataset_last")
