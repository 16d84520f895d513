"""Validation rules: row predicates, counts per rule, findings, verdicts and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.operators.census import tree_partition
from stemledger.operators.joins import left_join_groups
from stemledger.operators.mapping import StatusCode, status_target
from stemledger.schema import (
    BY,
    DBH,
    DEAD,
    KNOWN_STATUSES,
    PLOT,
    PREV_YEAR,
    RECRUIT,
    ROW_KEYS,
    STATUS,
    TREE_KEYS,
    UNREAD,
    YEAR,
    CensusType,
    any_multi,
    is_multi,
    is_quarantined,
)


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    action: str
    multi_only: bool
    text: str


# Rule, severity and action names, in reporting order.
DUPLICATE = Rule(
    "DuplicateTreeWithinPlotYear", "RequiresInput", "ReviewAndConfirm", False,
    "measurements share plot, tree and year with another row; decide which to keep.",
)
UNKNOWN_STATUS = Rule(
    "UnknownStatus", "AutoRecode", "RecodeToMissing", False,
    "rows have a status outside the vocabulary; unless mapped they become missing (9).",
)
DEAD_WITH_DBH = Rule(
    "DeadTreeHasDbh", "AutoRecode", "NullifyDbh", False,
    "dead trees carry a diameter; it will be removed on export.",
)
RECRUIT_WITHOUT_DBH = Rule(
    "RecruitMissingDbh", "AutoDrop", "DropRows", False,
    "recruits have no diameter; these rows will be dropped on export.",
)
ORPHAN_DEAD = Rule(
    "OrphanDeadFirstCensus", "AutoDrop", "DropRows", True,
    "dead trees have no earlier census; these rows will be dropped on export.",
)
RECRUIT_AT_FIRST_YEAR = Rule(
    "RecruitAtMinYear", "Escalate", "EscalateToCurationLog", True,
    "recruits stand in their tree's first census year; a curator has to judge them.",
)
NO_LINKED_TREES = Rule(
    "NoPersistentTreeId", "Escalate", "EscalateToCurationLog", True,
    "trees, and none of them is found in two censuses; tree ids may not be persistent.",
)
UNREAD_YEAR = Rule(
    "UnreadableYear", "RequiresInput", "ReviewAndConfirm", False,
    "rows have a year that cannot be read; they are set aside.",
)
UNREAD_VALUE = Rule(
    "UnreadableValue", "AutoRecode", "RecodeToMissing", False,
    "rows have a number that cannot be read; it becomes missing.",
)
RULES = (
    DUPLICATE, UNKNOWN_STATUS, DEAD_WITH_DBH, RECRUIT_WITHOUT_DBH, ORPHAN_DEAD,
    RECRUIT_AT_FIRST_YEAR,
)
BLOCKING_SEVERITIES = ("RequiresInput", "Escalate")


def row_predicates(census_type: CensusType | str | Column = CensusType.MULTI) -> dict[Rule, Column]:
    """Predicates of the rules that look at one row only. A null status is not unknown.

    Here and below a column as ``census_type`` gives each row's own.
    """
    status, unmeasured = F.col(STATUS), F.col(DBH).isNull()
    predicates = {
        UNKNOWN_STATUS: ~status.isin(*KNOWN_STATUSES),
        DEAD_WITH_DBH: (status == DEAD) & ~unmeasured,
        RECRUIT_WITHOUT_DBH: (status == RECRUIT) & unmeasured,
    }
    if any_multi(census_type):
        predicates[ORPHAN_DEAD] = is_multi(census_type) & F.col(PREV_YEAR).isNull() & (status == DEAD)
    return predicates


def duplicate_groups(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, PlotID, TreeID, YR, n)`` of measurements that occur more than once."""
    return (
        df.groupBy(*by, *ROW_KEYS).agg(F.count(PLOT).alias("n")).where(F.col("n") > 1)
    )


def unknown_values(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, Status, row_count)`` of every status value outside the vocabulary."""
    return (
        df.where(~F.col(STATUS).isin(*KNOWN_STATUSES))
        .groupBy(*by, STATUS)
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def recruits_at_first_year(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, PlotID, TreeID, YR, row_count)``: recruits in their tree's first year.

    A tree's rows are never gathered: rows are counted per year first, then the
    count at the smallest year is taken.
    """
    per_year = df.groupBy(*by, *ROW_KEYS).agg(
        F.count_if(F.col(STATUS) == RECRUIT).alias("recruits")
    )
    per_tree = per_year.groupBy(*by, *TREE_KEYS).agg(
        F.min(YEAR).alias(YEAR), F.min_by("recruits", YEAR).alias("row_count")
    )
    return per_tree.where(F.col("row_count") > 0)


def rule_counts(
    df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI, by: Sequence[str] = BY
) -> DataFrame:
    """One row per dataset with a count per rule, from one scan of the needed columns.

    Counts are combined before every shuffle, in three steps: per measurement
    (copies), per tree (first year), per dataset. No step holds a group's rows,
    so neither a hot tree nor a hot dataset reaches one task. Rows that are not
    linked yet, and so have no ``PrevYR``, need no linking for this: a tree has no
    earlier census in its first year, and in a row without a year.
    """
    multi = any_multi(census_type)
    linked = is_multi(census_type)
    predicates = row_predicates(census_type)
    unlinked_rows = multi and PREV_YEAR not in df.columns
    if unlinked_rows:
        del predicates[ORPHAN_DEAD]
    sums = [rule.name for rule in predicates]
    per_measurement = df.groupBy(*by, *ROW_KEYS).agg(
        F.count(PLOT).alias("copies"),
        F.count_if(linked & (F.col(STATUS) == RECRUIT)).alias("recruits"),
        F.count_if(linked & (F.col(STATUS) == DEAD)).alias("dead"),
        F.max(linked).alias("linked"),
        *[F.count_if(p).alias(rule.name) for rule, p in predicates.items()],
    )
    none = F.lit(0).cast("bigint")
    orphans = F.coalesce(F.min_by("dead", YEAR), none) + F.coalesce(F.sum(F.when(F.col(YEAR).isNull(), F.col("dead"))), none)
    per_tree = per_measurement.groupBy(*by, *TREE_KEYS).agg(
        F.count_if(F.col("copies") > 1).alias(DUPLICATE.name),
        F.count(YEAR).alias("years"),
        F.max("linked").alias("linked"),
        F.coalesce(F.min_by("recruits", YEAR), F.lit(0).cast("bigint")).alias(
            RECRUIT_AT_FIRST_YEAR.name
        ),
        *[F.sum(n).alias(n) for n in sums],
        *([orphans.alias(ORPHAN_DEAD.name)] if unlinked_rows else []),
    )
    totals = [DUPLICATE.name, *sums, *([ORPHAN_DEAD.name] if unlinked_rows else [])]
    totals += [RECRUIT_AT_FIRST_YEAR.name] if multi else []
    unlinked = (
        F.when(F.max("linked") & (F.max("years") < 2), F.count(F.lit(1)))
        .otherwise(F.lit(0).cast("bigint"))
        .alias(NO_LINKED_TREES.name)
    )
    return per_tree.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in totals], *([unlinked] if multi else [])
    )


def findings(
    df: DataFrame,
    census_type: CensusType | str | Column = CensusType.MULTI,
    by: Sequence[str] = BY,
    check_linkage: bool = False,
) -> DataFrame:
    """``(by, position, rule, severity, action, row_count, message)``, rules that fired only.

    ``check_linkage`` adds the rule for datasets in which no tree was found twice.
    """
    multi = any_multi(census_type)
    rules = [r for r in RULES if multi or not r.multi_only]
    if check_linkage and multi:
        rules.append(NO_LINKED_TREES)
    stacked = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.action).alias("action"),
                F.coalesce(F.col(rule.name), F.lit(0).cast("bigint")).alias("row_count"),
                F.concat_ws(
                    " ", F.col(rule.name).cast("string"), F.lit(rule.text)
                ).alias("message"),
            )
            for i, rule in enumerate(rules)
        ]
    )
    counts = rule_counts(df, census_type, by)
    return counts.select(*by, F.inline(stacked)).where(F.col("row_count") > 0)


def duplicate_findings(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The finding on duplicates, in the form of ``findings``, from rows that still have them."""
    groups = duplicate_groups(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))
    return groups.select(
        *by,
        F.lit(1).alias("position"),
        F.lit(DUPLICATE.name).alias("rule"),
        F.lit(DUPLICATE.severity).alias("severity"),
        F.lit(DUPLICATE.action).alias("action"),
        "row_count",
        F.concat_ws(" ", F.col("row_count").cast("string"), F.lit(DUPLICATE.text)).alias("message"),
    )


def unread_findings(unread: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Findings, in the form of ``findings``, on rows with unreadable values (see ``schema.unread_rows``)."""
    rules = F.array(
        *[
            F.struct(
                F.lit(len(RULES) + 2 + i).alias("position"),
                F.lit(rule.name).alias("rule"),
                F.lit(rule.severity).alias("severity"),
                F.lit(rule.action).alias("action"),
                count.alias("row_count"),
                F.concat_ws(" ", count.cast("string"), F.lit(rule.text)).alias("message"),
            )
            for i, (rule, count) in enumerate(((UNREAD_YEAR, F.col("_years")), (UNREAD_VALUE, F.col("_values"))))
        ]
    )
    counted = unread.groupBy(*by).agg(
        F.count_if(is_quarantined()).alias("_years"), F.count_if(~is_quarantined()).alias("_values")
    )
    return counted.select(*by, F.inline(rules)).where(F.col("row_count") > 0)


def unread_values(unread: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, field, value, row_count)`` of every text that could not be read."""
    texts = unread.select(*by, F.explode(UNREAD).alias("field", "value"))
    return texts.groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("row_count"))


def with_unknown_values(found: DataFrame, df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Complete the message about unknown statuses with the number of values.

    The values themselves, of which a free-text column can hold any number, are
    the rows of ``unknown_values``.
    """
    n_values = unknown_values(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    suffix = F.concat(F.lit(" Found "), F.col("_n").cast("string"), F.lit(" values."))
    message = F.when(
        F.col("rule") == UNKNOWN_STATUS.name,
        F.concat("message", F.coalesce(suffix, F.lit(""))),
    ).otherwise(F.col("message"))
    return left_join_groups(found, n_values, by).withColumn("message", message).drop("_n")


def verdict(found: DataFrame, datasets: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, is_clean, has_blocking)`` for every dataset, clean ones included."""
    blocking = F.col("severity").isin(*BLOCKING_SEVERITIES)
    judged = found.groupBy(*by).agg(F.bool_or(blocking).alias("has_blocking"))
    return left_join_groups(datasets.select(*by).distinct(), judged, by).select(
        *by,
        F.col("has_blocking").isNull().alias("is_clean"),
        F.coalesce("has_blocking", F.lit(False)).alias("has_blocking"),
    )


def by_severity(found: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return found.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n_findings"))


def tree_records(
    df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI, by: Sequence[str] = BY
) -> DataFrame:
    """One row per tree about which a rule has something to say: what its rows cannot tell by themselves.

    ``_first`` is its first year, ``_copied`` the years in which it has several rows, ``_copied_undated`` whether it has
    several rows without a year. Rows are counted per measurement and then per tree, each time before the shuffle, so a
    tree is as many numbers as it has years.
    """
    multi = is_multi(census_type)
    status = F.col(STATUS) if STATUS in df.columns else F.lit(None).cast("string")
    per_measurement = df.groupBy(*by, *ROW_KEYS).agg(
        F.count(PLOT).alias("copies"), F.count_if(multi & status.isin(RECRUIT, DEAD)).alias("judged")
    )
    several, undated = F.col("copies") > 1, F.col(YEAR).isNull()
    trees = per_measurement.groupBy(*by, *TREE_KEYS).agg(
        F.min(YEAR).alias("_first"),
        F.collect_list(F.when(several, F.col(YEAR))).alias("_copied"),
        F.bool_or(several & undated).alias("_copied_undated"),
        (F.coalesce(F.min_by("judged", YEAR), F.lit(0)) + F.coalesce(F.sum(F.when(undated, F.col("judged"))), F.lit(0))).alias("judged"),
    )
    return trees.where((F.size("_copied") > 0) | F.col("_copied_undated") | (F.col("judged") > 0)).drop("judged")


def flag_rows(
    df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI, by: Sequence[str] = BY
) -> DataFrame:
    """Rows that break a rule, with the rule names in ``flags``.

    Copies, first years and missing links are told by one record per tree (see ``tree_records``), joined once and only for
    trees that matter; a hot tree in that join is split by adaptive execution. Rows may still have their copies and need
    not be linked: without ``PrevYR`` a tree has no earlier census in its first year. Rows without a status are only
    judged for copies.
    """
    joined = left_join_groups(df, tree_records(df, census_type, by), tree_partition(by))
    year, undated = F.col(YEAR), F.col(YEAR).isNull()
    copied = F.when(undated, F.col("_copied_undated")).otherwise(F.array_contains("_copied", year))
    # a measurement without a plot is no copy of another
    predicates = {DUPLICATE: F.coalesce(copied, F.lit(False)) & F.col(PLOT).isNotNull()}
    if STATUS in df.columns:
        linked = PREV_YEAR in df.columns
        own = row_predicates(census_type)
        if not linked and ORPHAN_DEAD in own:
            first = undated | (year == F.col("_first"))
            own[ORPHAN_DEAD] = is_multi(census_type) & (F.col(STATUS) == DEAD) & first
        predicates |= own
        if any_multi(census_type):
            at_first = (F.col(STATUS) == RECRUIT) & (year == F.col("_first"))
            predicates[RECRUIT_AT_FIRST_YEAR] = is_multi(census_type) & at_first
    flags = F.array_compact(F.array(*[F.when(p, rule.name) for rule, p in predicates.items()]))
    broken = reduce(or_, predicates.values())
    return joined.where(broken).withColumn("flags", flags).drop("_first", "_copied", "_copied_undated")


#: Share of trees found again in their plot's next census below which tree ids are doubted.
LEAST_LINKED = 0.1


def linkage_rates(df: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``(by, from_year, to_year, n_trees, n_found)``: trees of a census, and how many the plot's next census found again.

    Trees with the same years are counted together, so that a plot is as many rows as it has sets of years; its censuses
    are the years in any of these. No tree is joined with another. Rows without a year take no part.
    """
    trees = df.where(F.col(YEAR).isNotNull()).groupBy(*by, *TREE_KEYS).agg(F.sort_array(F.collect_set(YEAR)).alias("own"))
    sets = trees.groupBy(*by, PLOT, "own").agg(F.count(F.lit(1)).alias("n"))
    censuses = sets.groupBy(*by, PLOT).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("own")))).alias("years"))
    later = F.slice("years", F.lit(2), F.size("years"))
    steps = F.filter(
        F.arrays_zip(F.col("years").alias("a"), later.alias("b")), lambda s: s["b"].isNotNull()
    )
    pairs = left_join_groups(sets, censuses.select(*by, PLOT, steps.alias("steps")), [*by, PLOT])
    each = pairs.select(*by, "own", "n", F.explode("steps").alias("step")).where(F.array_contains("own", F.col("step.a")))
    return each.groupBy(*by, F.col("step.a").alias("from_year"), F.col("step.b").alias("to_year")).agg(
        F.sum("n").alias("n_trees"),
        F.sum(F.when(F.array_contains("own", F.col("step.b")), F.col("n")).otherwise(F.lit(0))).cast("bigint").alias("n_found"),
    )


def linkage_findings(
    df: DataFrame,
    census_type: CensusType | str | Column = CensusType.MULTI,
    by: Sequence[str] = BY,
    least: float = LEAST_LINKED,
) -> DataFrame:
    """A finding, in the form of ``findings``, on multi-census datasets in which some trees are found again but few.

    ``row_count`` are the trees that were not. Datasets in which no tree is found in two censuses have a finding of
    ``findings`` already.
    """
    rates = linkage_rates(df.where(is_multi(census_type)), by).groupBy(*by).agg(
        F.sum("n_trees").alias("n_trees"), F.sum("n_found").alias("n_found")
    )
    few = rates.where((F.col("n_found") > 0) & (F.col("n_found") < F.col("n_trees") * F.lit(least)))
    missed = F.col("n_trees") - F.col("n_found")
    text = F.concat_ws(
        " ", missed.cast("string"), F.lit("of"), F.col("n_trees").cast("string"),
        F.lit("trees were not found in their plot's next census; tree ids may not be persistent."),
    )
    return few.select(
        *by,
        F.lit(len(RULES) + 1).alias("position"),
        F.lit(NO_LINKED_TREES.name).alias("rule"),
        F.lit(NO_LINKED_TREES.severity).alias("severity"),
        F.lit(NO_LINKED_TREES.action).alias("action"),
        missed.alias("row_count"),
        text.alias("message"),
    )


def vocabulary_column(df: DataFrame, column: str = "", mapped: str = "") -> str:
    """The column to list codes of: asked for, else ``Status``, else the mapped source."""
    if column:
        chosen = column
    elif STATUS in df.columns:
        chosen = STATUS
    else:
        chosen = mapped or STATUS
    if chosen not in df.columns:
        raise ValueError(f"column {chosen!r} not found; map a status column first")
    return chosen


def status_vocabulary(
    df: DataFrame,
    codes: Sequence[StatusCode] = (),
    column: str = "",
    mapped: str = "",
    by: Sequence[str] = BY,
) -> DataFrame:
    """``(by, source_value, current_target, row_count)`` of the non-null status values."""
    value = col(vocabulary_column(df, column, mapped)).cast("string")
    return (
        df.where(value.isNotNull())
        .groupBy(*by, value.alias("source_value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            *by,
            "source_value",
            status_target(F.col("source_value"), codes).alias("current_target"),
            "row_count",
        )
    )
