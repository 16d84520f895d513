"""Operators on a header catalogue ``(dsn, ordinal, header)`` of many submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemledger.operators.joins import few_whole
from stemledger.schema import DBH, DSN, PLOT, PREV_YEAR, SPECIES, STATUS, TREE, YEAR

# The texts that suggest a field, fields in order of preference.
FIELD_ALIASES = {
    PLOT: ("plot", "plotid", "plot_id", "site"),
    TREE: ("tree", "treeid", "tree_id", "individual", "id"),
    YEAR: ("yr", "year", "census_year", "survey_year"),
    PREV_YEAR: ("prevyr", "prev_yr", "previous_year", "prev_year"),
    STATUS: ("status", "condition", "state", "fate"),
    DBH: ("dbh", "diameter", "diam", "d130", "d_bh"),
    SPECIES: ("species", "sp", "taxon", "spp", "scientific"),
}

# Fixed value: prefix of the placeholder names given to columns without a header.
PLACEHOLDER_PREFIX = "column_"


def _fits_any_pattern() -> str:
    """One pattern for "fits some field", matched on the lower-cased header.

    Aliases that contain another alias add nothing here. The look-ahead lets the
    matcher skip most positions on one character.
    """
    aliases = [a for group in FIELD_ALIASES.values() for a in group]
    needed = [a for a in aliases if not any(b != a and b in a for b in aliases)]
    first = "".join(sorted({a[0] for a in needed}))
    return f"(?=[{first}])(?:{'|'.join(a.replace('_', '[ _-]') for a in needed)})"


def _candidates(header: Column) -> Column:
    """Bit mask of the fields a header may stand for, lowest bit preferred."""
    text = F.translate(F.lower(header), " -", "__")
    mask = F.lit(0)
    for bit, aliases in enumerate(FIELD_ALIASES.values()):
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | text.contains(alias)
        mask = mask + F.when(hit, 1 << bit).otherwise(0)
    return mask


def assigned_fields(catalogue: DataFrame) -> DataFrame:
    """``(dsn, ordinal, field)``: each header in turn takes the first free field it fits.

    A header that fits ``k`` fields can only ever be given one if fewer than ``k``
    headers with the same candidate set came before it: each of those took one of
    the ``k`` fields. So at most seven headers per candidate set matter, which
    bounds the list folded per dataset however wide or hot a dataset is. The
    ranking is cut per task before the shuffle.
    """
    n = len(FIELD_ALIASES)
    fits = catalogue.where(F.lower("header").rlike(_fits_any_pattern())).select(
        DSN, "ordinal", _candidates(F.col("header")).alias("mask")
    )
    ranked = fits.withColumn(
        "rank", F.row_number().over(W.partitionBy(DSN, "mask").orderBy("ordinal"))
    ).where((F.col("rank") <= n) & (F.col("rank") <= F.bit_count("mask")))
    in_order = ranked.groupBy(DSN).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "mask"))).alias("headers")
    )

    def take(state: Column, header: Column) -> Column:
        free = header["mask"].bitwiseAND(F.bitwise_not(state["used"]))
        lowest = free.bitwiseAND(-free)
        pick = F.struct(header["ordinal"].alias("ordinal"), lowest.alias("bit"))
        return F.when(
            free != 0,
            F.struct(
                state["used"].bitwiseOR(lowest).alias("used"),
                F.concat(state["picks"], F.array(pick)).alias("picks"),
            ),
        ).otherwise(state)

    ordinal_type = catalogue.schema["ordinal"].dataType.simpleString()
    start = F.struct(
        F.lit(0).alias("used"),
        F.array().cast(f"array<struct<ordinal:{ordinal_type},bit:int>>").alias("picks"),
    )
    picks = in_order.select(
        DSN, F.inline(F.aggregate("headers", start, take, lambda s: s["picks"]))
    )
    field = F.lit(None).cast("string")
    for bit, name in enumerate(FIELD_ALIASES):
        field = F.when(F.col("bit") == (1 << bit), name).otherwise(field)
    return picks.select(DSN, "ordinal", field.alias("field"))


def suggest_fields(catalogue: DataFrame) -> DataFrame:
    """Every header of the catalogue with its suggested field, or null."""
    return catalogue.join(assigned_fields(catalogue), [DSN, "ordinal"], "left")


def detect_wide(catalogue: DataFrame) -> DataFrame:
    """Headers that end in four digits, with those digits as the census year."""
    digits = F.regexp_extract("header", r"(\d{4})\z", 1)
    return catalogue.withColumn("year", digits.try_cast("int")).where(digits != "")


def _is_blank(header: Column) -> Column:
    return (header == "") | header.startswith(PLACEHOLDER_PREFIX)


def header_findings(catalogue: DataFrame) -> DataFrame:
    """``(dsn, problem, header, n)`` for blank, placeholder and repeated headers.

    Blank and placeholder headers are reported once per column (``n`` counts
    them); a repeated header is reported with the number of repeats after the
    first.
    """
    blank = _is_blank(F.col("header"))
    counted = catalogue.groupBy(DSN, "header").agg(F.count(F.lit(1)).alias("count"))
    return counted.where(blank | (F.col("count") > 1)).select(
        DSN,
        F.when(blank, "blank_header").otherwise("duplicate_header").alias("problem"),
        "header",
        F.when(blank, F.col("count")).otherwise(F.col("count") - 1).alias("n"),
    )


def header_list_findings(lists: DataFrame) -> DataFrame:
    """``header_findings`` of ``(dsn, headers)``, where each row holds headers of its dataset as an array.

    A dataset in one row is judged within it, so that of its headers only the findings leave the task. Datasets in several
    rows, and rows without a dataset, are counted as a catalogue.
    """
    several = lists.groupBy(DSN).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1).select(DSN)
    several = few_whole(several.where(F.col(DSN).isNotNull()))
    named, unnamed = lists.where(F.col(DSN).isNotNull()), lists.where(F.col(DSN).isNull())
    apart = named.join(several, DSN, "left_semi").unionByName(unnamed)
    catalogue = apart.select(DSN, F.explode("headers").alias("header"))
    return _findings_within(named.join(several, DSN, "left_anti")).unionByName(header_findings(catalogue))


def _findings_within(lists: DataFrame) -> DataFrame:
    """The findings of datasets that are one row each."""
    # each blank, and each repeat after the first: as many as a finding counts, side by side
    counted = _bound(
        F.sort_array("headers"),
        lambda xs: F.filter(xs, lambda x, i: ((i > 0) & x.eqNullSafe(F.get(xs, i - 1))) | F.coalesce(_is_blank(x), F.lit(False))),
    )

    def runs(xs: Column) -> Column:
        first = F.transform(xs, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(xs, i - 1)), i))
        return _bound(F.array_compact(first), lambda at: F.transform(at, lambda begin, i: _run(xs, begin, F.get(at, i + 1))))

    problem = F.when(_is_blank(F.col("header")), "blank_header").otherwise("duplicate_header")
    return lists.select(DSN, F.inline(_bound(counted, runs))).select(DSN, problem.alias("problem"), "header", "n")


def _run(xs: Column, begin: Column, end: Column) -> Column:
    n = F.coalesce(end, F.size(xs)) - begin
    return F.struct(F.get(xs, begin).alias("header"), n.cast("bigint").alias("n"))


def _bound(array: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of an array that is computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(array), use), F.lit(0))
