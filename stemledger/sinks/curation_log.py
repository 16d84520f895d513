"""Curation logs: one pre-filled text per dataset, built as a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemledger.operators.joins import left_join_groups
from stemledger.operators.validate import NO_LINKED_TREES, RECRUIT_AT_FIRST_YEAR
from stemledger.schema import DSN

# The head lines and sections of the log, in order.
HEAD = {
    "dsn": "DATASET",
    "country": "COUNTRY",
    "site": "SITE",
    "pi": "PI",
    "curator": "CURATOR",
    "date_received": "DATE RECEIVED",
    "date_processed": "DATE PROCESSED",
}
SECTIONS = (
    "SOURCE FORMAT",
    "PIVOT / RESTRUCTURING",
    "DUPLICATE RESOLUTION",
    "MISSING / INTERPOLATED DATA",
    "SPECIES ISSUES",
    "EXCLUSIONS",
    "NOTES",
)
FLAG_MARK = "[AUTO-FLAGGED] "
LOGGED_RULES = (RECRUIT_AT_FIRST_YEAR.name, NO_LINKED_TREES.name)


def finding_lines(found: DataFrame) -> DataFrame:
    """``(dsn, section, position, line)`` of the findings a curator has to judge."""
    return found.where(F.col("rule").isin(*LOGGED_RULES)).select(
        DSN,
        F.lit("NOTES").alias("section"),
        "position",
        F.concat(
            F.lit(FLAG_MARK), "rule", F.lit(" ("), F.col("row_count").cast("string"),
            F.lit(" rows) — "), "message",
        ).alias("line"),
    )


def disappeared_lines(summary: DataFrame) -> DataFrame:
    """A note for trees left unresolved in the last census, from ``derive_summary``."""
    return summary.where(F.col("disappeared_trees") > 0).select(
        DSN,
        F.lit("NOTES").alias("section"),
        F.lit(0).alias("position"),
        F.concat(
            F.col("disappeared_trees").cast("string"),
            F.lit(" trees are absent from the last census and were left unresolved."),
        ).alias("line"),
    )


def curation_logs(
    datasets: DataFrame,
    lines: Sequence[DataFrame],
    curator: str,
    date_processed: str,
) -> DataFrame:
    """``(dsn, log)`` for every dataset of a metadata table.

    ``datasets`` has one row per dataset; missing head columns are left blank.
    ``lines`` are frames ``(dsn, section, position, line)`` of log entries, which
    are findings or notes and so a handful per dataset.
    """
    given = {"curator": F.lit(curator), "date_processed": F.lit(date_processed)}
    head = []
    for name, label in HEAD.items():
        if name not in given:
            given[name] = F.col(name) if name in datasets.columns else F.lit(None)
        head.append(_labelled(label, given[name]))
        if name == "pi" and "contributor" in datasets.columns:
            head.append(_labelled("CONTRIBUTOR", F.col("contributor")))

    logged = datasets
    if lines:
        entries = lines[0]
        for more in lines[1:]:
            entries = entries.unionByName(more)
        indented = F.struct("position", F.concat(F.lit("  "), "line").alias("text"))
        grouped = entries.groupBy(DSN).agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("section") == s, indented))).alias(s)
                for s in SECTIONS
            ]
        )
        logged = left_join_groups(datasets, grouped, [DSN])
    body = []
    for section in SECTIONS:
        texts = F.array_join(F.col(f"`{section}`.text"), "\n") if lines else F.lit("")
        body += [F.lit(f"--- {section} ---"), F.coalesce(texts, F.lit(""))]
    text = F.concat(F.concat_ws("\n", *head, *body), F.lit("\n"))
    return logged.select(DSN, text.alias("log"))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value.cast("string"), F.lit("")))


def write_curation_logs(logs: DataFrame, path: str) -> None:
    """One text file folder per dataset."""
    logs.select(DSN, F.col("log").alias("value")).write.mode("overwrite").partitionBy(DSN).text(path)
