"""End-to-end plans: raw table to mapped rows, prepared censuses, findings and files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.operators import census, many, mapping, reshape, status, validate
from stemledger.operators.finalize import finalize
from stemledger.plans.load import Loaded, admitted
from stemledger.plans.staging import staged
from stemledger.plans.submission import Submission, metadata_table, write_metadata
from stemledger.schema import (
    ALIVE,
    BY,
    CENSUS_SCHEMA,
    DBH,
    DSN,
    MISSING,
    STATUS,
    CensusType,
    conform,
    is_quarantined,
    readable_rows,
    unread_rows,
)
from stemledger.sinks import curation_log, writers
from stemledger.sinks.provenance import Provenance, draft_name


def map_long(raw: DataFrame, submission: Submission) -> DataFrame:
    """Raw long table to canonical columns and types; duplicates are still there, rows whose year cannot be read are not."""
    return _typed(_long(raw, submission), submission)


def map_wide(raw: DataFrame, submission: Submission) -> DataFrame:
    """Raw wide table to canonical long rows. Id columns and looked-up columns are kept."""
    return _typed(_wide(raw, submission), submission)


def map_submission(raw: DataFrame, submission: Submission) -> DataFrame:
    return (map_wide if submission.wide_pairs else map_long)(raw, submission)


def unread_submission(raw: DataFrame, submission: Submission) -> DataFrame:
    """The rows with values that cannot be read, their texts in ``_unread``; ``map_submission`` has none with such a year."""
    mapped = (_wide if submission.wide_pairs else _long)(raw, submission)
    return mapping.scale_dbh(unread_rows(mapped), submission.metadata.dbh_unit)


def _long(raw: DataFrame, submission: Submission) -> DataFrame:
    return _coded(mapping.map_fields(raw, submission.exprs, submission.dsn), submission)


def _wide(raw: DataFrame, submission: Submission) -> DataFrame:
    mapped = mapping.map_fields(raw, submission.exprs, submission.dsn)
    ids = [e.target for e in submission.exprs] + [DSN]
    return _coded(reshape.melt_wide(mapped, ids, submission.wide_pairs), submission)


def _coded(mapped: DataFrame, submission: Submission) -> DataFrame:
    return mapping.remap_status(mapped, submission.codes) if STATUS in mapped.columns else mapped


def _typed(mapped: DataFrame, submission: Submission) -> DataFrame:
    return mapping.scale_dbh(conform(readable_rows(mapped)), submission.metadata.dbh_unit)


@dataclass(frozen=True)
class Harmonized:
    """One dataset on its way: mapped rows, and prepared rows with a status."""

    mapped: DataFrame
    prepared: DataFrame
    #: One type for all rows, or the column that holds each row's own.
    census_type: CensusType | Column
    deduplicated: bool = True
    #: Treatment of disappeared trees if the status was derived, else None.
    disappeared: str | None = None
    #: Rows with values that cannot be read (see ``schema.unread_rows``); those without a year are in no other table.
    unread: DataFrame | None = None

    def quarantined(self) -> DataFrame | None:
        """Rows set aside because their year cannot be read."""
        return None if self.unread is None else self.unread.where(is_quarantined())

    def findings(self) -> DataFrame:
        """Findings on the prepared rows; duplicates are judged before they were removed."""
        found = validate.findings(self.prepared, self.census_type, check_linkage=True)
        if isinstance(self.census_type, Column) or self.census_type is CensusType.MULTI:
            found = found.unionByName(validate.linkage_findings(self.prepared, self.census_type))
        found = found.where(F.col("rule") != validate.DUPLICATE.name)
        found = found.unionByName(validate.duplicate_findings(self.mapped))
        if self.unread is not None:
            found = found.unionByName(validate.unread_findings(self.unread))
        return validate.with_unknown_values(found, self.prepared)

    def final(self) -> DataFrame:
        final = finalize(self.prepared, self.census_type)
        return final.drop("census_type", "derive") if isinstance(self.census_type, Column) else final


def harmonize(
    raw: DataFrame | Loaded,
    submission: Submission,
    disappeared: str = "dead",
    tie_break: Sequence[str | Column] | None = None,
    many_plots: bool = False,
) -> Harmonized:
    """The lazy plan from a raw table to prepared rows with a status.

    Without a status column the status is derived from census structure. In a
    single census there is no structure, so a measured tree is alive and an
    unmeasured one missing. A loaded table (see ``plans.load``) that does not pass
    its gate is refused. ``many_plots`` says that plots are too many to broadcast
    (see ``status.prepare_and_derive``).
    """
    raw = admitted(raw)
    census_type = CensusType.parse(submission.metadata.census_type)
    mapped = map_submission(raw, submission)
    # One dataset needs no dataset key: as a constant it would only blur the joins.
    rows = mapped.drop(DSN)
    prepared = census.prepare(rows, census_type, tie_break, by=())
    derived = None
    if STATUS not in mapped.columns:
        if census_type is CensusType.MULTI:
            derived = disappeared
            if many_plots:
                prepared = status.prepare_and_derive(rows, disappeared, tie_break, by=())
            else:
                prepared = status.derive_full(prepared, disappeared, by=(), years_from=rows)
        else:
            alive = F.when(F.col(DBH).isNotNull(), ALIVE).otherwise(MISSING)
            prepared = prepared.withColumn(STATUS, alive)
    prepared = prepared.withColumn(DSN, F.lit(submission.dsn))
    unread = unread_submission(raw, submission)
    return Harmonized(mapped, prepared, census_type, disappeared=derived, unread=unread)


def harmonize_many(
    raw: DataFrame,
    mappings: DataFrame,
    lookups: DataFrame | None = None,
    disappeared: str = "dead",
    tie_break: Sequence[str | Column] | None = None,
    many_plots: bool = True,
) -> Harmonized:
    """One plan from raw rows ``(dsn, cells)`` of any number of datasets to prepared rows with a status.

    ``mappings`` has a row per dataset (see ``operators.many``); ambiguous ones are refused before anything is read. Statuses
    are derived in the datasets that map none. Each dataset keeps its own unit and census type. Plots of many datasets are
    taken to be too many to broadcast, unless ``many_plots`` says otherwise. The mapped rows are staged here, the rest is lazy.
    """
    many.check_mappings(mappings, lookups)
    texts = many.map_datasets(raw, mappings, lookups)
    # trees, plots and rows are read from it in turn, and mapping a row costs more than reading it back
    mapped = staged(many.to_centimetres(conform(readable_rows(texts))), "mapped")
    kind = F.col("census_type")
    derive = F.col("derive")
    if many_plots:
        prepared = status.prepare_and_derive(mapped, disappeared, tie_break, census_type=kind, where=derive)
    else:
        linked = census.prepare(mapped, kind, tie_break)
        prepared = status.derive_full(linked, disappeared, years_from=mapped, census_type=kind, where=derive)
    return Harmonized(
        mapped, prepared, kind, disappeared=disappeared, unread=many.to_centimetres(unread_rows(texts))
    )


def diagnose(raw: DataFrame | Loaded, dsn: str, census_type: CensusType | str = "multi") -> Harmonized:
    """A table that already has canonical columns: only validated, never changed."""
    raw = admitted(raw)
    raw = raw if DSN in raw.columns else raw.withColumn(DSN, F.lit(dsn))
    rows = conform(readable_rows(raw))
    return Harmonized(rows, rows, CensusType.parse(census_type), deduplicated=False, unread=unread_rows(raw))


class BlockedExport(Exception):
    """A finding needs a decision before the dataset can be delivered."""


def export(
    work: Harmonized,
    submission: Submission,
    folder: str,
    base_name: str,
    formats: Sequence[str] = ("csv", "parquet", "xlsx"),
    curator: str = "",
    timestamp: str | None = None,
    strict: bool = True,
    dataset_column: str = DSN,
    source_name: str = "",
) -> list[str]:
    """Write the cleaned dataset in each format, its metadata and its curation log, and unknown status values if there are any.

    The prepared rows are staged once, because the report and every format read
    them. With ``strict`` a blocking finding raises; only the handful of findings
    reaches the driver. ``dataset_column`` renames the dataset id on the way out.
    """
    unknown = set(formats) - {"csv", "parquet", "xlsx"}
    if unknown:
        raise ValueError(f"unknown format {sorted(unknown)[0]!r}")
    spark = work.prepared.sparkSession
    work = replace(work, prepared=staged(work.prepared, submission.dsn))
    found = work.findings()
    report = found.collect()
    blocking = [f.rule for f in report if f.severity in validate.BLOCKING_SEVERITIES]
    if strict and blocking:
        raise BlockedExport(f"resolve first: {', '.join(blocking)}")

    provenance = Provenance.draft(submission.dsn, timestamp)
    base = folder.rstrip("/")
    written = []

    def target(extension: str) -> str:
        written.append(f"{base}/{draft_name(base_name, extension)}")
        return written[-1]

    final = work.final()
    named = final.select(*[col(c).alias(dataset_column if c == DSN else c) for c in final.columns])
    unique = work.deduplicated
    if "parquet" in formats:
        ordered = census.census_sort(named, by=[dataset_column], unique=unique)
        writers.write_parquet(ordered, target("parquet"), provenance)
    if "csv" in formats:
        writers.write_csv(named, target("csv"), provenance, dataset_column, unique)
    if "xlsx" in formats:
        path = target("xlsx")
        done = writers.write_workbooks(
            named,
            base,
            lambda dsn, file: draft_name(base_name if file == 0 else f"{base_name}_{file + 1}", "xlsx"),
            provenance,
            dataset_column=dataset_column,
        ).collect()
        if not done:
            writers.write_hollow_workbook(named.columns, path, provenance)
        written[-1:] = sorted(r.path for r in done) or [path]

    if validate.UNKNOWN_STATUS.name in {f.rule for f in report}:
        written.append(f"{base}/{base_name}_unknown_values.json")
        validate.unknown_values(work.prepared).write.mode("overwrite").json(written[-1])
    if {validate.UNREAD_YEAR.name, validate.UNREAD_VALUE.name} & {f.rule for f in report}:
        written += _write_unread(work.unread, f"{base}/{base_name}")
    datasets = metadata_table(spark, [submission])
    write_metadata(datasets, f"{base}/{base_name}_metadata.json")
    written.append(f"{base}/{base_name}_metadata.json")
    lines = [
        curation_log.finding_lines(spark.createDataFrame(report, found.schema)),
        _declared_lines(spark, submission, source_name),
    ]
    if work.disappeared is not None and work.disappeared not in status.DISAPPEARED_CODES:
        lines.append(curation_log.disappeared_lines(status.derive_summary(work.prepared)))
    logs = curation_log.curation_logs(datasets, lines, curator, provenance.timestamp[:10])
    log_path = f"{base}/{base_name}_curation_log.txt"
    writers.write_text_file(spark, log_path, logs.first().log.removesuffix("\n"))
    return [*written, log_path]


def _write_unread(unread: DataFrame, base: str) -> list[str]:
    """The rows with unreadable values, and their texts with the rows that have each."""
    paths = [f"{base}_unread", f"{base}_unread_values.json"]
    unread.write.mode("overwrite").parquet(paths[0])
    validate.unread_values(unread).write.mode("overwrite").json(paths[1])
    return paths


def _declared_lines(spark: SparkSession, submission: Submission, source_name: str) -> DataFrame:
    """Log lines from the submission itself: its file, and notes on status codes."""
    lines = [("SOURCE FORMAT", 0, source_name)] if source_name else []
    if submission.wide_pairs:
        years = ", ".join(str(year) for _, year in submission.wide_pairs)
        lines.append(("PIVOT / RESTRUCTURING", 0, f"Wide to long for the censuses of {years}."))
    lines += [
        ("NOTES", 100 + i, f"Status {code.source!r} was mapped to {code.target}: {code.note}")
        for i, code in enumerate(submission.codes)
        if code.note
    ]
    return spark.createDataFrame(
        [(submission.dsn, *line) for line in lines],
        "dsn string, section string, position int, line string",
    )


def deliver(
    prepared: DataFrame,
    datasets: DataFrame,
    folder: str,
    base_name: str,
    formats: Sequence[str] = ("parquet",),
    census_type: CensusType | str | None = None,
    curator: str = "",
    timestamp: str | None = None,
    notes: Sequence[DataFrame] = (),
    mapped: DataFrame | None = None,
    strict: bool = True,
    unread: DataFrame | None = None,
) -> list[str]:
    """Write many datasets from one table of prepared rows.

    ``datasets`` has a metadata row per dataset, from which its census type is
    read unless ``census_type`` names one for all. ``notes`` are further log lines
    (see ``sinks.curation_log``). Duplicates are judged on ``mapped``, the rows
    before they were removed. With ``strict`` the rows of datasets with a blocking
    finding are left out; ``…_blocked.json`` has these findings in any case, and
    ``…_flagged`` the rows that break a rule, copies among them if ``mapped`` is given, and ``…_unknown_values.json`` every status value outside the
    vocabulary with its rows counted. ``unread`` are rows with values that could not be read; they are judged and written
    too. Every output is split by dataset by Spark; nothing is looped over or collected, whatever the number of
    datasets.
    """
    kind: CensusType | str | Column = census_type or CensusType.MULTI
    if census_type is None and "census_type" in datasets.columns:
        prepared = census.with_census_type(prepared, datasets, "_census_type")
        kind = F.col("_census_type")
    rows = staged(prepared, base_name)
    found = validate.findings(rows, kind, check_linkage=True).unionByName(validate.linkage_findings(rows, kind))
    if mapped is not None:
        found = found.where(F.col("rule") != validate.DUPLICATE.name)
        found = found.unionByName(validate.duplicate_findings(mapped))
    if unread is not None:
        found = found.unionByName(validate.unread_findings(unread))
    found = staged(found, f"{base_name}-findings")
    blocking = found.where(F.col("severity").isin(*validate.BLOCKING_SEVERITIES))
    final = finalize(rows, kind).drop("_census_type")
    if strict:
        final = final.join(blocking.select(DSN).distinct(), DSN, "left_anti")
    named = datasets.select(DSN)  # those that lose all their rows still get a file
    if strict:
        named = named.join(blocking.select(DSN).distinct(), DSN, "left_anti")
    provenance = Provenance.draft("", timestamp)
    base = folder.rstrip("/")
    written = []
    for fmt in formats:
        path = f"{base}/{draft_name(base_name, fmt)}"
        if fmt == "parquet":
            ordered = census.census_sort(final, unique=True)
            writers.write_parquet(ordered, path, provenance, [DSN])
        elif fmt == "csv":
            writers.write_csv_by_dataset(final, path, provenance, datasets=named)
        elif fmt == "xlsx":
            done = writers.write_workbooks(
                final, path, lambda dsn, file: draft_name(f"{dsn}_{file + 1}", "xlsx"), provenance
            )
            done.write.mode("overwrite").json(f"{base}/{base_name}_workbooks.json")
        else:
            raise ValueError(f"unknown format {fmt!r}")
        written.append(path)
    logs = curation_log.curation_logs(
        datasets, [curation_log.finding_lines(found), *notes], curator, provenance.timestamp[:10]
    )
    curation_log.write_curation_logs(logs, f"{base}/{base_name}_curation_logs")
    write_metadata(datasets, f"{base}/{base_name}_metadata.json")
    blocking.write.mode("overwrite").json(f"{base}/{base_name}_blocked.json")
    flagged = _flagged(rows, mapped, datasets, kind)
    flagged.write.mode("overwrite").parquet(f"{base}/{base_name}_flagged")
    validate.unknown_values(rows).write.mode("overwrite").json(f"{base}/{base_name}_unknown_values.json")
    reports = ("curation_logs", "metadata.json", "blocked.json", "flagged", "unknown_values.json")
    written += [f"{base}/{base_name}_{report}" for report in reports]
    return written if unread is None else [*written, *_write_unread(unread, f"{base}/{base_name}")]


def _flagged(rows: DataFrame, mapped: DataFrame | None, datasets: DataFrame, kind: CensusType | str | Column) -> DataFrame:
    """Rows that break a rule. Copies are only found before they are removed, so mapped rows are judged where they are given;
    where their status was derived later, they are judged for copies, and the prepared rows for the rest."""
    if mapped is None:
        return validate.flag_rows(rows, kind).drop("_census_type")
    if STATUS not in mapped.columns:
        copies = validate.flag_rows(mapped)
        return validate.flag_rows(rows, kind).drop("_census_type").unionByName(copies, allowMissingColumns=True)
    if isinstance(kind, Column):
        mapped = census.with_census_type(mapped, datasets, "_census_type")
    return validate.flag_rows(mapped, kind).drop("_census_type")


def canonical(df: DataFrame) -> DataFrame:
    """Only the canonical columns that are present, in their fixed order."""
    return df.select(*[f.name for f in CENSUS_SCHEMA if f.name in df.columns])


__all__ = [
    "BY",
    "BlockedExport",
    "Harmonized",
    "canonical",
    "deliver",
    "diagnose",
    "export",
    "harmonize",
    "harmonize_many",
    "map_long",
    "map_submission",
    "map_wide",
    "unread_submission",
]
