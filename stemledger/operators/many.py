"""Mapping many datasets by one table of mappings.

A mapping is data here: a row per dataset says which of its columns feed which field, how status codes are replaced and
which columns are censuses. One plan interprets these rows with higher-order functions over a map of each row's source
columns, so a plan for a thousand datasets is that for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemledger.functions.values import centimetres, col, parsed_double, year_of
from stemledger.operators.joins import few_whole
from stemledger.operators.mapping import exact_key
from stemledger.schema import CENSUS_SCHEMA, DBH, DSN, PLOT_ATTRIBUTES, STATUS, YEAR, DbhUnit

#: Source columns of a row by name, as text.
CELLS = "cells"
#: What is left of them once the fields are taken, as ``(name, value)`` in order of names.
EXTRAS = "extras"

KINDS = ("column", "literal", "concat", "year", "lookup")
EXPR = (
    "struct<target: string, kind: string, sources: array<string>, value: string, sep: string, lower: boolean, prefix: string>"
)
MAPPINGS = (
    f"dsn string, exprs array<{EXPR}>, codes array<struct<source: string, target: string>>, "
    "wide array<struct<source: string, year: int>>, dbh_unit string, census_type string"
)
FIELDS = [f.name for f in (*CENSUS_SCHEMA, *PLOT_ATTRIBUTES) if f.name != DSN]
_NUMBERS = {f.name for f in PLOT_ATTRIBUTES}
_YEARS = {f.name for f in CENSUS_SCHEMA if isinstance(f.dataType, T.IntegerType)}

#: A saved mapping as JSON, see ``plans.submission``.
_SAVED = (
    "struct<exprs: array<struct<kind: string, source: string, value: string, sources: array<string>, target: string, "
    "sep: string, lower: boolean, prefix: string, main_key: string>>, "
    "codes: array<struct<source: string, target: string>>, wide_pairs: array<array<string>>, "
    "metadata: struct<dbh_unit: string, census_type: string>>"
)


def mappings_from_json(saved: DataFrame) -> DataFrame:
    """Rows of ``MAPPINGS`` from stored mappings ``(dsn, mapping)``, each a JSON text; parsed by Spark, never collected."""
    read = saved.select(DSN, F.from_json("mapping", _SAVED).alias("m"))

    def expr(e: Column) -> Column:
        single = F.coalesce(e["main_key"], e["source"])
        return F.struct(
            e["target"].alias("target"),
            e["kind"].alias("kind"),
            F.coalesce(e["sources"], F.array_compact(F.array(single))).alias("sources"),
            e["value"].alias("value"),
            e["sep"].alias("sep"),
            e["lower"].alias("lower"),
            e["prefix"].alias("prefix"),
        )

    def pair(p: Column) -> Column:
        return F.struct(p[0].alias("source"), p[1].try_cast("int").alias("year"))

    return read.select(
        DSN,
        F.transform("m.exprs", expr).alias("exprs"),
        F.coalesce("m.codes", F.array().cast("array<struct<source: string, target: string>>")).alias("codes"),
        F.transform(F.coalesce("m.wide_pairs", F.array().cast("array<array<string>>")), pair).alias("wide"),
        F.col("m.metadata.dbh_unit").alias("dbh_unit"),
        F.col("m.metadata.census_type").alias("census_type"),
    )


def mapping_problems(mappings: DataFrame) -> DataFrame:
    """``(dsn, problem, detail)`` of everything that makes a mapping ambiguous or impossible.

    A repeated code or field has no single meaning, so it is rejected rather than settled in silence.
    """
    targets = F.transform("exprs", lambda e: e["target"])
    sources = F.transform("codes", lambda c: c["source"])
    years = F.transform("wide", lambda w: w["year"].cast("string"))
    keys = F.array_distinct(F.flatten(F.transform(F.filter("exprs", lambda e: e["kind"] == "lookup"), lambda e: e["sources"])))
    unknown = F.filter("exprs", lambda e: ~F.coalesce(e["kind"].isin(*KINDS), F.lit(False)))
    foreign = F.array_except(targets, F.array(*map(F.lit, FIELDS)))
    dated = F.filter("exprs", lambda e: (e["kind"] == "year") & ~e["target"].isin(*_YEARS))
    units = [u.value for u in DbhUnit]
    checks = [
        ("field mapped twice", _repeated(targets)),
        ("code listed twice", _repeated(sources)),
        ("census listed twice", _repeated(years)),
        ("unknown kind of expression", F.transform(unknown, lambda e: e["target"])),
        ("not a field", foreign),
        ("not a field of years", F.transform(dated, lambda e: e["target"])),
        ("several lookup keys", F.when(F.size(keys) > 1, keys)),
        ("unknown unit", F.when(~F.coalesce(F.col("dbh_unit").isin(*units), F.lit(True)), F.array("dbh_unit"))),
        ("no mapping", F.when(F.coalesce(F.size("exprs"), F.lit(0)) < 1, F.array(DSN))),
    ]
    found = F.flatten(F.array(*[_named(name, values) for name, values in checks]))
    own = mappings.select(DSN, F.inline(found))
    twice = mappings.groupBy(DSN).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return own.unionByName(twice.select(DSN, F.lit("dataset mapped twice").alias("problem"), col(DSN).alias("detail")))


def _named(problem: str, values: Column) -> Column:
    listed = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(listed, lambda v: F.struct(F.lit(problem).alias("problem"), v.alias("detail")))


def _repeated(values: Column) -> Column:
    """The values that an array holds more than once."""
    ordered = F.array_sort(values)
    same = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.array_compact(same))


class BadMappings(ValueError):
    """Some mappings cannot be followed."""


def check_mappings(mappings: DataFrame, lookups: DataFrame | None = None) -> None:
    """Raise for mappings with problems; the first few are named. Lookups need a table to look in."""
    problems = mapping_problems(mappings)
    if lookups is None:
        wanted = F.filter("exprs", lambda e: e["kind"] == "lookup")
        missing = mappings.select(DSN, F.explode(wanted).alias("e"))
        problems = problems.unionByName(missing.select(DSN, F.lit("no lookup table").alias("problem"), F.col("e.target").alias("detail")))
    first = problems.limit(5).collect()
    if first:
        raise BadMappings("; ".join(f"{r.dsn}: {r.problem}: {r.detail}" for r in first))


def cells_of(df: DataFrame, dsn: Column | str = DSN) -> DataFrame:
    """``(dsn, cells)`` of a typed table: the source columns of each row by name, as text."""
    key = col(dsn) if isinstance(dsn, str) else dsn
    names = [c for c in df.columns if c != DSN]
    pairs = [x for c in names for x in (F.lit(c), col(c).cast("string"))]
    return df.select(key.alias(DSN), F.create_map(*pairs).alias(CELLS))


def map_datasets(raw: DataFrame, mappings: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Rows ``(dsn, cells)`` of any datasets to one table with all fields as text, by each dataset's own mapping.

    The result holds every field, null where a dataset has none, ``extras`` (the columns that no field took), the
    dataset's ``census_type``, and ``derive``, true where it maps no status. Wide datasets give one row per census. Units are
    brought to centimetres. Rows of a dataset without a mapping have no fields and go.

    ``lookups`` are rows ``(dsn, lookup_key, PA, Latitude, Longitude)``, of which any of the last three may be left out:
    numbers looked up by the column that the dataset's lookup expressions name; a repeated key repeats the row.

    The mappings are one row per dataset. Up to ``joins.FEW_GROUPS`` of them go to each task whole, so that rows stay where
    they are: dealt out by dataset, few datasets would be few tasks. Each field's expression is picked out beside its mapping.
    """
    by_field = F.map_from_entries(F.transform(F.col("exprs"), lambda e: F.struct(e["target"], e)))
    rules = mappings.select(
        col(DSN).alias("_dsn"),
        *[F.element_at(by_field, F.lit(f)).alias(_rule(f)) for f in FIELDS],
        F.map_from_entries("codes").alias("_codes"),
        F.col("wide").alias("_wide"),
        F.coalesce("dbh_unit", F.lit(DbhUnit.CM.value)).alias("_unit"),
        "census_type",
        F.array_distinct(
            F.concat(
                F.flatten(F.transform(F.filter("exprs", lambda e: e["kind"].isin("column")), lambda e: e["sources"])),
                F.transform("wide", lambda w: w["source"]),
            )
        ).alias("_used"),
        F.filter("exprs", lambda e: e["kind"] == "lookup")[0]["sources"][0].alias("_key"),
    )
    rows = raw.select(DSN, CELLS).join(few_whole(rules), F.col(DSN) == F.col("_dsn"))
    fields = {f: _field(f) for f in FIELDS}
    if lookups is not None:
        rows = _with_lookups(rows, lookups)
        for f in sorted(_NUMBERS & set(lookups.columns)):
            kind = F.col(_rule(f))["kind"]
            fields[f] = F.when(kind == "lookup", F.col("_found")[f]).otherwise(fields[f])
    fields[STATUS] = F.coalesce(F.element_at("_codes", fields[STATUS]), fields[STATUS])
    census = F.struct(fields[YEAR].alias(YEAR), fields[DBH].alias(DBH))
    wide = F.transform(
        "_wide", lambda w: F.struct(w["year"].cast("string").alias(YEAR), F.element_at(F.col(CELLS), w["source"]).alias(DBH))
    )
    censuses = F.when(F.size("_wide") > 0, wide).otherwise(F.array(census))
    own = [fields[f].alias(f) for f in FIELDS if f not in (YEAR, DBH)]
    left = F.sort_array(F.array_except(F.map_keys(CELLS), "_used"))
    extras = F.transform(left, lambda name: F.struct(name.alias("key"), F.element_at(CELLS, name).alias("value")))
    derive = F.col(_rule(STATUS)).isNull()
    # fields are taken before a row becomes one per census, so that neither cells nor mapping are repeated with it
    taken = rows.select(
        DSN, *own, extras.alias(EXTRAS), "census_type", derive.alias("derive"), "_unit", censuses.alias("_censuses")
    )
    out = taken.select(*[c for c in taken.columns if c != "_censuses"], F.inline("_censuses"))
    return out.select(*FIELDS, DSN, EXTRAS, "census_type", "derive", "_unit")


def to_centimetres(df: DataFrame) -> DataFrame:
    """Conformed rows of ``map_datasets`` with their diameters in centimetres."""
    in_mm = F.col("_unit") == DbhUnit.MM.value
    return df.withColumn(DBH, F.when(in_mm, centimetres(F.col(DBH))).otherwise(F.col(DBH))).drop("_unit")


def _rule(name: str) -> str:
    """The column that holds the expression of a field, null where the dataset has none."""
    return f"_rule_{name}"


def _field(name: str) -> Column:
    """A field's text by the row's own expression; one SQL text per field, as plans are built from many small calls otherwise."""
    e = _rule(name)
    first = f"element_at({CELLS}, get({e}.sources, 0))"
    parts = f"transform({e}.sources, s -> element_at({CELLS}, s))"
    joined = f"concat_ws(coalesce({e}.sep, '_'), CASE WHEN length({e}.prefix) > 0 THEN {e}.prefix END, {parts})"  # leaves nulls out
    text = F.expr(
        f"""CASE {e}.kind WHEN 'column' THEN {first} WHEN 'literal' THEN {e}.value
            WHEN 'concat' THEN CASE WHEN coalesce({e}.lower, true) THEN lower({joined}) ELSE {joined} END END"""
    )
    if name not in _YEARS:
        return text
    return F.when(F.expr(f"{e}.kind = 'year'"), year_of(F.expr(first), T.StringType()).cast("string")).otherwise(text)


def _with_lookups(rows: DataFrame, lookups: DataFrame) -> DataFrame:
    """Rows joined once to all values of their key, however many fields they fill."""
    found = F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(_NUMBERS & set(lookups.columns))])
    side = lookups.select(
        col(DSN).alias("_l_dsn"), exact_key(F.col("lookup_key"), lookups.schema["lookup_key"].dataType).alias("_l_key"), found.alias("_found")
    )
    own = exact_key(F.element_at(F.col(CELLS), F.col("_key")), T.StringType())
    return rows.join(side, (F.col(DSN) == F.col("_l_dsn")) & (own == F.col("_l_key")), "left")
