"""Mapping source columns onto canonical fields: renames, literals, concats, lookups, codes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemledger.functions.values import centimetres, col, parsed_double, safe_cast, year_of
from stemledger.schema import DBH, DSN, MISSING, STATUS, DbhUnit
from stemledger.sources.readers import read_table


@dataclass(frozen=True)
class Column:
    """The target takes a source column's values; the source name disappears."""

    source: str
    target: str


@dataclass(frozen=True)
class Literal:
    """A constant; text that reads as a number becomes a double."""

    value: str
    target: str


@dataclass(frozen=True)
class Concat:
    """Source columns joined as text, nulls left out, lower-cased unless told otherwise."""

    sources: Sequence[str]
    target: str
    sep: str = "_"
    lower: bool = True
    prefix: str | None = None


@dataclass(frozen=True)
class YearOf:
    """Census year of a date or text column."""

    source: str
    target: str = "YR"


@dataclass(frozen=True)
class Lookup:
    """A number looked up in another table or file: ``table.lookup_key = main_key``."""

    table: DataFrame | str
    main_key: str
    lookup_key: str
    value: str
    target: str


FieldExpr = Column | Literal | Concat | YearOf | Lookup


def literal_value(text: str) -> SparkColumn:
    """A number when the whole text is one, else the text."""
    try:
        if text != text.strip() or "_" in text:
            raise ValueError(text)
        return F.lit(float(text))
    except ValueError:
        return F.lit(text)


def _compile(df: DataFrame, expr: FieldExpr) -> SparkColumn:
    match expr:
        case Column(source, _):
            return col(source)
        case Literal(value, _):
            return literal_value(value)
        case YearOf(source, _):
            return year_of(col(source), df.schema[source].dataType)
        case Concat(sources, _, sep, lower, prefix):
            parts = [F.lit(prefix)] if prefix else []
            parts += [col(s).cast("string") for s in sources]
            joined = F.concat_ws(sep, *parts)
            return F.lower(joined) if lower else joined
    raise TypeError(f"not a field expression: {expr!r}")


def rename_columns(df: DataFrame, pairs: Sequence[tuple[str, str]], dsn: str) -> DataFrame:
    """Rename source columns to fields and add the dataset id.

    Pairs whose source is absent are skipped; columns without a pair are kept.
    """
    present = [Column(s, t) for s, t in pairs if s in df.columns]
    return map_fields(df, present, dsn)


def map_fields(df: DataFrame, exprs: Sequence[FieldExpr], dsn: str | SparkColumn) -> DataFrame:
    """Apply field expressions in one projection and add the dataset id.

    Every expression sees the source columns, whatever the order. A source that
    was renamed is dropped; other columns pass through unless a target replaces
    them. One that differs from a target only in case gets ``_source`` appended,
    as Spark could not tell the two apart. Lookups are joined first.
    """
    lookups = [e for e in exprs if isinstance(e, Lookup)]
    direct = [e for e in exprs if not isinstance(e, Lookup)]
    targets = [e.target for e in exprs]
    if len(set(targets)) != len(targets):
        raise ValueError(f"a field is mapped twice: {targets}")
    joined = join_lookups(df, lookups)
    renamed = {e.source for e in direct if isinstance(e, Column)}
    direct_targets = {e.target for e in direct}
    taken = {t.lower() for t in [*targets, DSN]} - {e.target.lower() for e in lookups}
    kept = [
        col(c).alias(f"{c}_source" if c.lower() in taken else c)
        for c in joined.columns
        if c not in direct_targets and c not in renamed and c != DSN
    ]
    dsn_column = F.lit(dsn) if isinstance(dsn, str) else dsn
    return joined.select(
        *kept, *[_compile(joined, e).alias(e.target) for e in direct], dsn_column.alias(DSN)
    )


def join_lookups(df: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """Left-join lookup tables, one join per (table, keys) however many values it gives.

    Repeated lookup keys repeat the row. Keys of different number types, or of a
    number and a text, meet by their exact value. The join is not hinted: a table whose
    files are small is broadcast by its known size, a large one is sort-merged,
    and adaptive execution splits a hot main key.
    """
    groups: dict[tuple, list[Lookup]] = {}
    for lookup in lookups:
        source = lookup.table if isinstance(lookup.table, str) else id(lookup.table)
        groups.setdefault((source, lookup.main_key, lookup.lookup_key), []).append(lookup)
    for (_, main_key, lookup_key), members in groups.items():
        table = members[0].table
        if isinstance(table, str):
            table = read_table(df.sparkSession, table)
        replaced = {m.target for m in members}
        if main_key in replaced:
            raise ValueError(f"the key column {main_key!r} cannot be a lookup target")
        right = table.select(
            col(lookup_key).alias("_lookup_key"),
            *[_as_double(table, m.value).alias(m.target) for m in members],
        )
        left = df.select(*[col(c) for c in df.columns if c not in replaced])
        key = col(main_key)
        one, other = df.schema[main_key].dataType, table.schema[lookup_key].dataType
        whole = isinstance(one, T.IntegralType) and isinstance(other, T.IntegralType)
        if one != other and not whole:
            # numbers meet as numbers: 1 and 1.0 are one key, and a text that is a number is that number
            numeric = [isinstance(t, T.NumericType) for t in (one, other)]
            same = exact_key if any(numeric) and all(
                n or isinstance(t, T.StringType) for n, t in zip(numeric, (one, other), strict=True)
            ) else _as_text
            key, right = same(key, one), right.withColumn("_lookup_key", same(F.col("_lookup_key"), other))
        df = left.join(right, key == F.col("_lookup_key"), "left").drop("_lookup_key")
    return df


#: Parts of a number's text: sign, digits before and behind the point, power of ten.
_NUMBER = r"^\s*([+-]?)0*(\d*)(?:\.(\d*?))?(?:[eE]([+-]?\d+))?\s*$"


def exact_key(key: SparkColumn, dtype: T.DataType) -> SparkColumn:
    """A normal form in which equal numbers of any type have equal texts and others differ, with no digit rounded away.

    The form is sign, digits without zeros at either end, and the power of ten of the last digit: ``1``, ``1.0`` and
    ``10e-1`` are ``1e0``. A text that is no number stays as it is.
    """
    text = key.cast("string")
    if isinstance(dtype, T.IntegralType):
        # whole numbers need no parsing: zeros at the end are all there is to move
        digits = F.regexp_extract(text, r"^-?(\d*?)0*$", 1)
        zeros = F.length(F.regexp_extract(text, r"(0*)$", 1))
        sign = F.when(text.startswith("-"), "-").otherwise("")
        return F.when(digits == "", F.lit("0")).otherwise(F.concat(sign, digits, F.lit("e"), zeros.cast("string")))
    part = [F.regexp_extract(text, _NUMBER, i) for i in range(5)]
    before, behind = part[2], F.rtrim(part[3], F.lit("0"))
    digits = F.ltrim(F.concat(before, behind), F.lit("0"))
    cut = F.rtrim(digits, F.lit("0"))
    power = F.coalesce(part[4].try_cast("long"), F.lit(0)) - F.length(behind) + F.length(digits) - F.length(cut)
    sign = F.when(part[1] == "-", "-").otherwise("")
    number = F.when(cut == "", F.lit("0")).otherwise(F.concat(sign, cut, F.lit("e"), power.cast("string")))
    sound = text.rlike(_NUMBER) & text.rlike(r"\d") & ((part[4] == "") | part[4].try_cast("int").isNotNull())
    return F.when(sound, number).otherwise(text)


def _as_text(key: SparkColumn, dtype: T.DataType) -> SparkColumn:
    return key.cast("string")


def _as_double(table: DataFrame, name: str) -> SparkColumn:
    if table.schema[name].dataType.simpleString() == "string":
        return parsed_double(col(name))
    return safe_cast(col(name), "double")


def scale_dbh(df: DataFrame, unit: DbhUnit | str | None) -> DataFrame:
    """Bring diameters to centimetres."""
    if DbhUnit.parse(unit) is DbhUnit.CM:
        return df
    return df.withColumn(DBH, centimetres(F.col(DBH)))


# --- status vocabulary ---------------------------------------------------------------


@dataclass(frozen=True)
class StatusCode:
    source: str
    target: str
    note: str | None = None


def remap_status(df: DataFrame, codes: Sequence[StatusCode]) -> DataFrame:
    """Replace listed status values; others stay, and of repeated sources the last wins."""
    chosen = {c.source: c.target for c in codes}
    if not chosen:
        return df
    value = F.col(STATUS).cast("string")
    return df.withColumn(STATUS, F.coalesce(_code_map(chosen)[value], value))


def _code_map(chosen: dict[str, str]) -> SparkColumn:
    """The codes as one map literal, so that a plan does not grow with their number."""
    return F.from_json(F.lit(json.dumps(chosen)), "map<string, string>")


def remap_status_or_missing(df: DataFrame, codes: Sequence[StatusCode]) -> DataFrame:
    """Code of each status value, ``9`` when unlisted; of repeated sources the first wins."""
    return df.withColumn(STATUS, status_target(F.col(STATUS), codes))


def status_target(value: SparkColumn, codes: Sequence[StatusCode]) -> SparkColumn:
    chosen: dict[str, str] = {}
    for code in codes:
        chosen.setdefault(code.source, code.target)
    return F.coalesce(_code_map(chosen)[value.cast("string")], F.lit(MISSING))


def remap_status_by_table(
    df: DataFrame, table: DataFrame, default: str | None = None
) -> DataFrame:
    """Remap statuses of many datasets with a table ``(dsn, source, target)``.

    Without a default, unlisted values stay. The table must hold one target per
    (dsn, source); one that does not fails the job, as rows would be doubled. It
    grows with the number of datasets, so its join is unhinted.
    """
    listed = table.groupBy(F.col(DSN).alias("_dsn"), F.col("source").alias("_source")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("target").alias("_one")
    )
    clash = F.raise_error(F.concat(F.lit("status code listed twice: "), "_dsn", F.lit(", "), "_source"))
    codes = listed.select("_dsn", "_source", F.when(F.col("_n") > 1, clash).otherwise(F.col("_one")).alias("_target"))
    status = F.col(STATUS).cast("string")
    joined = df.join(codes, (F.col(DSN) == F.col("_dsn")) & (status == F.col("_source")), "left")
    fallback = status if default is None else F.lit(default)
    return joined.withColumn(STATUS, F.coalesce("_target", fallback)).drop(
        "_dsn", "_source", "_target"
    )


# --- from a submission form to field expressions -------------------------------------


@dataclass(frozen=True)
class Choice:
    """A field taken from a column or, failing that, from a constant."""

    column: str = ""
    constant: str = ""


@dataclass(frozen=True)
class PlotTable:
    """A second table with plot attributes, matched on one key."""

    table: DataFrame | str
    main_key: str
    lookup_key: str
    latitude: str = ""
    longitude: str = ""
    area: str = ""


@dataclass(frozen=True)
class FieldChoices:
    """What a contributor picked for each field."""

    plot: Sequence[str] = ()
    plot_prefix: str = ""
    tree: Sequence[str] = ()
    year: str = ""
    dbh: str = ""
    species: str = ""
    status: str = ""
    latitude: Choice = field(default_factory=Choice)
    longitude: Choice = field(default_factory=Choice)
    area: Choice = field(default_factory=Choice)
    plot_table: PlotTable | None = None


def _identity(target: str, sources: Sequence[str], prefix: str = "") -> list[FieldExpr]:
    if not sources:
        return []
    if len(sources) == 1 and not prefix:
        return [Column(sources[0], target)]
    return [Concat(tuple(sources), target, prefix=prefix or None)]


def compile_choices(choices: FieldChoices) -> list[FieldExpr]:
    """Field expressions for a set of choices.

    Plot attributes come from the plot table if it has them, else from a column,
    else from a constant. An id made of one column without a prefix is a rename.
    """
    exprs = _identity("PlotID", choices.plot, choices.plot_prefix.strip())
    exprs += _identity("TreeID", choices.tree)
    simple = {"DBH": choices.dbh, "YR": choices.year, "Species": choices.species}
    exprs += [Column(source, target) for target, source in simple.items() if source]

    extra = choices.plot_table
    looked_up = {
        "Latitude": extra.latitude, "Longitude": extra.longitude, "PA": extra.area,
    } if extra else {}
    picked = {"Latitude": choices.latitude, "Longitude": choices.longitude, "PA": choices.area}
    for target, choice in picked.items():
        if looked_up.get(target):
            exprs.append(
                Lookup(extra.table, extra.main_key, extra.lookup_key, looked_up[target], target)
            )
        elif choice.column:
            exprs.append(Column(choice.column, target))
        elif choice.constant != "":
            exprs.append(Literal(choice.constant, target))
    if choices.status:
        exprs.append(Column(choices.status, STATUS))
    return exprs
