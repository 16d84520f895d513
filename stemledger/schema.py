"""Canonical census schema: column names, Spark types, status codes and enums."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemledger.functions.values import (
    MISSING_DBH_TEXTS,
    col,
    normalised_dbh,
    parsed_double,
    parsed_integer,
    safe_cast,
)

DSN = "dsn"
PLOT = "PlotID"
TREE = "TreeID"
YEAR = "YR"
PREV_YEAR = "PrevYR"
STATUS = "Status"
DBH = "DBH"
SPECIES = "Species"

#: The canonical output columns. ``Status`` stays text until the export step.
CENSUS_SCHEMA = T.StructType(
    [
        T.StructField(PLOT, T.StringType(), False),
        T.StructField(TREE, T.StringType(), False),
        T.StructField(YEAR, T.IntegerType(), False),
        T.StructField(PREV_YEAR, T.IntegerType(), True),
        T.StructField(STATUS, T.StringType(), False),
        T.StructField(DBH, T.DoubleType(), True),
        T.StructField(SPECIES, T.StringType(), True),
        T.StructField(DSN, T.StringType(), False),
    ]
)

#: Optional plot attributes that travel with the canonical columns.
PLOT_ATTRIBUTES = T.StructType(
    [
        T.StructField("PA", T.DoubleType(), True),
        T.StructField("Latitude", T.DoubleType(), True),
        T.StructField("Longitude", T.DoubleType(), True),
    ]
)

# The status vocabulary of the output format.
ALIVE = "0"
DEAD = "1"
RECRUIT = "2"
MISSING = "9"
KNOWN_STATUSES = (ALIVE, DEAD, RECRUIT, MISSING)

#: Keys of a tree and of one tree measurement, per dataset.
BY = (DSN,)
TREE_KEYS = (PLOT, TREE)
ROW_KEYS = (PLOT, TREE, YEAR)


class CensusType(str, Enum):
    MULTI = "multi"
    SINGLE = "single"

    @classmethod
    def parse(cls, text: str | None) -> "CensusType":
        """``single`` or ``s`` is a single census; everything else is a multi-census."""
        if isinstance(text, cls):
            return text
        return cls.SINGLE if text in ("single", "s") else cls.MULTI


def is_multi(census_type: CensusType | str | Column) -> Column:
    """Whether a row is of a multi-census; a column holds the type of each row's dataset as text."""
    if isinstance(census_type, Column):
        return ~F.coalesce(census_type.isin("single", "s"), F.lit(False))
    return F.lit(CensusType.parse(census_type) is CensusType.MULTI)


def any_multi(census_type: CensusType | str | Column) -> bool:
    """Whether rows of a multi-census may occur; with a type per row they may."""
    return isinstance(census_type, Column) or CensusType.parse(census_type) is CensusType.MULTI


class DbhUnit(str, Enum):
    CM = "cm"
    MM = "mm"

    @classmethod
    def parse(cls, text: str | None) -> "DbhUnit":
        if text is None:
            return cls.CM
        try:
            return cls(text)
        except ValueError:
            raise ValueError(f"unknown DBH unit {text!r}: use 'cm' or 'mm'") from None


#: Column with the texts of a row's unreadable values, by field.
UNREAD = "_unread"
_WANTED = {f.name: f.dataType for f in (*CENSUS_SCHEMA, *PLOT_ATTRIBUTES)}


def conform(df: DataFrame) -> DataFrame:
    """Cast every canonical column that is present to its canonical type.

    Casts never raise: text that is not a number becomes null, as do the usual
    missing-value texts in ``DBH``. Columns that are not canonical pass through.
    What was lost is told by ``unread_rows``.
    """
    return df.select(*[_conformed(field) for field in df.schema])


def _conformed(field: T.StructField) -> Column:
    name, value = field.name, col(field.name)
    wanted = _WANTED.get(name, field.dataType)
    if name == DBH:
        return normalised_dbh(value, field.dataType).alias(DBH)
    if field.dataType == wanted:
        return value
    if isinstance(field.dataType, T.StringType):
        number = parsed_integer(value, wanted) if isinstance(wanted, T.IntegerType) else parsed_double(value)
        return number.alias(name)
    return safe_cast(value, wanted).alias(name)


def _lost(field: T.StructField) -> Column | None:
    """Whether a text holds something that ``conform`` cannot read; None for fields that are not read from text.

    A year is a key, so any text but a year is unreadable. Other fields may say in the usual words that they hold nothing.
    """
    if not isinstance(field.dataType, T.StringType) or isinstance(_WANTED.get(field.name, field.dataType), T.StringType):
        return None
    value = col(field.name)
    lost = value.isNotNull() & _conformed(field).isNull()
    return lost if field.name == YEAR else lost & ~F.lower(F.trim(value)).isin(*MISSING_DBH_TEXTS)


def readable_rows(df: DataFrame) -> DataFrame:
    """Mapped rows, not yet conformed, whose year can be read or is null.

    The others have no place in a census: as rows without a year they would all be copies of one another.
    """
    lost = {f.name: _lost(f) for f in df.schema}.get(YEAR)
    return df if lost is None else df.where(~lost)


def unread_rows(df: DataFrame) -> DataFrame:
    """Mapped rows, not yet conformed, with at least one unreadable value: conformed, their texts kept in ``_unread``."""
    lost = {f.name: _lost(f) for f in df.schema}
    lost = {name: condition for name, condition in lost.items() if condition is not None}
    texts = F.create_map().cast("map<string, string>")
    if lost:
        entries = [x for name, condition in lost.items() for x in (F.lit(name), F.when(condition, col(name)))]
        texts = F.map_filter(F.create_map(*entries), lambda _, text: text.isNotNull())
        df = df.where(_any(list(lost.values())))
    else:
        df = df.where(F.lit(False))
    return df.select(*[_conformed(f) for f in df.schema if f.name != UNREAD], texts.alias(UNREAD))


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found |= condition
    return found


def is_quarantined() -> Column:
    """Of rows with unreadable values: those whose year is among them."""
    return F.map_contains_key(UNREAD, F.lit(YEAR))
