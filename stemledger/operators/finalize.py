"""Export clean-up: the row changes every delivered dataset goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemledger.schema import (
    ALIVE,
    DBH,
    DEAD,
    KNOWN_STATUSES,
    MISSING,
    PREV_YEAR,
    RECRUIT,
    STATUS,
    CensusType,
    any_multi,
    is_multi,
)


def recode_unknown(df: DataFrame) -> DataFrame:
    """Status outside the vocabulary, null included, becomes missing."""
    status = F.col(STATUS)
    return df.withColumn(STATUS, F.when(status.isin(*KNOWN_STATUSES), status).otherwise(MISSING))


def nullify_dead_dbh(df: DataFrame) -> DataFrame:
    return df.withColumn(DBH, F.when(F.col(STATUS) == DEAD, None).otherwise(F.col(DBH)))


def drop_invalid(df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI) -> DataFrame:
    """Drop recruits without a diameter and, in a multi-census, dead trees without a past."""
    keep = ~((F.col(STATUS) == RECRUIT) & F.col(DBH).isNull())
    if any_multi(census_type):
        keep &= ~(is_multi(census_type) & F.col(PREV_YEAR).isNull() & (F.col(STATUS) == DEAD))
    return df.where(keep)


def drop_anchors(df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI) -> DataFrame:
    """Drop alive rows without a previous census: they only anchor the next one.

    A single census has no next one and keeps its rows.
    """
    if not any_multi(census_type):
        return df
    return df.where(~(is_multi(census_type) & F.col(PREV_YEAR).isNull() & (F.col(STATUS) == ALIVE)))


def status_to_int(df: DataFrame) -> DataFrame:
    return df.withColumn(STATUS, F.col(STATUS).try_cast("int"))


def finalize(df: DataFrame, census_type: CensusType | str | Column = CensusType.MULTI) -> DataFrame:
    """The whole clean-up as one projection and one filter, without the final sort.

    Recoding comes first: it leaves no null status, so the filters cannot lose a
    row to a null comparison. A column as ``census_type`` gives each row's own.
    """
    rows = drop_invalid(nullify_dead_dbh(recode_unknown(df)), census_type)
    return status_to_int(drop_anchors(rows, census_type))
