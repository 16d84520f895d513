"""Wide to long, and stacking several datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemledger.functions.values import col, normalised_dbh
from stemledger.schema import CENSUS_SCHEMA, DBH, PLOT_ATTRIBUTES, YEAR


def melt_wide(
    df: DataFrame, id_columns: Sequence[str], pairs: Sequence[tuple[str, int]]
) -> DataFrame:
    """One row per (input row, census column): the id columns, ``DBH`` and ``YR``.

    Years without a diameter are kept, because later steps read them as dead or
    missing. The table is scanned once; there is no shuffle.
    """
    if not pairs:
        raise ValueError("no census columns given")
    cells = F.array(
        *[
            F.struct(
                normalised_dbh(col(name), df.schema[name].dataType).alias(DBH),
                F.lit(int(year)).alias(YEAR),
            )
            for name, year in pairs
        ]
    )
    return df.select(*[col(c) for c in id_columns], F.inline(cells))


def bind_datasets(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack mapped datasets; columns that are not canonical travel as text.

    Columns missing from a dataset are null there.
    """
    known = {f.name for f in (*CENSUS_SCHEMA, *PLOT_ATTRIBUTES)}

    def extras_as_text(df: DataFrame) -> DataFrame:
        return df.select(
            *[col(c) if c in known else col(c).cast("string").alias(c) for c in df.columns]
        )

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), map(extras_as_text, frames)
    )
