"""Left equi-joins that treat null keys like any other group key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table of groups that every task may hold whole.
FEW_GROUPS = 5_000


def few_whole(groups: DataFrame) -> DataFrame:
    """A table with one row per group, to be broadcast if it has at most ``FEW_GROUPS`` rows, else as it is.

    For joins of many rows with few groups: adaptive execution leaves such a join to the few tasks that the groups' keys
    make, as most partitions of the smaller side are empty. The rows are counted before, up to that bound.
    """
    return F.broadcast(groups) if groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else groups


def left_join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join ``right`` (one row per group) onto ``left``; null keys match null keys.

    Nothing is hinted. The right side is an aggregate of unknown size, so the
    strategy is left to the runtime: adaptive execution broadcasts it once its
    measured size is below the session's threshold, and otherwise sort-merges
    with skewed partitions of the left side split.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(f"`{c}`") for c in right.columns if c not in keys],
    )
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def attach_dataset_value(
    df: DataFrame, values: DataFrame, column: str, by: Sequence[str]
) -> DataFrame:
    """Add a per-dataset value; without a dataset key it is one value, a scalar subquery."""
    if by:
        return left_join_groups(df, values.select(*by, column), by)
    return df.withColumn(column, values.select(column).scalar())
