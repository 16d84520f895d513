"""Mapping submissions as their files arrive.

Mapping a row needs nothing but the row (and lookup tables), so it streams as it
is. Deduplication, linking and status look at a tree's whole history and are run
as a batch over the rows collected so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stemledger.plans.harmonize import map_submission, unread_submission
from stemledger.plans.submission import Submission
from stemledger.schema import DSN


def collect_arrivals(
    stream: DataFrame, submission: Submission, table: str, checkpoint: str
) -> StreamingQuery:
    """Append mapped rows of all files that have arrived to a Parquet table by dataset.

    The checkpoint makes each file count once, across restarts. The query stops
    when it has caught up; ``harmonize`` can then prepare the table. Rows whose year
    cannot be read are not among these; ``collect_unread`` collects them.
    """
    return _append(map_submission(stream, submission), table, checkpoint)


def collect_unread(stream: DataFrame, submission: Submission, table: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of arrived files that hold unreadable values, with their texts, to a table of their own.

    It needs a checkpoint of its own too; the two queries see the same files and can run in any order.
    """
    return _append(unread_submission(stream, submission), table, checkpoint)


def _append(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .partitionBy(DSN)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
