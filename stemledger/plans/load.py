"""Loading a table: rows staged, counted, judged and previewed in one pass over the source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from stemledger.functions.values import col
from stemledger.operators import gate, headers
from stemledger.plans.staging import staged
from stemledger.schema import DSN
from stemledger.sources.readers import preview, raw_header, read_table


class StructureError(ValueError):
    """A table that does not pass the structural gate."""


@dataclass(frozen=True)
class Loaded:
    """A staged table with all that is known about its structure."""

    table: DataFrame
    #: Raw header line, blanks and repeats included.
    header: Sequence[str]
    n_rows: int
    #: Rows with a value, by column of ``table``.
    filled: dict[str, int]
    errors: Sequence[gate.GateError]
    #: The field each column of ``table`` seems to hold, or None.
    suggestions: dict[str, str | None]
    #: The first rows as text.
    preview: Sequence[Row]

    @property
    def is_ok(self) -> bool:
        return not self.errors

    def admitted(self) -> DataFrame:
        """The rows, if the table passes the gate."""
        if self.errors:
            raise StructureError(" ".join(e.message for e in self.errors))
        return self.table

    def report(self) -> DataFrame:
        """``(ordinal, header, field, n_rows, n_null, problem)``, a row per column."""
        problems = {e.header: e.problem for e in self.errors}
        rows = [
            (i, name, self.suggestions[name], self.n_rows, self.n_rows - self.filled[name], problems.get(name))
            for i, name in enumerate(self.table.columns)
        ]
        schema = "ordinal int, header string, field string, n_rows long, n_null long, problem string"
        return self.table.sparkSession.createDataFrame(rows, schema)


def load(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    multiline: bool = False,
    comment: str | None = None,
    n_preview: int = 10,
) -> Loaded:
    """Read a file or folder, judge its structure, suggest fields and keep its first rows."""
    return load_frame(read_table(spark, path, fmt, multiline, comment), raw_header(spark, path, fmt), n_preview)


def load_frame(raw: DataFrame, header: Sequence[str] | None = None, n_preview: int = 10) -> Loaded:
    """The same for a table that is read already.

    Rows and values are counted while the rows are staged, by metrics observed on that one pass; what follows reads the
    staged rows.
    """
    names = raw.columns
    header = names if header is None else header
    if not names:
        return Loaded(raw, header, 0, {}, [gate.GateError("empty")], {}, [])
    seen = Observation()
    counts = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]
    table = staged(raw.observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts), "loaded")
    n_rows, filled = seen.get["n_rows"], {c: seen.get[f"n{i}"] for i, c in enumerate(names)}
    return Loaded(
        table, header, n_rows, filled, gate.judged(header, n_rows, filled), _suggested(table), preview(table, n_preview).collect()
    )


def _suggested(table: DataFrame) -> dict[str, str | None]:
    rows = [("", i, name) for i, name in enumerate(table.columns)]
    catalogue = table.sparkSession.createDataFrame(rows, f"{DSN} string, ordinal int, header string")
    return {r.header: r.field for r in headers.suggest_fields(catalogue).orderBy("ordinal").collect()}


def admitted(raw: DataFrame | Loaded) -> DataFrame:
    """The rows of a table; a loaded one has to pass its gate."""
    return raw.admitted() if isinstance(raw, Loaded) else raw
