"""A contributor's saved mapping, keyed by dataset id and reused for repeat submissions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.operators import mapping as m
from stemledger.operators.many import mappings_from_json
from stemledger.schema import DSN, CensusType, DbhUnit

_KINDS = {
    "column": m.Column,
    "literal": m.Literal,
    "concat": m.Concat,
    "year": m.YearOf,
    "lookup": m.Lookup,
}
MAPPING_SCHEMA = "dsn string, mapping string"


@dataclass(frozen=True)
class Metadata:
    """What a contributor declares about a dataset."""

    country: str | None = None
    site: str | None = None
    pi: str | None = None
    contributor: str | None = None
    dbh_unit: str = DbhUnit.CM.value
    crs: str | None = None
    census_years: Sequence[int] = ()
    census_type: str = CensusType.MULTI.value


@dataclass(frozen=True)
class Submission:
    """How one dataset maps onto the canonical schema."""

    dsn: str
    exprs: Sequence[m.FieldExpr]
    codes: Sequence[m.StatusCode] = ()
    wide_pairs: Sequence[tuple[str, int]] = ()
    metadata: Metadata = field(default_factory=Metadata)

    def to_json(self) -> str:
        exprs = []
        for expr in self.exprs:
            kind = next(k for k, cls in _KINDS.items() if isinstance(expr, cls))
            if isinstance(expr, m.Lookup) and not isinstance(expr.table, str):
                raise ValueError("a saved lookup must name a file, not hold a DataFrame")
            exprs.append({"kind": kind, **asdict(expr)})
        return json.dumps(
            {
                "dsn": self.dsn,
                "exprs": exprs,
                "codes": [asdict(c) for c in self.codes],
                "wide_pairs": [list(p) for p in self.wide_pairs],
                "metadata": asdict(self.metadata),
            }
        )

    @classmethod
    def from_json(cls, text: str) -> "Submission":
        raw = json.loads(text)
        exprs = [
            _KINDS[e["kind"]](**{k: v for k, v in e.items() if k != "kind"}) for e in raw["exprs"]
        ]
        return cls(
            raw["dsn"],
            exprs,
            [m.StatusCode(**c) for c in raw["codes"]],
            [(name, int(year)) for name, year in raw["wide_pairs"]],
            Metadata(**raw["metadata"]),
        )


def save_submission(spark: SparkSession, submission: Submission, path: str) -> None:
    """Store a mapping; an earlier one of the same dataset is replaced, others stay."""
    row = spark.createDataFrame([(submission.dsn, submission.to_json())], MAPPING_SCHEMA)
    (
        row.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DSN)
        .parquet(path)
    )


def load_submission(spark: SparkSession, dsn: str, path: str) -> Submission | None:
    """The stored mapping of a dataset; only its partition is read."""
    stored = spark.read.schema(MAPPING_SCHEMA).parquet(path).where(F.col(DSN) == dsn).first()
    return None if stored is None else Submission.from_json(stored.mapping)


def mapping_table(spark: SparkSession, submissions: Sequence[Submission]) -> DataFrame:
    """Mappings as rows for ``harmonize_many``."""
    rows = [(s.dsn, s.to_json()) for s in submissions]
    return mappings_from_json(spark.createDataFrame(rows, MAPPING_SCHEMA))


def load_mappings(spark: SparkSession, path: str) -> DataFrame:
    """All stored mappings as rows for ``harmonize_many``; none reaches the driver."""
    return mappings_from_json(spark.read.schema(MAPPING_SCHEMA).parquet(path))


def metadata_table(spark: SparkSession, submissions: Sequence[Submission]) -> DataFrame:
    """The dataset dimension: one row of declared metadata per submission."""
    rows = [
        (
            s.dsn,
            s.metadata.country,
            s.metadata.site,
            s.metadata.pi,
            s.metadata.contributor,
            s.metadata.dbh_unit,
            s.metadata.crs,
            [int(y) for y in s.metadata.census_years],
            s.metadata.census_type,
        )
        for s in submissions
    ]
    return spark.createDataFrame(
        rows,
        "dsn string, country string, site string, pi string, contributor string, "
        "dbh_unit string, crs string, census_years array<int>, census_type string",
    )


def write_metadata(datasets: DataFrame, path: str) -> None:
    """The metadata sidecar: one JSON object per dataset."""
    datasets.write.mode("overwrite").json(path)
