"""Order-free comparison of a Spark result with DuckDB's on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return as_rows(df.columns, df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return as_rows(columns, cursor.fetchall())


FAMILY = {
    "BIGINT": "bigint", "HUGEINT": "hugeint", "INTEGER": "int", "VARCHAR": "string",
    "DOUBLE": "double", "BOOLEAN": "boolean",
}


def types_differ(df, con, sql):
    """Columns whose type differs between the two engines."""
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    wanted = {row[0]: FAMILY.get(row[1], row[1]) for row in described}
    given = {f.name: f.dataType.simpleString() for f in df.schema}
    return {c: (given.get(c), t) for c, t in wanted.items() if given.get(c) != t}
