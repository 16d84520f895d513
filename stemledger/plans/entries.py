"""Registered queries: every operator run over whole tables, with its SQL counterpart.

A census is read off ``lineitem``: supplier groups are plots, parts are trees,
ship years are census years, quantities are diameters and the two flag columns
are the contributor's status code. It has copies, gaps, unmeasured rows, plots
that start in different years, several datasets and an unmapped code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.functions.countries import COUNTRY_CODES, with_iso3
from stemledger.functions.values import dataset_id
from stemledger.operators import (
    census,
    finalize,
    gate,
    headers,
    many,
    mapping,
    reshape,
    status,
    validate,
)
from stemledger.plans.harmonize import harmonize, harmonize_many
from stemledger.plans.load import load_frame
from stemledger.plans.staging import new_path
from stemledger.plans.submission import Metadata, Submission, mapping_table
from stemledger.schema import DBH, PLOT, PREV_YEAR, STATUS, TREE, UNREAD, YEAR, conform, readable_rows, unread_rows
from stemledger.sinks import curation_log, writers
from stemledger.sinks.provenance import Provenance
from stemledger.sources.readers import header_catalogue, preview, read_table, row_count

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *ctes: str, name: str | None = None):
    """Register a query under its function's name, with SQL that gives the same rows."""

    def register(run: Query) -> Query:
        key = name or run.__name__
        QUERIES[key] = run
        ORACLES[key] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return run

    return register


# --- shared inputs -------------------------------------------------------------------

TIE = ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
CODES = [
    mapping.StatusCode("AF", "0"),
    mapping.StatusCode("AO", "0"),
    mapping.StatusCode("RF", "1"),
    mapping.StatusCode("RO", "2", "coppice regrowth"),
    mapping.StatusCode("NF", "2"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census view: canonical keys, the raw status code, and a total tie-break."""
    return (
        table(spark, sf_dir, "lineitem")
        .selectExpr(
            "concat('D', l_linenumber % 4) AS dsn",
            "concat('P', l_suppkey % 10) AS PlotID",
            "concat('T', l_partkey) AS TreeID",
            "CAST(greatest(year(l_shipdate), 1995 + (l_suppkey % 10) % 3) AS INT) AS YR",
            "CASE WHEN l_linenumber < 7 OR l_returnflag <> 'A' "
            "THEN concat(l_returnflag, l_linestatus) END AS code",
            "CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS DBH",
            *TIE,
        )
    )


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census view with the contributor's codes mapped; ``NO`` stays as it is."""
    df = rows(spark, sf_dir).withColumnRenamed("code", STATUS)
    return mapping.remap_status(df, CODES)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.prepare(rows(spark, sf_dir).drop("code"), tie_break=TIE)


def prepared_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.prepare(coded(spark, sf_dir), tie_break=TIE)


def single_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.prepare(coded(spark, sf_dir), "single", tie_break=TIE)


ROWS = """census AS (
  SELECT 'D' || CAST(l_linenumber % 4 AS VARCHAR) AS dsn,
         'P' || CAST(l_suppkey % 10 AS VARCHAR) AS "PlotID",
         'T' || CAST(l_partkey AS VARCHAR) AS "TreeID",
         CAST(greatest(year(l_shipdate), 1995 + (l_suppkey % 10) % 3) AS INT) AS "YR",
         CASE WHEN l_linenumber < 7 OR l_returnflag <> 'A' THEN l_returnflag || l_linestatus END AS code,
         CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS "DBH",
         l_orderkey, l_linenumber, l_shipdate, l_extendedprice
  FROM lineitem)"""
CODED = """coded AS (
  SELECT *, CASE code WHEN 'AF' THEN '0' WHEN 'AO' THEN '0' WHEN 'RF' THEN '1'
                      WHEN 'RO' THEN '2' WHEN 'NF' THEN '2' ELSE code END AS "Status" FROM census)"""


def _prepared_sql(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT *, lag("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID" ORDER BY "YR") AS "PrevYR" FROM (
    SELECT *, row_number() OVER (PARTITION BY dsn, "PlotID", "TreeID", "YR"
      ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS rn FROM {source}) WHERE rn = 1)"""


PREPARED = _prepared_sql("prepared", "census")
PREPARED_CODED = _prepared_sql("pc", "coded")
DERIVED = """structure AS (
  SELECT *,
    min(CASE WHEN "DBH" IS NOT NULL THEN "YR" END) OVER (PARTITION BY dsn, "PlotID", "TreeID") AS vf,
    max(CASE WHEN "DBH" IS NOT NULL THEN "YR" END) OVER (PARTITION BY dsn, "PlotID", "TreeID") AS vl,
    max("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID") AS tl,
    min("YR") OVER (PARTITION BY dsn, "PlotID") AS pf,
    max("YR") OVER (PARTITION BY dsn) AS dl
  FROM prepared), derived AS (
  SELECT *, CASE WHEN "YR" = vf AND vf > pf THEN '2'
                 WHEN "DBH" IS NULL AND "YR" > vl THEN '1'
                 WHEN "DBH" IS NULL THEN '9' ELSE '0' END AS "Status" FROM structure)"""
CENSUS = [ROWS]
CODED_ROWS = [ROWS, CODED]
PREPARED_ROWS = [ROWS, PREPARED]
CODED_PREPARED = [ROWS, CODED, PREPARED_CODED]
DERIVED_ROWS = [ROWS, PREPARED, DERIVED]

KEY = ["dsn", PLOT, TREE, YEAR]
KEY_SQL = 'dsn, "PlotID", "TreeID", "YR"'


# --- scans and the structural gate ---------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_parquet(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
    "CAST(l_quantity AS VARCHAR) AS l_quantity, l_returnflag, CAST(l_shipdate AS VARCHAR) AS l_shipdate "
    "FROM (SELECT * FROM lineitem ORDER BY lineitem.l_orderkey, lineitem.l_linenumber, "
    "lineitem.l_shipdate, lineitem.l_extendedprice LIMIT 10)"
)
def preview_head(spark, sf_dir):
    ordered = table(spark, sf_dir, "lineitem").orderBy(*TIE)
    return preview(
        ordered.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"), 10
    )


@query("SELECT count(*) AS row_count FROM lineitem", name="row_count")
def count_rows(spark, sf_dir):
    return row_count(table(spark, sf_dir, "lineitem"))


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """``lineitem`` as text files of two layouts: other columns in another order, and one spelled otherwise."""
    path = new_path(spark, "layouts")
    df = table(spark, sf_dir, "lineitem")
    halves = {
        "even": ["l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"],
        "odd": ["l_suppkey", "l_returnflag", "l_linenumber AS L_LineNumber", "l_orderkey"],
    }
    for rest, (half, columns) in enumerate(halves.items()):
        part = df.where(F.col("l_linenumber") % 2 == rest).selectExpr(*columns)
        part.write.option("header", True).csv(f"{path}/half={half}")
    return path


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
              CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS l_shipdate, l_returnflag,
              CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey AS VARCHAR) END AS l_suppkey,
              CASE WHEN l_linenumber % 2 = 1 THEN 'odd' ELSE 'even' END AS half FROM lineitem"""
)
def scan_folder(spark, sf_dir):
    df = read_table(spark, _folder(spark, sf_dir), "csv")
    return df.withColumn("l_shipdate", F.substring("l_shipdate", 1, 10))


@query(
    """SELECT DISTINCT half, CAST(ordinal AS INT) AS ordinal, header FROM (
         SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS half,
                unnest([0, 1, 2, 3]) AS ordinal,
                unnest(CASE WHEN l_linenumber % 2 = 0 THEN ['l_orderkey', 'l_linenumber', 'l_shipdate', 'l_returnflag']
                            ELSE ['l_suppkey', 'l_returnflag', 'L_LineNumber', 'l_orderkey'] END) AS header
         FROM lineitem)"""
)
def catalogue_folder(spark, sf_dir):
    found = header_catalogue(spark, _folder(spark, sf_dir))
    half = F.regexp_extract("dsn", "half=([a-z]+)/", 1).alias("half")
    return found.select(half, "ordinal", "header").distinct()


@query("SELECT count(*) AS n_rows, count(*) = 0 AS is_empty FROM events")
def gate_empty(spark, sf_dir):
    counted = row_count(table(spark, sf_dir, "events"))
    n_rows = F.col("row_count")
    return counted.select(n_rows.alias("n_rows"), (n_rows == 0).alias("is_empty"))


def word_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header catalogue from whole texts: one dataset per document, its words as headers."""
    words = F.posexplode(F.split("text", " ")).alias("ordinal", "header")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("dsn"), words
    )


WORDS = """words AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) AS dsn,
         CAST(generate_subscripts(string_split(text, ' '), 1) - 1 AS INT) AS ordinal,
         unnest(string_split(text, ' ')) AS header
  FROM documents)"""


@query(
    """SELECT dsn, problem, header, CASE WHEN problem = 'blank_header' THEN n ELSE n - 1 END AS n FROM (
         SELECT dsn, header, count(*) AS n,
           CASE WHEN header = '' OR starts_with(header, 'column_') THEN 'blank_header'
                WHEN count(*) > 1 THEN 'duplicate_header' END AS problem
         FROM words GROUP BY dsn, header) WHERE problem IS NOT NULL""",
    WORDS,
)
def gate_headers(spark, sf_dir):
    words = F.split("text", " ").alias("headers")
    dsn = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("dsn")
    return headers.header_list_findings(table(spark, sf_dir, "documents").select(dsn, words))


def _part_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold no value for some, but not all, of the datasets."""
    return rows(spark, sf_dir).selectExpr(
        "dsn",
        "CASE WHEN dsn <> 'D1' THEN TreeID END AS tag",
        "CASE WHEN dsn NOT IN ('D1', 'D2') THEN code END AS fate",
        "DBH",
    )


PART_EMPTY = """part_empty AS (
  SELECT dsn, CASE WHEN dsn <> 'D1' THEN "TreeID" END AS tag,
         CASE WHEN dsn NOT IN ('D1', 'D2') THEN code END AS fate, "DBH" FROM census)"""
PROFILE = """profile AS (
  SELECT dsn, 'tag' AS "column", 0 AS ordinal, count(*) AS n_rows, count(*) - count(tag) AS n_null FROM part_empty GROUP BY dsn
  UNION ALL SELECT dsn, 'fate', 1, count(*), count(*) - count(fate) FROM part_empty GROUP BY dsn
  UNION ALL SELECT dsn, 'DBH', 2, count(*), count(*) - count("DBH") FROM part_empty GROUP BY dsn)"""


@query("SELECT * FROM profile", ROWS, PART_EMPTY, PROFILE)
def gate_null_profile(spark, sf_dir):
    return gate.null_profile(_part_empty(spark, sf_dir), ["dsn"])


@query(
    """SELECT dsn, CASE WHEN count(*) = 1 THEN 'all_null_column' ELSE 'all_null_columns' END AS problem,
              CASE WHEN count(*) = 1 THEN max("column") END AS header, count(*) AS n
       FROM profile WHERE n_null = n_rows GROUP BY dsn""",
    ROWS, PART_EMPTY, PROFILE,
)
def gate_all_null(spark, sf_dir):
    return gate.all_null_findings(_part_empty(spark, sf_dir), ["dsn"])


_LOADED = {
    "dsn": None, "PlotID": "PlotID", "TreeID": "TreeID", "YR": "YR", "code": None, "DBH": "DBH", "spare": "Species",
}


def _load_sql(ordinal: int, header: str, field: str | None) -> str:
    named = "NULL" if field is None else f"'{field}'"
    return (
        f"SELECT CAST({ordinal} AS INT) AS ordinal, '{header}' AS header, {named} AS field, count(*) AS n_rows, "
        f'count(*) - count("{header}") AS n_null, '
        f"""CASE WHEN count("{header}") = 0 THEN 'all_null_column' END AS problem FROM loaded"""
    )


@query(
    " UNION ALL ".join(_load_sql(i, name, field) for i, (name, field) in enumerate(_LOADED.items())),
    ROWS,
    "loaded AS (SELECT *, NULL AS spare FROM census)",
)
def load_report(spark, sf_dir):
    """Gate, field suggestions and counts of a table, taken while its rows are staged."""
    raw = rows(spark, sf_dir).withColumn("spare", F.lit(None).cast("string")).select(*_LOADED)
    return load_frame(raw).report()


# --- mapping -------------------------------------------------------------------------


@query(
    "SELECT CAST(l_suppkey AS VARCHAR) AS \"PlotID\", CAST(l_partkey AS VARCHAR) AS \"TreeID\", "
    "l_quantity AS \"DBH\", l_orderkey, l_linenumber, 'in_per_ruiz_2020_m' AS dsn FROM lineitem"
)
def map_rename(spark, sf_dir):
    pairs = [("l_suppkey", PLOT), ("l_partkey", TREE), ("l_quantity", DBH), ("not_there", "Species")]
    mapped = mapping.rename_columns(table(spark, sf_dir, "lineitem"), pairs, "in_per_ruiz_2020_m")
    return conform(mapped).select(PLOT, TREE, DBH, "l_orderkey", "l_linenumber", "dsn")


@query(
    """SELECT lower('site_' || CAST(l_suppkey AS VARCHAR) || '_' || l_linestatus) AS "PlotID",
              CAST(l_partkey AS VARCHAR) AS "TreeID", l_quantity AS "DBH",
              CAST(year(l_shipdate) AS INT) AS "YR", l_returnflag AS "Status",
              CAST(0.25 AS DOUBLE) AS "PA", l_tax AS "Latitude", s_acctbal AS "Longitude",
              l_orderkey, l_linenumber, 'in_bra_silva_2021_m' AS dsn
       FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey"""
)
def map_fields(spark, sf_dir):
    choices = mapping.FieldChoices(
        plot=["l_suppkey", "l_linestatus"],
        plot_prefix=" SITE ",
        tree=["l_partkey"],
        dbh="l_quantity",
        status="l_returnflag",
        latitude=mapping.Choice(column="l_tax"),
        longitude=mapping.Choice(column="l_discount"),
        area=mapping.Choice(constant="0.25"),
        plot_table=mapping.PlotTable(
            table(spark, sf_dir, "supplier"), "l_suppkey", "s_suppkey", longitude="s_acctbal"
        ),
    )
    exprs = [*mapping.compile_choices(choices), mapping.YearOf("l_shipdate")]
    mapped = mapping.map_fields(table(spark, sf_dir, "lineitem"), exprs, "in_bra_silva_2021_m")
    return conform(mapped).select(
        PLOT, TREE, DBH, YEAR, STATUS, "PA", "Latitude", "Longitude",
        "l_orderkey", "l_linenumber", "dsn",
    )


@query(
    "SELECT l_orderkey, l_linenumber, CAST(1.5 AS DOUBLE) AS \"PA\", 'Unknown' AS \"Species\", "
    "'in_x_y_2020_s' AS dsn FROM lineitem"
)
def map_literal(spark, sf_dir):
    exprs = [mapping.Literal("1.5", "PA"), mapping.Literal("Unknown", "Species")]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return mapping.map_fields(df, exprs, "in_x_y_2020_s")


@query(
    """SELECT l_orderkey, l_linenumber,
              lower(concat_ws('-', 'PLOT', CAST(l_suppkey AS VARCHAR), flag)) AS "PlotID",
              concat_ws('_', flag, CAST(l_partkey AS VARCHAR)) AS "TreeID"
       FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag FROM lineitem)"""
)
def map_concat(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "*", "CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS flag"
    )
    exprs = [
        mapping.Concat(["l_suppkey", "flag"], PLOT, sep="-", prefix="PLOT"),
        mapping.Concat(["flag", "l_partkey"], TREE, lower=False),
    ]
    return mapping.map_fields(df, exprs, "d").select("l_orderkey", "l_linenumber", PLOT, TREE)


@query(
    """SELECT l_orderkey, l_linenumber, CAST(year(l_shipdate) AS INT) AS "YR",
              CASE WHEN l_linenumber < 7 THEN CAST(year(l_shipdate) AS INT) END AS "PrevYR" FROM lineitem"""
)
def map_year(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CASE WHEN l_linenumber < 7 THEN concat('census of ', year(l_shipdate), '/12') "
        "ELSE 'none 12-3' END AS label",
    )
    exprs = [mapping.YearOf("l_shipdate", YEAR), mapping.YearOf("label", PREV_YEAR)]
    return mapping.map_fields(df, exprs, "d").select("l_orderkey", "l_linenumber", YEAR, PREV_YEAR)


@query(f'SELECT {KEY_SQL}, l_orderkey, l_linenumber, "DBH" / 10.0::DOUBLE AS "DBH" FROM census', *CENSUS)
def scale_mm(spark, sf_dir):
    scaled = mapping.scale_dbh(rows(spark, sf_dir), "mm")
    return scaled.select(*KEY, "l_orderkey", "l_linenumber", DBH)


@query(
    f"""SELECT {KEY_SQL}, l_orderkey, l_linenumber,
               CASE code WHEN 'AF' THEN '2' WHEN 'RF' THEN '1' ELSE code END AS "Status" FROM census""",
    *CENSUS,
)
def status_remap(spark, sf_dir):
    codes = [
        mapping.StatusCode("AF", "0"), mapping.StatusCode("RF", "1"), mapping.StatusCode("AF", "2"),
    ]
    df = rows(spark, sf_dir).withColumnRenamed("code", STATUS)
    return mapping.remap_status(df, codes).select(*KEY, "l_orderkey", "l_linenumber", STATUS)


@query(
    f"""SELECT {KEY_SQL}, l_orderkey, l_linenumber,
               CASE code WHEN 'AF' THEN '0' WHEN 'RF' THEN '1' ELSE '9' END AS "Status" FROM census""",
    *CENSUS,
)
def status_remap_default(spark, sf_dir):
    codes = [
        mapping.StatusCode("AF", "0"), mapping.StatusCode("RF", "1"), mapping.StatusCode("AF", "2"),
    ]
    df = rows(spark, sf_dir).withColumnRenamed("code", STATUS)
    df = mapping.remap_status_or_missing(df, codes)
    return df.select(*KEY, "l_orderkey", "l_linenumber", STATUS)


@query(
    f"""SELECT {KEY_SQL}, l_orderkey, l_linenumber, coalesce(target, '9') AS "Status" FROM census
        LEFT JOIN (SELECT DISTINCT dsn AS d, code AS source,
                          CASE WHEN code LIKE 'A%' THEN '0' WHEN code LIKE 'R%' THEN '1' ELSE '2' END AS target
                   FROM census WHERE code IS NOT NULL) m
        ON dsn = d AND code = source""",
    *CENSUS,
)
def mapping_reuse(spark, sf_dir):
    """Codes settled per dataset, reused for all its rows; rows without a code become missing."""
    df = rows(spark, sf_dir).withColumnRenamed("code", STATUS)
    settled = (
        df.where("Status IS NOT NULL")
        .selectExpr(
            "dsn", "Status AS source",
            "CASE WHEN Status LIKE 'A%' THEN '0' WHEN Status LIKE 'R%' THEN '1' ELSE '2' END AS target",
        )
        .distinct()
    )
    remapped = mapping.remap_status_by_table(df, settled, default="9")
    return remapped.select(*KEY, "l_orderkey", "l_linenumber", STATUS)


_DBH_TEXT = """CASE l_orderkey % 10 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN 'NaN'
  WHEN 4 THEN 'Null' WHEN 5 THEN 'nd' WHEN 6 THEN '.' WHEN 7 THEN 'ca. 12' ELSE CAST(l_quantity AS {text}) END"""


@query(
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice,
               CASE WHEN lower(t) NOT IN ('', 'na', 'n/a', 'nan', 'null', 'nd', '.') THEN TRY_CAST(t AS DOUBLE) END AS "DBH"
        FROM (SELECT *, {_DBH_TEXT.format(text="VARCHAR")} AS t FROM lineitem)"""
)
def dbh_normalise(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice", f"{_DBH_TEXT.format(text='STRING')} AS DBH"
    )
    return conform(df)


#: Years and diameters as a contributor may write them; a tenth of the years cannot be read.
_YEAR_TEXT = """CASE l_orderkey % 10 WHEN 0 THEN CASE l_linenumber % 3 WHEN 0 THEN 'n.d.' WHEN 1 THEN 'unknown' ELSE '19 99x' END
  WHEN 1 THEN concat(CAST({year} AS {text}), '.0') WHEN 2 THEN NULL ELSE CAST({year} AS {text}) END AS {q}YR{q}"""
_DIAMETER_TEXT = """CASE l_orderkey % 7 WHEN 0 THEN 'ca. 12' WHEN 1 THEN 'NA' WHEN 2 THEN '' ELSE CAST(l_quantity AS {text}) END AS {q}DBH{q}"""
TEXT_ROWS = """texts AS (
  SELECT *, "YR" IS NOT NULL AND TRY_CAST("YR" AS DOUBLE) IS NULL AS bad_year, "DBH" = 'ca. 12' AS bad_dbh FROM (
    SELECT 'D' || CAST(l_linenumber % 4 AS VARCHAR) AS dsn, 'P' || CAST(l_suppkey % 10 AS VARCHAR) AS "PlotID",
           'T' || CAST(l_partkey AS VARCHAR) AS "TreeID", {texts}, l_orderkey, l_linenumber, l_shipdate, l_extendedprice
    FROM lineitem)),
read AS (
  SELECT * REPLACE (CAST(TRY_CAST("YR" AS DOUBLE) AS INT) AS "YR", TRY_CAST("DBH" AS DOUBLE) AS "DBH"),
         "YR" AS year_text FROM texts)""".format(
    texts=f"{_YEAR_TEXT}, {_DIAMETER_TEXT}".format(year="CAST(year(l_shipdate) AS INT)", text="VARCHAR", q='"')
)


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census view with years and diameters as text, some of them unreadable."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('D', l_linenumber % 4) AS dsn", "concat('P', l_suppkey % 10) AS PlotID", "concat('T', l_partkey) AS TreeID",
        *[text.format(year="year(l_shipdate)", text="STRING", q="") for text in (_YEAR_TEXT, _DIAMETER_TEXT)], *TIE,
    )


@query(
    """SELECT dsn, "PlotID", "TreeID", "YR", "DBH", l_orderkey, l_linenumber,
              concat_ws(',', CASE WHEN bad_dbh THEN 'DBH=ca. 12' END, CASE WHEN bad_year THEN 'YR=' || year_text END) AS unread
       FROM read WHERE bad_year OR bad_dbh""",
    TEXT_ROWS,
)
def conform_text(spark, sf_dir):
    """Rows with values that cannot be read, their texts kept."""
    texts = F.transform(F.map_entries(UNREAD), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    found = unread_rows(text_rows(spark, sf_dir))
    return found.select(*KEY, DBH, "l_orderkey", "l_linenumber", F.array_join(F.array_sort(texts), ",").alias("unread"))


@query(
    """SELECT dsn, "PlotID", "TreeID", "YR", "DBH", "PrevYR", l_orderkey, l_linenumber FROM (
         SELECT *, lag("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID" ORDER BY "YR" NULLS FIRST) AS "PrevYR" FROM (
           SELECT *, row_number() OVER (PARTITION BY dsn, "PlotID", "TreeID", "YR"
             ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) AS rn FROM read WHERE NOT coalesce(bad_year, false))
         WHERE rn = 1)""",
    TEXT_ROWS,
)
def prepare_text(spark, sf_dir):
    """Readable rows prepared; a null year is a group of its own, an unreadable one is in none."""
    ready = census.prepare(conform(readable_rows(text_rows(spark, sf_dir))), tie_break=TIE)
    return ready.select(*KEY, DBH, PREV_YEAR, "l_orderkey", "l_linenumber")


@query(
    """SELECT dsn, CAST(8 AS INT) AS position, 'UnreadableYear' AS rule, 'RequiresInput' AS severity,
              'ReviewAndConfirm' AS action, count(*) AS row_count,
              CAST(count(*) AS VARCHAR) || ' rows have a year that cannot be read; they are set aside.' AS message
       FROM read WHERE bad_year GROUP BY dsn
       UNION ALL
       SELECT dsn, 9, 'UnreadableValue', 'AutoRecode', 'RecodeToMissing', count(*),
              CAST(count(*) AS VARCHAR) || ' rows have a number that cannot be read; it becomes missing.'
       FROM read WHERE bad_dbh AND NOT coalesce(bad_year, false) GROUP BY dsn""",
    TEXT_ROWS,
)
def unread_findings(spark, sf_dir):
    return validate.unread_findings(unread_rows(text_rows(spark, sf_dir)))


@query(
    """SELECT dsn, 'YR' AS field, year_text AS "value", count(*) AS row_count FROM read WHERE bad_year GROUP BY ALL
       UNION ALL SELECT dsn, 'DBH', 'ca. 12', count(*) FROM read WHERE bad_dbh GROUP BY ALL""",
    TEXT_ROWS,
)
def unread_values(spark, sf_dir):
    return validate.unread_values(unread_rows(text_rows(spark, sf_dir)))


_COUNTRIES = ["Brazil", "PERU", "côte d'Ivoire", "United States", "Atlantis"]
_COUNTRY = "CASE c_nationkey % 5 " + " ".join(
    "WHEN {} THEN '{}'".format(i, name.replace("'", "{q}")) for i, name in enumerate(_COUNTRIES)
) + " END"
COUNTRY_DIMENSION = "countries(country, iso3) AS (VALUES {})".format(
    ", ".join("('{}', '{}')".format(n.replace("'", "''"), c) for n, c in COUNTRY_CODES.items())
)
NAMED = "named AS (SELECT *, {} AS country FROM customer)".format(_COUNTRY.format(q="''"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("*", f"{_COUNTRY.format(q=chr(92) + chr(39))} AS country")


@query(
    """SELECT c_custkey, named.country, iso3 FROM named
       LEFT JOIN countries ON lower(named.country) = lower(countries.country)""",
    COUNTRY_DIMENSION, NAMED,
)
def country_iso(spark, sf_dir):
    coded_customers = with_iso3(_customers(spark, sf_dir), F.col("country"))
    return coded_customers.select("c_custkey", "country", "iso3")


@query(
    """SELECT c_custkey, CASE WHEN iso3 IS NULL OR c_custkey % 11 = 0 THEN ''
         ELSE 'in_' || lower(iso3) || '_van' || replace(lower(c_mktsegment), ' ', '') || CAST(c_custkey % 7 AS VARCHAR)
              || '_' || CAST(1990 + c_custkey % 30 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '_s' ELSE '_m' END
         END AS dsn
       FROM named LEFT JOIN countries ON lower(named.country) = lower(countries.country)""",
    COUNTRY_DIMENSION, NAMED,
)
def dsn_build(spark, sf_dir):
    customers = with_iso3(_customers(spark, sf_dir), F.col("country"))
    last = F.expr("concat('Van ', c_mktsegment, '-', c_custkey % 7)")
    year = F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'n.d.' ELSE concat('y ', 1990 + c_custkey % 30, '0') END")
    dsn = dataset_id(F.col("iso3"), last, year, F.expr("c_custkey % 2 = 0"))
    return customers.select("c_custkey", dsn.alias("dsn"))


@query(
    """SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS "PlotID", CAST(l_partkey AS VARCHAR) AS "TreeID",
              l_quantity AS "DBH", CAST(l_linenumber AS VARCHAR) AS tag, NULL AS remark, 'a' AS dsn FROM lineitem
       UNION ALL
       SELECT 'P' || CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_totalprice, NULL, o_orderpriority, 'b' FROM orders"""
)
def bind_datasets(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('P', l_suppkey) AS PlotID", "CAST(l_partkey AS STRING) AS TreeID",
        "l_quantity AS DBH", "l_linenumber AS tag", "'a' AS dsn",
    )
    second = table(spark, sf_dir, "orders").selectExpr(
        "concat('P', o_custkey) AS PlotID", "CAST(o_orderkey AS STRING) AS TreeID",
        "o_totalprice AS DBH", "o_orderpriority AS remark", "'b' AS dsn",
    )
    return reshape.bind_datasets([first, second])


# --- header catalogues ---------------------------------------------------------------


def _suggestion_sql() -> tuple[list[str], str]:
    """The greedy assignment in at most one step per field: each step finds the next
    header, after the last one used, that fits a field still free."""
    fields = list(headers.FIELD_ALIASES.items())
    mask = " + ".join(
        f"CASE WHEN {' OR '.join(f'contains(norm, {a!r})' for a in aliases)} THEN {1 << bit} ELSE 0 END"
        for bit, (_, aliases) in enumerate(fields)
    )
    ctes = [
        WORDS,
        f"masks AS (SELECT dsn, ordinal, {mask} AS mask FROM "
        "(SELECT *, translate(lower(header), ' -', '__') AS norm FROM words))",
        "fits AS (SELECT * FROM masks WHERE mask <> 0)",
        "step0 AS (SELECT DISTINCT dsn, -1 AS ordinal, 0 AS used, 0 AS bit FROM fits)",
    ]
    for step in range(1, len(fields) + 1):
        free = "(f.mask & (127 - s.used))"
        ctes.append(
            f"step{step} AS (SELECT dsn, ordinal, used | (free & -free) AS used, free & -free AS bit FROM ("
            f"SELECT f.dsn, min(f.ordinal) AS ordinal, arg_min({free}, f.ordinal) AS free, any_value(s.used) AS used "
            f"FROM fits f JOIN step{step - 1} s ON f.dsn = s.dsn AND f.ordinal > s.ordinal AND {free} <> 0 "
            "GROUP BY f.dsn))"
        )
    picks = " UNION ALL ".join(f"SELECT * FROM step{s}" for s in range(1, len(fields) + 1))
    names = " ".join(f"WHEN {1 << bit} THEN '{name}'" for bit, (name, _) in enumerate(fields))
    sql = (
        f"SELECT w.dsn, w.ordinal, w.header, CASE p.bit {names} END AS field FROM words w "
        f"LEFT JOIN ({picks}) p ON w.dsn = p.dsn AND w.ordinal = p.ordinal"
    )
    return ctes, sql


_SUGGEST_CTES, _SUGGEST_SQL = _suggestion_sql()


@query(_SUGGEST_SQL, *_SUGGEST_CTES)
def suggest_fields(spark, sf_dir):
    return headers.suggest_fields(word_catalogue(spark, sf_dir))


@query(
    """SELECT dsn, ordinal, header, CAST(right(header, 4) AS INT) AS year FROM (
         SELECT 'D' || CAST(l_suppkey AS VARCHAR) AS dsn, l_orderkey * 8 + l_linenumber AS ordinal,
           CASE l_linenumber % 3 WHEN 0 THEN 'DBH_' ELSE 'diam ' END || CAST(year(l_shipdate) AS VARCHAR)
             || CASE WHEN l_linenumber % 3 = 2 THEN 'b' ELSE '' END AS header FROM lineitem)
       WHERE header NOT LIKE '%b'"""
)
def detect_wide(spark, sf_dir):
    catalogue = table(spark, sf_dir, "lineitem").selectExpr(
        "concat('D', l_suppkey) AS dsn",
        "l_orderkey * 8 + l_linenumber AS ordinal",
        "concat(CASE l_linenumber % 3 WHEN 0 THEN 'DBH_' ELSE 'diam ' END, year(l_shipdate), "
        "CASE WHEN l_linenumber % 3 = 2 THEN 'b' ELSE '' END) AS header",
    )
    return headers.detect_wide(catalogue)


# --- lookups -------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, s_acctbal AS "PA", CAST(s_nationkey AS DOUBLE) AS "Latitude"
       FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey + 10"""
)
def lookup_join(spark, sf_dir):
    # keys are shifted, so that some find no partner
    plots = table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.expr("s_suppkey + 10"))
    wanted = [
        mapping.Lookup(plots, "l_suppkey", "s_suppkey", "s_acctbal", "PA"),
        mapping.Lookup(plots, "l_suppkey", "s_suppkey", "s_nationkey", "Latitude"),
    ]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return mapping.join_lookups(df, wanted)


@query(
    """SELECT l_orderkey, l_linenumber, "PA" FROM lineitem LEFT JOIN (
         SELECT s_suppkey, s_acctbal AS "PA" FROM supplier
         UNION ALL SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_suppkey % 2 = 0)
       ON l_suppkey = s_suppkey"""
)
def lookup_fanout(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    twice = supplier.selectExpr("s_suppkey", "s_acctbal AS v").unionByName(
        supplier.where("s_suppkey % 2 = 0").selectExpr("s_suppkey", "CAST(s_nationkey AS DOUBLE) AS v")
    )
    wanted = [mapping.Lookup(twice, "l_suppkey", "s_suppkey", "v", "PA")]
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return mapping.join_lookups(df, wanted).drop("l_suppkey")


# --- reshape, order, deduplication ---------------------------------------------------

@query(
    """SELECT dsn, "PlotID", "TreeID", max(CASE WHEN "YR" = y THEN "DBH" END) AS "DBH", CAST(y AS INT) AS "YR"
       FROM census, (SELECT unnest(range(min("YR"), max("YR") + 1)) AS y FROM census) GROUP BY dsn, "PlotID", "TreeID", y""",
    *CENSUS,
)
def melt_wide(spark, sf_dir):
    """One column per census from the table's first to its last year, and back to rows."""
    df = rows(spark, sf_dir)
    span = df.agg(F.min(YEAR).alias("a"), F.max(YEAR).alias("b")).first()
    years = [] if span.a is None else range(span.a, span.b + 1)
    cells = [F.max(F.when(F.col(YEAR) == y, F.col(DBH))).alias(f"DBH_{y}") for y in years]
    wide = df.groupBy("dsn", PLOT, TREE).agg(*cells)
    return reshape.melt_wide(wide, ["dsn", PLOT, TREE], [(f"DBH_{y}", y) for y in years])


@query(f'SELECT {KEY_SQL}, "DBH", l_orderkey, l_linenumber FROM prepared', *PREPARED_ROWS)
def dedup_first(spark, sf_dir):
    kept = census.dedup_first(rows(spark, sf_dir).drop("code"), TIE)
    return kept.select(*KEY, DBH, "l_orderkey", "l_linenumber")


@query(f'SELECT {KEY_SQL}, "PrevYR" FROM prepared', *PREPARED_ROWS)
def prev_yr(spark, sf_dir):
    once = rows(spark, sf_dir).select(*KEY).distinct()
    return census.previous_year(once).select(*KEY, PREV_YEAR)


@query(f'SELECT {KEY_SQL}, "PrevYR", "DBH", l_orderkey, l_linenumber FROM prepared', *PREPARED_ROWS)
def prepare_multi(spark, sf_dir):
    return prepared(spark, sf_dir).select(*KEY, PREV_YEAR, DBH, "l_orderkey", "l_linenumber")


@query(f'SELECT {KEY_SQL}, "DBH", "Status", l_orderkey, l_linenumber FROM pc', *CODED_PREPARED)
def prepare_single(spark, sf_dir):
    return single_coded(spark, sf_dir).select(*KEY, DBH, STATUS, "l_orderkey", "l_linenumber")


@query(f'SELECT {KEY_SQL}, l_orderkey FROM census ORDER BY {KEY_SQL}, l_orderkey', *CENSUS)
def census_sort(spark, sf_dir):
    return census.census_sort(rows(spark, sf_dir).select(*KEY, "l_orderkey"))


@query(
    f"""SELECT {KEY_SQL}, min("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID") AS tree_first,
               max("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID") AS tree_last FROM prepared""",
    *PREPARED_ROWS,
)
def tree_span(spark, sf_dir):
    return census.with_tree_span(prepared(spark, sf_dir).select(*KEY))


@query(
    'SELECT dsn, "PlotID", min("YR") AS plot_first, max("YR") AS plot_last FROM census GROUP BY dsn, "PlotID"',
    *CENSUS,
)
def plot_first(spark, sf_dir):
    return census.plot_years(rows(spark, sf_dir))


@query(f"SELECT {KEY_SQL}, vf AS valid_first, vl AS valid_last FROM structure", *DERIVED_ROWS)
def valid_span(spark, sf_dir):
    spans = census.with_valid_span(prepared(spark, sf_dir))
    return spans.select(*KEY, "valid_first", "valid_last")


# --- status derivation ---------------------------------------------------------------


@query(f'SELECT {KEY_SQL}, "PrevYR", "DBH", "Status" FROM derived', *DERIVED_ROWS)
def derive_status(spark, sf_dir):
    derived = status.derive_status(
        prepared(spark, sf_dir), years_from=rows(spark, sf_dir)
    )
    return derived.select(*KEY, PREV_YEAR, DBH, STATUS)


@query(
    """SELECT dsn, count(*) FILTER ("YR" = pf) AS first_census,
              count(*) FILTER ("Status" = '2') AS recruit,
              greatest(0, count(*) - count(*) FILTER ("YR" = pf) - count(*) FILTER ("Status" IN ('1', '2', '9'))) AS subsequent_alive,
              count(*) FILTER ("Status" = '1') AS dead, count(*) FILTER ("Status" = '9') AS missing,
              count(DISTINCT "PlotID" || ' ' || "TreeID") FILTER (tl < dl) AS disappeared_trees
       FROM derived GROUP BY dsn""",
    *DERIVED_ROWS,
)
def derive_summary(spark, sf_dir):
    return status.derive_summary(prepared(spark, sf_dir), years_from=rows(spark, sf_dir))


@query(
    'SELECT DISTINCT dsn, "PlotID", "TreeID", tl AS tree_last FROM structure WHERE tl < dl',
    *DERIVED_ROWS,
)
def disappeared_trees(spark, sf_dir):
    return status.disappeared_trees(rows(spark, sf_dir))


@query(
    """SELECT dsn, "PlotID", "TreeID", dl AS "YR", CAST(NULL AS INT) AS "PrevYR", CAST(NULL AS DOUBLE) AS "DBH",
              '9' AS "Status", l_orderkey FROM derived WHERE "YR" = tl AND tl < dl""",
    *DERIVED_ROWS,
)
def disappeared_rows(spark, sf_dir):
    added = status.disappeared_rows(
        prepared(spark, sf_dir), "missing", years_from=rows(spark, sf_dir)
    )
    return added.select(*KEY, PREV_YEAR, DBH, STATUS, "l_orderkey")


@query(
    f"""SELECT {KEY_SQL}, "PrevYR", "DBH", "Status", l_orderkey FROM derived
        UNION ALL SELECT dsn, "PlotID", "TreeID", dl, "YR", NULL, '1', l_orderkey
        FROM derived WHERE "YR" = tl AND tl < dl""",
    *DERIVED_ROWS,
)
def derive_full(spark, sf_dir):
    full = status.derive_full(prepared(spark, sf_dir), "dead", years_from=rows(spark, sf_dir))
    return full.select(*KEY, PREV_YEAR, DBH, STATUS, "l_orderkey")


@query(ORACLES["derive_full"])
def derive_marked(spark, sf_dir):
    """The same by marker rows: no row is joined to its plot."""
    full = status.prepare_and_derive(rows(spark, sf_dir).drop("code"), "dead", TIE)
    return full.select(*KEY, PREV_YEAR, DBH, STATUS, "l_orderkey")


# --- validation ----------------------------------------------------------------------


@query(f'SELECT {KEY_SQL}, count("PlotID") AS n FROM coded GROUP BY ALL HAVING count("PlotID") > 1', *CODED_ROWS)
def val_duplicates(spark, sf_dir):
    return validate.duplicate_groups(coded(spark, sf_dir))


def _rule_query(name: str, rule: validate.Rule, predicate: str):
    sql = f"SELECT {KEY_SQL}, l_orderkey, l_linenumber FROM pc WHERE {predicate}"

    @query(sql, *CODED_PREPARED, name=name)
    def run(spark, sf_dir):
        hit = validate.row_predicates("multi")[rule]
        return prepared_coded(spark, sf_dir).where(hit).select(*KEY, "l_orderkey", "l_linenumber")


_UNKNOWN_SQL = "\"Status\" NOT IN ('0', '1', '2', '9')"
_DEAD_DBH_SQL = "\"Status\" = '1' AND \"DBH\" IS NOT NULL"
_RECRUIT_SQL = "\"Status\" = '2' AND \"DBH\" IS NULL"
_ORPHAN_SQL = "\"PrevYR\" IS NULL AND \"Status\" = '1'"
_rule_query("val_unknown", validate.UNKNOWN_STATUS, _UNKNOWN_SQL)
_rule_query("val_dead_dbh", validate.DEAD_WITH_DBH, _DEAD_DBH_SQL)
_rule_query("val_recruit_no_dbh", validate.RECRUIT_WITHOUT_DBH, _RECRUIT_SQL)
_rule_query("val_orphan_dead", validate.ORPHAN_DEAD, _ORPHAN_SQL)


@query(
    f'SELECT dsn, "Status", count(*) AS row_count FROM coded WHERE {_UNKNOWN_SQL} GROUP BY ALL',
    *CODED_ROWS,
)
def val_unknown_values(spark, sf_dir):
    return validate.unknown_values(coded(spark, sf_dir))


AT_FIRST = """at_first AS (
  SELECT *, min("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID") AS tf FROM {source})"""


@query(
    f"""SELECT {KEY_SQL}, count(*) AS row_count FROM at_first
        WHERE "Status" = '2' AND "YR" = tf GROUP BY ALL""",
    *CODED_ROWS, AT_FIRST.format(source="coded"),
)
def val_recruit_min_yr(spark, sf_dir):
    return validate.recruits_at_first_year(coded(spark, sf_dir))


@query(
    """SELECT dsn, row_count FROM (
         SELECT dsn, max(years) AS most, count(*) AS row_count FROM (
           SELECT dsn, "PlotID", "TreeID", count(DISTINCT "YR") AS years FROM (
             SELECT CASE WHEN dsn = 'D3' THEN 'D3' ELSE 'once' END AS dsn, "PlotID",
                    CASE WHEN dsn = 'D3' THEN "TreeID" ELSE "TreeID" || '/' || CAST("YR" AS VARCHAR) END AS "TreeID", "YR"
             FROM coded) GROUP BY ALL) GROUP BY dsn) WHERE most < 2""",
    *CODED_ROWS,
)
def val_no_link(spark, sf_dir):
    """One dataset keeps its tree ids; in the other a tree gets a new id in every census."""
    df = coded(spark, sf_dir).selectExpr(
        "CASE WHEN dsn = 'D3' THEN 'D3' ELSE 'once' END AS dsn", "PlotID",
        "CASE WHEN dsn = 'D3' THEN TreeID ELSE concat(TreeID, '/', YR) END AS TreeID",
        "YR", "Status", "DBH", "CAST(NULL AS INT) AS PrevYR",
    )
    found = validate.findings(df, check_linkage=True)
    return found.where(F.col("rule") == validate.NO_LINKED_TREES.name).select("dsn", "row_count")


_FINDINGS = """counts AS (
  SELECT dsn, count(*) FILTER (multi) AS c1, sum(c2) AS c2, sum(c3) AS c3, sum(c4) AS c4, sum(c5) AS c5, sum(c6) AS c6
  FROM (SELECT dsn, count("PlotID") > 1 AS multi,
               count(*) FILTER ({unknown}) AS c2, count(*) FILTER ({dead}) AS c3,
               count(*) FILTER ({recruit}) AS c4, count(*) FILTER ({orphan}) AS c5,
               count(*) FILTER ("Status" = '2' AND "YR" = tf) AS c6
        FROM at_first GROUP BY dsn, "PlotID", "TreeID", "YR") GROUP BY dsn), findings AS ({union})""".format(
    unknown=_UNKNOWN_SQL,
    dead=_DEAD_DBH_SQL,
    recruit=_RECRUIT_SQL,
    orphan=_ORPHAN_SQL,
    union=" UNION ALL ".join(
        f"SELECT dsn, CAST({i} AS INT) AS position, '{r.name}' AS rule, '{r.severity}' AS severity, "
        f"'{r.action}' AS action, CAST(c{i} AS BIGINT) AS row_count, "
        f"CAST(c{i} AS VARCHAR) || ' ' || '{r.text.replace(chr(39), chr(39) * 2)}' AS message "
        f"FROM counts WHERE c{i} > 0"
        for i, r in enumerate(validate.RULES, start=1)
    ),
)
# Rows as mapped, with the previous year but with their copies. The queries need no linking for this.
_LINKED = """linked AS (
  SELECT c.*, p."PrevYR" FROM coded c JOIN pc p USING (dsn, "PlotID", "TreeID", "YR"))"""
FOUND = [*CODED_PREPARED, _LINKED, AT_FIRST.format(source="linked"), _FINDINGS]


@query("SELECT * FROM findings", *FOUND)
def validate_all(spark, sf_dir):
    return validate.findings(coded(spark, sf_dir))


@query(
    """SELECT dsn, position, rule, severity, action, row_count,
              CASE WHEN rule = 'UnknownStatus' THEN message || ' Found ' ||
                (SELECT count(DISTINCT "Status") FROM linked u
                 WHERE u.dsn = f.dsn AND "Status" NOT IN ('0', '1', '2', '9')) || ' values.' ELSE message END AS message
       FROM findings f""",
    *FOUND,
)
def validate_messages(spark, sf_dir):
    df = coded(spark, sf_dir)
    return validate.with_unknown_values(validate.findings(df), df)


@query(
    """SELECT dsn, bool_and(severity IS NULL) AS is_clean,
              coalesce(bool_or(severity IN ('RequiresInput', 'Escalate')), false) AS has_blocking
       FROM (SELECT DISTINCT dsn FROM census) LEFT JOIN findings USING (dsn) GROUP BY dsn""",
    *FOUND,
)
def validate_verdict(spark, sf_dir):
    found = validate.findings(coded(spark, sf_dir))
    return validate.verdict(found, rows(spark, sf_dir))


@query("SELECT dsn, severity, count(*) AS n_findings FROM findings GROUP BY ALL", *FOUND)
def findings_by_severity(spark, sf_dir):
    return validate.by_severity(validate.findings(coded(spark, sf_dir)))


@query(
    f"""SELECT * FROM (SELECT {KEY_SQL}, l_orderkey, l_linenumber, concat_ws(',',
          CASE WHEN count("PlotID") OVER (PARTITION BY {KEY_SQL}) > 1 THEN 'DuplicateTreeWithinPlotYear' END,
          CASE WHEN {_UNKNOWN_SQL} THEN 'UnknownStatus' END,
          CASE WHEN {_DEAD_DBH_SQL} THEN 'DeadTreeHasDbh' END,
          CASE WHEN {_RECRUIT_SQL} THEN 'RecruitMissingDbh' END,
          CASE WHEN {_ORPHAN_SQL} THEN 'OrphanDeadFirstCensus' END,
          CASE WHEN "Status" = '2' AND "YR" = tf THEN 'RecruitAtMinYear' END) AS flags
        FROM at_first) WHERE flags <> ''""",
    *FOUND,
)
def flag_rows(spark, sf_dir):
    flagged = validate.flag_rows(coded(spark, sf_dir))
    flags = F.array_join("flags", ",").alias("flags")
    return flagged.select(*KEY, "l_orderkey", "l_linenumber", flags)


_LINKAGE = """years AS (
  SELECT *, lead("YR") OVER (PARTITION BY dsn, "PlotID" ORDER BY "YR") AS next FROM (SELECT DISTINCT dsn, "PlotID", "YR" FROM {source})),
rates AS (
  SELECT t.dsn, t."YR" AS from_year, y.next AS to_year, count(*) AS n_trees, count(u."TreeID") AS n_found
  FROM (SELECT DISTINCT dsn, "PlotID", "TreeID", "YR" FROM {source}) t
  JOIN years y ON t.dsn = y.dsn AND t."PlotID" = y."PlotID" AND t."YR" = y."YR" AND y.next IS NOT NULL
  LEFT JOIN (SELECT DISTINCT dsn, "PlotID", "TreeID", "YR" FROM {source}) u
    ON u.dsn = t.dsn AND u."PlotID" = t."PlotID" AND u."TreeID" = t."TreeID" AND u."YR" = y.next
  GROUP BY ALL)"""


@query("SELECT * FROM rates", ROWS, _LINKAGE.format(source="census"))
def linkage_rates(spark, sf_dir):
    return validate.linkage_rates(rows(spark, sf_dir))


@query(
    """SELECT dsn, CAST(7 AS INT) AS position, 'NoPersistentTreeId' AS rule, 'Escalate' AS severity,
              'EscalateToCurationLog' AS action, CAST(n - f AS BIGINT) AS row_count,
              CAST(n - f AS VARCHAR) || ' of ' || CAST(n AS VARCHAR)
                || ' trees were not found in their plot''s next census; tree ids may not be persistent.' AS message
       FROM (SELECT dsn, CAST(sum(n_trees) AS BIGINT) AS n, CAST(sum(n_found) AS BIGINT) AS f FROM rates GROUP BY dsn)
       WHERE f > 0 AND f < n * CAST(0.1 AS DOUBLE)""",
    ROWS,
    """loose AS (
      SELECT dsn, "PlotID", CASE WHEN dsn = 'D3' OR l_orderkey % 50 = 0 THEN "TreeID" ELSE "TreeID" || '/' || CAST("YR" AS VARCHAR) END AS "TreeID",
             "YR" FROM census)""",
    _LINKAGE.format(source="loose"),
)
def val_weak_link(spark, sf_dir):
    """In all datasets but one most trees get a new id in every census; a few that do not must not silence the rule."""
    df = rows(spark, sf_dir).selectExpr(
        "dsn", "PlotID", "CASE WHEN dsn = 'D3' OR l_orderkey % 50 = 0 THEN TreeID ELSE concat(TreeID, '/', YR) END AS TreeID", "YR"
    )
    return validate.linkage_findings(df)


@query(
    """SELECT dsn, code AS source_value, CASE code WHEN 'AF' THEN '0' WHEN 'AO' THEN '0' WHEN 'RF' THEN '1'
              WHEN 'RO' THEN '2' WHEN 'NF' THEN '2' ELSE '9' END AS current_target, count(*) AS row_count
       FROM census WHERE code IS NOT NULL GROUP BY ALL""",
    *CENSUS,
)
def status_vocab(spark, sf_dir):
    listed = validate.status_vocabulary(rows(spark, sf_dir), CODES, column="code")
    return listed.orderBy(F.desc("row_count"), "dsn", "source_value")


# --- export clean-up -----------------------------------------------------------------

_FIN = 'dsn, "PlotID", "TreeID", "YR", "PrevYR", "DBH", "Status", l_orderkey'


def _fin(df: DataFrame) -> DataFrame:
    return df.select(*KEY, PREV_YEAR, DBH, STATUS, "l_orderkey")


@query(
    f"""SELECT * REPLACE (CASE WHEN "Status" IN ('0', '1', '2', '9') THEN "Status" ELSE '9' END AS "Status")
        FROM (SELECT {_FIN} FROM pc)""",
    *CODED_PREPARED,
)
def fin_recode(spark, sf_dir):
    return _fin(finalize.recode_unknown(prepared_coded(spark, sf_dir)))


@query(
    f"""SELECT * REPLACE (CASE WHEN "Status" = '1' THEN NULL ELSE "DBH" END AS "DBH")
        FROM (SELECT {_FIN} FROM pc)""",
    *CODED_PREPARED,
)
def fin_nullify(spark, sf_dir):
    return _fin(finalize.nullify_dead_dbh(prepared_coded(spark, sf_dir)))


@query(
    f'SELECT {_FIN} FROM pc WHERE NOT ("PrevYR" IS NULL AND "Status" = \'1\') '
    'AND NOT ("Status" = \'2\' AND "DBH" IS NULL)',
    *CODED_PREPARED,
)
def fin_drop_invalid(spark, sf_dir):
    return _fin(finalize.drop_invalid(prepared_coded(spark, sf_dir)))


@query(
    f'SELECT {_FIN} FROM pc WHERE NOT ("PrevYR" IS NULL AND "Status" = \'0\')', *CODED_PREPARED
)
def fin_drop_anchor(spark, sf_dir):
    return _fin(finalize.drop_anchors(prepared_coded(spark, sf_dir)))


@query(
    f'SELECT * REPLACE (TRY_CAST("Status" AS INT) AS "Status") FROM (SELECT {_FIN} FROM pc)',
    *CODED_PREPARED,
)
def fin_status_int(spark, sf_dir):
    return _fin(finalize.status_to_int(prepared_coded(spark, sf_dir)))


RECODED = """recoded AS (
  SELECT * REPLACE (CASE WHEN s = '1' THEN NULL ELSE "DBH" END AS "DBH", s AS "Status") FROM (
    SELECT *, CASE WHEN "Status" IN ('0', '1', '2', '9') THEN "Status" ELSE '9' END AS s FROM pc))"""


@query(
    f"""SELECT * REPLACE (CAST("Status" AS INT) AS "Status") FROM (SELECT {_FIN} FROM recoded
        WHERE NOT ("Status" = '2' AND "DBH" IS NULL) AND NOT ("PrevYR" IS NULL AND "Status" IN ('0', '1')))
        ORDER BY {KEY_SQL}""",
    *CODED_PREPARED, RECODED,
)
def export_multi(spark, sf_dir):
    return _fin(census.census_sort(finalize.finalize(prepared_coded(spark, sf_dir)), unique=True))


@query(
    f"""SELECT {KEY_SQL}, "DBH", CAST("Status" AS INT) AS "Status", l_orderkey FROM recoded
        WHERE NOT ("Status" = '2' AND "DBH" IS NULL) ORDER BY {KEY_SQL}""",
    *CODED_PREPARED, RECODED,
)
def export_single(spark, sf_dir):
    final = finalize.finalize(single_coded(spark, sf_dir), "single")
    return census.census_sort(final, unique=True).select(*KEY, DBH, STATUS, "l_orderkey")


_STAMP = Provenance("draft", "1", "schema", "", "2024-01-31")


@query(
    f"""SELECT dsn, CAST(place // 1000 AS INT) AS file, place,
          CASE WHEN place % 1000 = 0 THEN '# build=draft app_version=1 schema_version=schema dsn=' || coalesce(dsn, '') || ' timestamp=2024-01-31'
            || chr(10) || 'dsn,PlotID,TreeID,YR,PrevYR,DBH,Status' || chr(10) ELSE '' END || line AS "value"
        FROM (SELECT dsn, row_number() OVER (PARTITION BY dsn ORDER BY "PlotID", "TreeID", "YR") - 1 AS place,
                dsn || ',' || "PlotID" || ',' || "TreeID" || ',' || CAST("YR" AS VARCHAR) || ',' || coalesce(CAST("PrevYR" AS VARCHAR), '')
                || ',' || coalesce(CAST("DBH" AS VARCHAR), '') || ',' || "Status" AS line
              FROM (SELECT {_FIN} FROM recoded WHERE NOT ("Status" = '2' AND "DBH" IS NULL)
                    AND NOT ("PrevYR" IS NULL AND "Status" IN ('0', '1'))))""",
    *CODED_PREPARED, RECODED,
)
def render_csv(spark, sf_dir):
    """Lines of the delivered files, numbered within each dataset, a thousand to a file."""
    final = _fin(finalize.finalize(prepared_coded(spark, sf_dir))).drop("l_orderkey")
    return writers.csv_lines(final, _STAMP, rows_per_file=1000)


SINGLES = "dsn IN ('D0', 'D1')"
PREPARED_MIXED = f"""pm AS (
  SELECT * REPLACE (CASE WHEN {SINGLES} THEN NULL ELSE "PrevYR" END AS "PrevYR") FROM pc)"""


def _mixed(df: DataFrame) -> DataFrame:
    """Rows with the census type of their dataset: two are single, one has no metadata."""
    types = df.sparkSession.sql(
        "SELECT * FROM VALUES ('D0', 'single'), ('D1', 's'), ('D2', 'multi') AS t(dsn, census_type)"
    )
    return census.with_census_type(df, types)


@query(
    f"""SELECT * REPLACE (CAST("Status" AS INT) AS "Status") FROM (SELECT {_FIN} FROM recoded
        WHERE NOT ("Status" = '2' AND "DBH" IS NULL)
        AND NOT (NOT {SINGLES} AND "PrevYR" IS NULL AND "Status" IN ('0', '1')))""",
    *CODED_PREPARED, PREPARED_MIXED, RECODED.replace("FROM pc", "FROM pm"),
)
def export_mixed(spark, sf_dir):
    kind = F.col("census_type")
    return _fin(finalize.finalize(census.prepare(_mixed(coded(spark, sf_dir)), kind, TIE), kind))


@query(
    f"""SELECT * FROM findings
        WHERE NOT ({SINGLES} AND rule IN ('OrphanDeadFirstCensus', 'RecruitAtMinYear'))""",
    *FOUND,
)
def validate_mixed(spark, sf_dir):
    return validate.findings(_mixed(coded(spark, sf_dir)), F.col("census_type"))


@query(
    f"""SELECT {KEY_SQL}, CASE WHEN {SINGLES} THEN NULL ELSE "PrevYR" END AS "PrevYR", "DBH",
          CASE WHEN NOT {SINGLES} THEN "Status" WHEN "DBH" IS NULL THEN '9' ELSE '0' END AS "Status", l_orderkey
        FROM derived
        UNION ALL SELECT dsn, "PlotID", "TreeID", dl, "YR", NULL, '1', l_orderkey
        FROM derived WHERE "YR" = tl AND tl < dl AND NOT {SINGLES}""",
    *DERIVED_ROWS,
)
def derive_mixed(spark, sf_dir):
    df, kind = rows(spark, sf_dir), F.col("census_type")
    linked = census.prepare(_mixed(df.drop("code")), kind, TIE)
    full = status.derive_full(linked, "dead", years_from=df, census_type=kind)
    return full.select(*KEY, PREV_YEAR, DBH, STATUS, "l_orderkey")


# --- curation log --------------------------------------------------------------------

_LOG_HEAD = (
    "'DATASET: ' || dsn || chr(10) || 'COUNTRY: ' || country || chr(10) || 'SITE: ' || chr(10) || 'PI: ' || pi || chr(10) "
    "|| 'CURATOR: C. Urator' || chr(10) || 'DATE RECEIVED: ' || chr(10) || 'DATE PROCESSED: 2024-01-31' || chr(10)"
)
_LOG_BODY = " || ".join(f"'--- {s} ---' || chr(10) || chr(10)" for s in curation_log.SECTIONS[:-1])


@query(
    f"""SELECT dsn, {_LOG_HEAD} || {_LOG_BODY} || '--- NOTES ---' || chr(10) || coalesce(notes, '') || chr(10) AS log
        FROM (SELECT dsn, 'C' || CAST(count(DISTINCT "PlotID") AS VARCHAR) AS country, 'PI ' || min("PlotID") AS pi
              FROM census GROUP BY dsn) LEFT JOIN (
          SELECT dsn, string_agg('  ' || line, chr(10) ORDER BY position) AS notes FROM (
            SELECT dsn, position, '[AUTO-FLAGGED] ' || rule || ' (' || CAST(row_count AS VARCHAR) || ' rows) — ' || message AS line
            FROM findings WHERE rule IN ('RecruitAtMinYear', 'NoPersistentTreeId')
            UNION ALL SELECT dsn, 0, CAST(count(DISTINCT "PlotID" || ' ' || "TreeID") AS VARCHAR)
              || ' trees are absent from the last census and were left unresolved.'
            FROM structure WHERE tl < dl GROUP BY dsn) GROUP BY dsn) USING (dsn)""",
    *CODED_PREPARED, PREPARED, DERIVED, _LINKED, AT_FIRST.format(source="linked"), _FINDINGS,
    name="curation_log",
)
def curation_logs(spark, sf_dir):
    df = rows(spark, sf_dir)
    datasets = df.groupBy("dsn").agg(
        F.concat(F.lit("C"), F.count_distinct(PLOT).cast("string")).alias("country"),
        F.concat(F.lit("PI "), F.min(PLOT)).alias("pi"),
    )
    found = validate.findings(coded(spark, sf_dir))
    summary = status.derive_summary(prepared(spark, sf_dir), years_from=df)
    lines = [curation_log.finding_lines(found), curation_log.disappeared_lines(summary)]
    return curation_log.curation_logs(datasets, lines, "C. Urator", "2024-01-31")


# --- whole plans ---------------------------------------------------------------------

_WHOLE_KEYS = [PLOT, TREE, YEAR, PREV_YEAR, DBH, STATUS, "dsn"]
FULL = """filled AS (
  SELECT dsn, "PlotID", "TreeID", "YR", "PrevYR", "DBH", "Status" FROM derived
  UNION ALL SELECT dsn, "PlotID", "TreeID", dl, "YR", NULL, '1' FROM derived WHERE "YR" = tl AND tl < dl),
final AS (SELECT * REPLACE (CAST("Status" AS INT) AS "Status",
                            CASE WHEN "Status" = '1' THEN NULL ELSE "DBH" END AS "DBH") FROM filled
          WHERE NOT ("Status" = '2' AND "DBH" IS NULL) AND NOT ("PrevYR" IS NULL AND "Status" IN ('0', '1')))"""
LONG_ROWS = """census AS (
  SELECT 'in_per_ruiz_2020_m' AS dsn, lower('S-' || CAST(l_suppkey AS VARCHAR)) AS "PlotID",
         CAST(l_partkey AS VARCHAR) AS "TreeID", CAST(year(l_shipdate) AS INT) AS "YR",
         CASE WHEN l_returnflag <> 'N' THEN l_quantity / 10.0::DOUBLE END AS "DBH",
         l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem)"""


@query("SELECT * FROM final", LONG_ROWS, PREPARED, DERIVED, FULL)
def harmonize_long(spark, sf_dir):
    """A raw long table, diameters as text in millimetres, to delivered rows."""
    raw = table(spark, sf_dir, "lineitem").withColumn(
        "diam", F.expr("CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS STRING) ELSE 'n/a' END")
    )
    exprs = [
        mapping.Concat(["l_suppkey"], PLOT, sep="-", prefix="S"),
        mapping.Column("l_partkey", TREE),
        mapping.YearOf("l_shipdate"),
        mapping.Column("diam", DBH),
    ]
    submission = Submission("in_per_ruiz_2020_m", exprs, metadata=Metadata(dbh_unit="mm"))
    return harmonize(raw, submission, "dead", TIE).final().select(*_WHOLE_KEYS)


WIDE_ROWS = """census AS (
  SELECT 'in_bra_silva_2021_m' AS dsn, 'P' || CAST(l_suppkey % 10 AS VARCHAR) AS "PlotID",
         CAST(l_partkey AS VARCHAR) AS "TreeID", CAST(y AS INT) AS "YR",
         max(CASE WHEN year(l_shipdate) = y AND l_returnflag <> 'N' THEN l_quantity END) AS "DBH"
  FROM lineitem, (SELECT unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS y FROM lineitem)
  GROUP BY l_suppkey % 10, l_partkey, y)"""
WIDE_PREPARED = """prepared AS (
  SELECT *, lag("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID" ORDER BY "YR") AS "PrevYR" FROM census)"""


@query("SELECT * FROM final", WIDE_ROWS, WIDE_PREPARED, DERIVED, FULL)
def harmonize_wide(spark, sf_dir):
    """A raw wide table, one diameter column per census, to delivered rows."""
    measured = F.col("l_returnflag") != "N"
    years = _ship_years(spark, sf_dir)
    wide = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr("concat('P', l_suppkey % 10)").alias("plot"), "l_partkey")
        .agg(
            *[
                F.max(F.when(measured & (F.year("l_shipdate") == y), F.col("l_quantity"))).alias(f"d_{y}")
                for y in years
            ]
        )
    )
    ids = [mapping.Column("plot", PLOT), mapping.Column("l_partkey", TREE)]
    submission = Submission("in_bra_silva_2021_m", ids, wide_pairs=[(f"d_{y}", y) for y in years])
    return harmonize(wide, submission, "dead").final().select(*_WHOLE_KEYS)


# --- many datasets by one table of mappings ------------------------------------------

#: Three datasets in one table, each with columns of its own: long in millimetres, long with codes, wide.
_LONG_CELLS = {
    "plot": "concat('P', l_suppkey % 10)",
    "tag": "CAST(l_partkey AS STRING)",
    "when": "concat('census of ', year(l_shipdate))",
    "diam": "CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS STRING) ELSE 'n/a' END",
    "remark": "l_linestatus",
}
_CODED_CELLS = {
    "site": "concat('S', l_suppkey % 5)",
    "sub": "CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END",
    "arbre": "CAST(l_partkey AS STRING)",
    "annee": "concat(year(l_shipdate), '.0')",
    "dap": "CAST(l_quantity AS STRING)",
    "etat": "concat(l_returnflag, l_linestatus)",
}


def _many_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")

    def part(dsn: str, rest: int, cells: dict[str, str]) -> DataFrame:
        own = df.where(f"l_linenumber % 3 = {rest}").selectExpr(*[f"{sql} AS `{name}`" for name, sql in cells.items()])
        return many.cells_of(own, F.lit(dsn))

    grouped = df.where("l_linenumber % 3 = 2").groupBy(
        F.expr("concat('W', l_suppkey % 10)").alias("p"), F.col("l_partkey").cast("string").alias("t"),
        F.concat(F.lit("d"), F.year("l_shipdate")).alias("census"),
    )
    cell = F.struct("census", "cell")
    wide = grouped.agg(F.max("l_quantity").cast("string").alias("cell")).groupBy("p", "t").agg(F.collect_list(cell).alias("cells"))
    ids = F.array(*[F.struct(F.lit(c).alias("census"), F.col(c).alias("cell")) for c in "pt"])
    entries = F.map_from_entries(F.concat(ids, "cells"))
    wide = wide.select(F.lit("wide").alias("dsn"), entries.alias("cells"))
    return part("long", 0, _LONG_CELLS).unionByName(part("coded", 1, _CODED_CELLS)).unionByName(wide)


def _many_mappings(spark: SparkSession, years: range) -> DataFrame:
    long = [
        mapping.Column("plot", PLOT), mapping.Column("tag", TREE), mapping.YearOf("when"), mapping.Column("diam", DBH),
    ]
    coded_ = [
        mapping.Concat(["site", "sub"], PLOT, sep="-", prefix="X"), mapping.Column("arbre", TREE), mapping.Column("annee", YEAR),
        mapping.Column("dap", DBH), mapping.Column("etat", STATUS), mapping.Literal("unknown", "Species"),
    ]
    wide = [mapping.Column("p", PLOT), mapping.Column("t", TREE)]
    return mapping_table(
        spark,
        [
            Submission("long", long, metadata=Metadata(dbh_unit="mm")),
            Submission("coded", coded_, CODES),
            Submission("wide", wide, wide_pairs=[(f"d{y}", y) for y in years]),
        ],
    )


def _ship_years(spark: SparkSession, sf_dir: str) -> range:
    """All census years of the table, from its smallest to its largest."""
    first, last = table(spark, sf_dir, "lineitem").agg(F.min(F.year("l_shipdate")), F.max(F.year("l_shipdate"))).first()
    return range(first, last + 1) if first is not None else range(0)


MANY_ROWS = """ship_years AS (SELECT unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS y FROM lineitem),
census AS (
  SELECT 'long' AS dsn, 'P' || CAST(l_suppkey % 10 AS VARCHAR) AS "PlotID", CAST(l_partkey AS VARCHAR) AS "TreeID",
         CAST(year(l_shipdate) AS INT) AS "YR", CASE WHEN l_returnflag <> 'N' THEN l_quantity / 10.0::DOUBLE END AS "DBH",
         NULL AS own, NULL AS "Species", 'remark=' || l_linestatus || ',when=census of ' || CAST(year(l_shipdate) AS VARCHAR) AS extras
  FROM lineitem WHERE l_linenumber % 3 = 0
  UNION ALL
  SELECT 'coded', lower(concat_ws('-', 'X', 'S' || CAST(l_suppkey % 5 AS VARCHAR), CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END)),
         CAST(l_partkey AS VARCHAR), CAST(year(l_shipdate) AS INT), l_quantity,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN '0' WHEN 'AO' THEN '0' WHEN 'RF' THEN '1' WHEN 'RO' THEN '2'
              WHEN 'NF' THEN '2' ELSE l_returnflag || l_linestatus END, 'unknown',
         'site=S' || CAST(l_suppkey % 5 AS VARCHAR) || ',sub=' || coalesce(CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END, '')
  FROM lineitem WHERE l_linenumber % 3 = 1
  UNION ALL
  SELECT 'wide', p, t, CAST(y AS INT), max(CASE WHEN year(l_shipdate) = y THEN l_quantity END), NULL, NULL, ''
  FROM (SELECT *, 'W' || CAST(l_suppkey % 10 AS VARCHAR) AS p, CAST(l_partkey AS VARCHAR) AS t FROM lineitem WHERE l_linenumber % 3 = 2), ship_years
  GROUP BY p, t, y),
prepared AS (
  SELECT *, lag("YR") OVER (PARTITION BY dsn, "PlotID", "TreeID" ORDER BY "YR") AS "PrevYR" FROM (
    SELECT *, row_number() OVER (PARTITION BY dsn, "PlotID", "TreeID", "YR" ORDER BY "DBH" NULLS FIRST, own NULLS FIRST) AS rn FROM census)
  WHERE rn = 1)"""


@query(
    """SELECT dsn, "PlotID", "TreeID", "YR", "DBH", own AS "Status", "Species", extras, own IS NULL AS derive FROM census""",
    MANY_ROWS,
)
def map_datasets(spark, sf_dir):
    """Rows of three datasets mapped by one table of mappings; a column that feeds an id or a year also stays an extra."""
    mappings = _many_mappings(spark, _ship_years(spark, sf_dir))
    mapped = many.to_centimetres(conform(many.map_datasets(_many_raw(spark, sf_dir), mappings)))
    extra = F.transform(many.EXTRAS, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return mapped.select(*KEY, DBH, STATUS, "Species", F.array_join(extra, ",").alias("extras"), "derive")


@query(
    """SELECT dsn, "PlotID", "TreeID", "YR", "PrevYR", CAST("Status" AS INT) AS "Status",
              CASE WHEN "Status" = '1' THEN NULL ELSE "DBH" END AS "DBH"
       FROM (SELECT * REPLACE (CASE WHEN "Status" IN ('0', '1', '2', '9') THEN "Status" ELSE '9' END AS "Status") FROM settled)
       WHERE NOT ("Status" = '2' AND "DBH" IS NULL) AND NOT ("PrevYR" IS NULL AND "Status" IN ('0', '1'))""",
    MANY_ROWS,
    DERIVED,
    """settled AS (
      SELECT dsn, "PlotID", "TreeID", "YR", "PrevYR", "DBH", CASE WHEN dsn = 'coded' THEN own ELSE "Status" END AS "Status" FROM derived
      UNION ALL SELECT dsn, "PlotID", "TreeID", dl, "YR", NULL, '1' FROM derived WHERE "YR" = tl AND tl < dl AND dsn <> 'coded')""",
    name="harmonize_many",
)
def harmonize_datasets(spark, sf_dir):
    """Three datasets, each with its own columns, unit and codes, to delivered rows by one plan."""
    mappings = _many_mappings(spark, _ship_years(spark, sf_dir))
    work = harmonize_many(_many_raw(spark, sf_dir), mappings, tie_break=[DBH, STATUS])
    return work.final().select(*KEY, PREV_YEAR, DBH, STATUS)
