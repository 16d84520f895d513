"""Field expressions, lookups, status codes, reshaping, the gate and header catalogues."""

import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemledger.functions.countries import COUNTRY_CODES, with_iso3
from stemledger.functions.values import dataset_id, normalised_dbh, parsed_double, parsed_integer
from stemledger.operators import gate, headers, mapping, reshape
from stemledger.plans.harmonize import canonical
from stemledger.schema import DbhUnit, conform


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("A", "1", "x", "10.5", "2010-05-01"), ("B", None, "y", "n/a", "May 2015")]
    return spark.createDataFrame(rows, "`plot no.` string, sub string, tag string, d string, visit string")


def test_every_expression_sees_the_source_columns(raw):
    exprs = [
        mapping.Column("plot no.", "PlotID"),
        mapping.Concat(["plot no.", "tag"], "TreeID"),
        mapping.YearOf("visit"),
        mapping.Column("d", "DBH"),
        mapping.Literal("0.5", "PA"),
        mapping.Literal("1_0", "Species"),
    ]
    got = mapping.map_fields(raw, exprs, "in_x")
    assert set(got.columns) == {"sub", "tag", "visit", "PlotID", "TreeID", "YR", "DBH", "PA", "Species", "dsn"}
    first, second = got.orderBy("PlotID").collect()
    assert (first.PlotID, first.TreeID, first.YR, first.PA, first.Species) == ("A", "a_x", 2010, 0.5, "1_0")
    assert (second.YR, second.dsn) == (2015, "in_x")
    assert canonical(got).columns == ["PlotID", "TreeID", "YR", "DBH", "Species", "dsn"]


def test_concat_skips_nulls_and_lowers_prefix(raw):
    exprs = [mapping.Concat(["plot no.", "sub"], "PlotID", sep="-", prefix="Site")]
    got = mapping.map_fields(raw, exprs, "d").select("PlotID").collect()
    assert sorted(r.PlotID for r in got) == ["site-a-1", "site-b"]


def test_a_field_cannot_be_mapped_twice(raw):
    with pytest.raises(ValueError):
        mapping.map_fields(raw, [mapping.Column("d", "DBH"), mapping.Literal("1", "DBH")], "d")


def test_columns_that_differ_only_in_case_stay_apart(spark):
    df = spark.createDataFrame([("x", "1999", "2010")], "p string, Yr string, year string")
    got = mapping.map_fields(df, [mapping.Column("year", "YR"), mapping.Column("p", "PlotID")], "d")
    assert got.columns == ["Yr_source", "YR", "PlotID", "dsn"]
    assert conform(got).first().YR == 2010


def test_rename_skips_absent_columns(raw):
    got = mapping.rename_columns(raw, [("d", "DBH"), ("gone", "YR")], "x")
    assert got.columns == ["plot no.", "sub", "tag", "visit", "DBH", "dsn"]


def test_lookups_of_one_table_are_one_join(spark, raw):
    table = spark.createDataFrame([("A", "1.5", "7"), ("A", "2.5d", "8")], "k string, lat string, lon string")
    wanted = [
        mapping.Lookup(table, "plot no.", "k", "lat", "Latitude"),
        mapping.Lookup(table, "plot no.", "k", "lon", "Longitude"),
    ]
    got = mapping.join_lookups(raw, wanted)
    rows = sorted(((r["plot no."], r.Latitude, r.Longitude) for r in got.collect()), key=repr)
    assert rows == [("A", 1.5, 7.0), ("A", None, 8.0), ("B", None, None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_choices_prefer_lookup_then_column_then_constant(spark):
    table = spark.createDataFrame([("A", 1.0)], "k string, lat double")
    exprs = mapping.compile_choices(
        mapping.FieldChoices(
            plot=["p"], tree=["a", "b"], dbh="d", status="s",
            latitude=mapping.Choice(column="la"),
            longitude=mapping.Choice(column="lo", constant="3"),
            area=mapping.Choice(constant="1"),
            plot_table=mapping.PlotTable(table, "p", "k", latitude="lat"),
        )
    )
    kinds = {e.target: type(e).__name__ for e in exprs}
    assert kinds == {
        "PlotID": "Column", "TreeID": "Concat", "DBH": "Column", "Latitude": "Lookup",
        "Longitude": "Column", "PA": "Literal", "Status": "Column",
    }
    prefixed = mapping.compile_choices(mapping.FieldChoices(plot=["p"], plot_prefix=" s "))
    assert prefixed == [mapping.Concat(("p",), "PlotID", prefix="s")]


DBH_TEXTS = {
    "": None, "NA": None, "n/a": None, "NaN": None, "null": None, "ND": None, ".": None,
    "12.7": 12.7, " 1 ": 1.0, "1e1": 10.0, "12 cm": None, "10d": None, "0x1p3": None, " nan ": None,
    "-3": -3.0, None: None,
}


def test_dbh_texts(spark):
    df = spark.createDataFrame([(t,) for t in DBH_TEXTS], "t string")
    got = df.select("t", normalised_dbh(F.col("t"), df.schema["t"].dataType).alias("v")).collect()
    assert {r.t: r.v for r in got} == DBH_TEXTS


def test_float_nan_is_unmeasured_and_ints_are_widened(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "DBH double")
    assert [r.DBH for r in conform(df).collect()] == [None, 2.0]
    assert dict(conform(spark.range(1).select(F.col("id").alias("DBH"))).dtypes)["DBH"] == "double"


def test_conform_never_raises(spark):
    df = spark.createDataFrame([("x", "12.7", "2010")], "PlotID string, YR string, PrevYR string")
    assert conform(df).first().asDict() == {"PlotID": "x", "YR": None, "PrevYR": 2010}


def test_units(spark):
    df = spark.createDataFrame([(125.0,)], "DBH double")
    assert mapping.scale_dbh(df, "mm").first().DBH == 12.5
    assert mapping.scale_dbh(df, None).first().DBH == 125.0
    with pytest.raises(ValueError):
        DbhUnit.parse("inch")


def test_status_codes_last_or_first_wins(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "Status string")
    codes = [mapping.StatusCode("a", "0"), mapping.StatusCode("a", "1")]
    assert [r.Status for r in mapping.remap_status(df, codes).collect()] == ["1", "b", None]
    assert [r.Status for r in mapping.remap_status_or_missing(df, codes).collect()] == ["0", "9", "9"]
    assert mapping.remap_status(df, []).collect() == df.collect()


def test_status_codes_by_dataset(spark):
    df = spark.createDataFrame([("d", "a"), ("e", "a"), ("e", None)], "dsn string, Status string")
    table = spark.createDataFrame([("d", "a", "1")], "dsn string, source string, target string")
    kept = mapping.remap_status_by_table(df, table)
    assert sorted(kept.collect(), key=repr) == sorted([("d", "1"), ("e", "a"), ("e", None)], key=repr)
    missing = mapping.remap_status_by_table(df, table, "9")
    assert sorted(missing.collect()) == [("d", "1"), ("e", "9"), ("e", "9")]


def test_melt_keeps_unmeasured_years_and_scans_once(spark):
    wide = spark.createDataFrame([("P", "T", "4", "NA")], "PlotID string, TreeID string, d_1994 string, d_1997 string")
    long = reshape.melt_wide(wide, ["PlotID", "TreeID"], [("d_1994", 1994), ("d_1997", 1997)])
    assert [(r.YR, r.DBH) for r in long.orderBy("YR").collect()] == [(1994, 4.0), (1997, None)]
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        reshape.melt_wide(wide, ["PlotID"], [])


def test_bound_datasets_keep_extras_as_text(spark):
    a = spark.createDataFrame([("P", 1)], "PlotID string, note int")
    b = spark.createDataFrame([("Q", True)], "PlotID string, flag boolean")
    got = reshape.bind_datasets([a, b])
    assert dict(got.dtypes) == {"PlotID": "string", "note": "string", "flag": "string"}
    assert sorted(got.collect(), key=repr) == sorted([("P", "1", None), ("Q", None, "true")], key=repr)


def test_dataset_id_and_countries(spark):
    rows = [("peru", "de la Cruz-Ruiz", "2021", True), ("Atlantis", "X", "2021", False), ("Peru", "", "2021", False)]
    df = with_iso3(spark.createDataFrame(rows, "c string, last string, yr string, s boolean"), F.col("c"))
    got = df.select("c", dataset_id(F.col("iso3"), F.col("last"), F.col("yr"), F.col("s")).alias("dsn"))
    assert {r.c: r.dsn for r in got.collect()} == {"peru": "in_per_delacruzruiz_2021_s", "Atlantis": "", "Peru": ""}
    assert len(set(COUNTRY_CODES.values())) == len(COUNTRY_CODES) > 140


# --- gate ----------------------------------------------------------------------------


def test_gate_passes_a_clean_table(spark):
    assert gate.is_ok(spark.createDataFrame([("P1", "T1"), ("P1", "T2")], "PlotID string, TreeID string"))


def test_gate_stops_at_an_empty_table(spark):
    errors = gate.check(spark.createDataFrame([], "PlotID string"), ["", ""])
    assert [e.problem for e in errors] == ["empty"]


def test_gate_reports_everything_at_once(spark):
    df = spark.createDataFrame([("x", None, None)], "A string, B string, C string")
    errors = gate.check(df, ["A", "A", "", "column_3"])
    assert [(e.problem, e.header, e.count) for e in errors] == [
        ("duplicate_header", "A", None), ("blank_header", "", None),
        ("blank_header", "column_3", None), ("all_null_columns", None, 2),
    ]
    one = gate.check(df.drop("C"))
    assert [(e.problem, e.header) for e in one] == [("all_null_column", "B")]
    assert all(e.message for e in errors + one)


# --- header catalogues ---------------------------------------------------------------


def greedy(names):
    """The assignment rule, applied to one header list by brute force."""
    used, out = set(), []
    for name in names:
        text = name.lower().replace(" ", "_").replace("-", "_")
        hit = next(
            (f for f, al in headers.FIELD_ALIASES.items() if f not in used and any(a in text for a in al)),
            None,
        )
        used |= {hit} - {None}
        out.append(hit)
    return out


HEADER_LISTS = [
    ["Plot", "Tree tag", "Census-Year", "prev_yr", "Status", "DBH (cm)", "Species"],
    ["site", "plot", "plot id", "tree id", "id", "individual", "yr", "year"],
    ["prev_yr", "yr", "survey year", "prev-yr"],
    ["id", "id", "id", "nothing", "D-BH", "sp", "spp"],
    ["species status", "status", "state id", "site state", "fate"],
    ["a", "b"],
]


def test_suggestions_match_brute_force(spark):
    mixed = [list(p) for p in itertools.islice(itertools.permutations(
        ["plot id", "tree", "prevyr", "state id", "d130 sp", "year", "taxon"]), 0, 5040, 97)]
    crowded = [["id"] * 30 + ["plot id"] * 12 + ["site year"] * 9 + ["sp id yr"] * 20]
    lists = HEADER_LISTS + mixed + crowded
    rows = [(f"d{i}", j, h) for i, names in enumerate(lists) for j, h in enumerate(names)]
    df = spark.createDataFrame(rows, "dsn string, ordinal int, header string")
    got = {(r.dsn, r.ordinal): r.field for r in headers.suggest_fields(df).collect()}
    want = {(f"d{i}", j): f for i, names in enumerate(lists) for j, f in enumerate(greedy(names))}
    assert got == want


def test_wide_columns_end_in_a_year(spark):
    rows = [("d", i, h) for i, h in enumerate(["DBH_1994", "DBH 1997", "1994_x", "d199", "d1994\n"])]
    got = headers.detect_wide(spark.createDataFrame(rows, "dsn string, ordinal int, header string"))
    assert {r.header: r.year for r in got.collect()} == {"DBH_1994": 1994, "DBH 1997": 1997}


def test_years_in_float_text_keep_their_censuses(spark):
    from stemledger.schema import conform

    texts = ["2000.0", "2005", " 2010.0 ", "2.015e3", "2010.5", "x", None]
    df = spark.createDataFrame([(t,) for t in texts], "YR string")
    assert [r.YR for r in conform(df).collect()] == [2000, 2005, 2010, 2015, None, None, None]


def test_year_of_takes_whole_years_only(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from stemledger.functions.values import year_of

    texts = ["2010-05-12", "12/05/2010", "12052010", "36526", "in 1999, 2004", "2010-05-12 10:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r.y for r in df.select(year_of(F.col("v"), T.StringType()).alias("y")).collect()]
    assert got == [2010, 2010, None, None, 1999, 2010, None]


def test_lookup_keys_of_different_number_types_meet(spark):
    main = spark.createDataFrame([(1, "1.0"), (2, "x"), (9007199254740993, "2")], "k long, t string")
    table = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "id double, v double")
    by_number = mapping.join_lookups(main, [mapping.Lookup(table, "k", "id", "v", "PA")])
    assert {r.k: r.PA for r in by_number.collect()} == {1: 10.0, 2: 20.0, 9007199254740993: None}
    by_text = mapping.join_lookups(main, [mapping.Lookup(table, "t", "id", "v", "PA")])
    assert {r.t: r.PA for r in by_text.collect()} == {"1.0": 10.0, "x": None, "2": 20.0}


def test_thousands_of_codes(spark):
    codes = [mapping.StatusCode(f"c{i}", str(i % 3)) for i in range(5000)]
    df = spark.createDataFrame([("c4999",), ("other",), (None,)], "Status string")
    assert [r.Status for r in mapping.remap_status(df, codes).collect()] == ["1", "other", None]
    assert [r.Status for r in mapping.remap_status_or_missing(df, codes).collect()] == ["1", "9", "9"]


def test_country_codes_are_the_fixed_ones():
    from stemledger.functions.countries import COUNTRY_CODES

    assert len(COUNTRY_CODES) == 154
    assert [COUNTRY_CODES[c] for c in ("Afghanistan", "Germany", "Peru", "Zimbabwe")] == ["AFG", "DEU", "PER", "ZWE"]


def test_unreadable_years_are_set_aside_and_never_merged(spark):
    from stemledger.plans import harmonize as plans
    from stemledger.plans.submission import Submission
    from stemledger.schema import YEAR

    rows = [("P", "T", y, d) for y, d in [("n.d.", "1"), ("unknown", "2"), ("19 99x", "3"), ("2001", "ca. 4"), (None, "5"), ("2002.0", "na")]]
    raw = spark.createDataFrame(rows, "PlotID string, TreeID string, YR string, DBH string")
    exprs = [mapping.Column(c, c) for c in raw.columns]
    work = plans.harmonize(raw, Submission("in_x_y_2000_m", exprs), disappeared="none")
    assert sorted(r._unread[YEAR] for r in work.quarantined().collect()) == ["19 99x", "n.d.", "unknown"]
    assert {r.YR for r in work.prepared.collect()} == {None, 2001, 2002}
    found = {r.rule: (r.severity, r.row_count) for r in work.findings().collect()}
    assert found["UnreadableYear"] == ("RequiresInput", 3)
    assert found["UnreadableValue"] == ("AutoRecode", 1)


def test_typed_tables_have_nothing_unreadable(spark):
    from stemledger.schema import readable_rows, unread_rows

    df = spark.createDataFrame([("P", "T", 2001, 1.0)], "PlotID string, TreeID string, YR int, DBH double")
    assert readable_rows(df) is df
    assert unread_rows(df).count() == 0


def test_texts_that_begin_no_number_are_not_cast(spark):
    """A failing cast raises an error in every row; what a cast would take is still read."""
    df = spark.createDataFrame([(t,) for t in ("ca. 12", "unknown", " \t+1995 ", "\x001995.0", ".5", "-Infinity", "x")], "t string")
    t = F.col("t")
    got = df.select(parsed_double(t).alias("d"), parsed_integer(t, T.IntegerType()).alias("i"))
    assert [(r.d, r.i) for r in got.collect()] == [
        (None, None), (None, None), (1995.0, 1995), (1995.0, 1995), (0.5, None), (float("-inf"), None), (None, None),
    ]
    assert "iInN" in got._jdf.queryExecution().optimizedPlan().toString()
