"""Hand-computed cases for order, links, status derivation and added rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stemledger.operators import census, status

SCHEMA = "dsn string, PlotID string, TreeID string, YR int, DBH double"
YEARS = (2000, 2005, 2010)
TREES = {
    "A": (10.0, 11.0, 12.0),
    "B": (None, 5.0, 6.0),
    "C": (10.0, None, 12.0),
    "D": (10.0, None, None),
    "E": (None, None, None),
    "F": (10.0, 11.0),
}
EXPECTED = {"A": "000", "B": "920", "C": "090", "D": "011", "E": "999", "F": "00"}


def plot(spark, dsn="d", trees=TREES):
    rows = [
        (dsn, "P1", tree, year, dbh)
        for tree, values in trees.items()
        for year, dbh in zip(YEARS, values)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def by_tree(df, value="Status"):
    rows = sorted(df.collect(), key=lambda r: (r.TreeID, r.YR))
    return {t: [r[value] for r in g] for t, g in itertools.groupby(rows, key=lambda r: r.TreeID)}


def test_derived_status_by_tree(spark):
    derived = status.derive_status(census.prepare(plot(spark)))
    assert {t: "".join(s) for t, s in by_tree(derived).items()} == EXPECTED
    assert set(derived.columns) == {*plot(spark).columns, "PrevYR", "Status"}


@pytest.mark.parametrize("treatment,added", [("dead", "1"), ("missing", "9")])
def test_disappeared_tree_gets_a_linked_row(spark, treatment, added):
    full = status.derive_full(census.prepare(plot(spark)), treatment)
    assert {t: "".join(s) for t, s in by_tree(full).items()} == {**EXPECTED, "F": "00" + added}
    row = full.where("TreeID = 'F' AND YR = 2010").first()
    assert (row.PrevYR, row.DBH) == (2005, None)


def test_other_treatment_adds_nothing(spark):
    assert status.derive_full(census.prepare(plot(spark)), "none").count() == 17


def test_deriving_again_changes_nothing(spark):
    first = status.derive_full(census.prepare(plot(spark)), "dead")
    again = status.derive_full(census.prepare(first), "dead")
    assert sorted(first.collect()) == sorted(again.select(first.columns).collect())


def test_summary_counts_first_census_rows_whatever_their_status(spark):
    row = status.derive_summary(census.prepare(plot(spark))).first()
    # Six rows of the year 2000; two of them have no diameter and so count as missing too.
    assert row.asDict() == {
        "dsn": "d", "first_census": 6, "recruit": 1, "subsequent_alive": 3, "dead": 2,
        "missing": 5, "disappeared_trees": 1,
    }


def test_plot_start_is_per_plot_and_last_year_per_dataset(spark):
    late = [("d", "P2", "A", 2005, 9.0), ("e", "P1", "A", 2005, 9.0)]
    df = plot(spark, trees={"A": (1.0, 1.0, 1.0)}).unionByName(spark.createDataFrame(late, SCHEMA))
    derived = status.derive_full(census.prepare(df), "dead")
    got = {(r.dsn, r.PlotID, r.YR): r.Status for r in derived.collect()}
    assert got[("d", "P2", 2005)] == "0" and got[("d", "P2", 2010)] == "1"
    assert ("e", "P1", 2010) not in got and got[("e", "P1", 2005)] == "0"


def test_one_dataset_needs_no_dataset_key(spark):
    rows = plot(spark).drop("dsn")
    prepared = census.prepare(rows, by=())
    full = status.derive_full(prepared, "dead", by=())
    assert {t: "".join(s) for t, s in by_tree(full).items()} == {**EXPECTED, "F": "001"}
    text = full._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert status.derive_summary(prepared, by=()).first().disappeared_trees == 1
    assert [r.TreeID for r in status.disappeared_trees(rows, by=()).collect()] == ["F"]
    assert status.disappeared_rows(prepared, "missing", by=()).first().YR == 2010


def test_null_plot_is_a_group_of_its_own(spark):
    rows = [("d", None, "A", 2000, 1.0), ("d", None, "B", 2005, 2.0)]
    derived = status.derive_status(census.prepare(spark.createDataFrame(rows, SCHEMA)))
    assert {r.TreeID: r.Status for r in derived.collect()} == {"A": "0", "B": "2"}


def test_dbh_texts_count_as_unmeasured(spark):
    rows = [("d", "P", "A", 2000, "NA"), ("d", "P", "A", 2005, "4.5"), ("d", "P", "A", 2010, ".")]
    df = spark.createDataFrame(rows, SCHEMA.replace("DBH double", "DBH string"))
    derived = status.derive_status(census.prepare(df))
    assert by_tree(derived)["A"] == ["9", "2", "1"]


def test_dedup_keeps_the_first_and_is_idempotent(spark):
    rows = [("d", "P", "A", 2000, v) for v in (3.0, 1.0, 2.0)] + [("d", "P", "A", 2001, 9.0)]
    once = census.dedup_first(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.DBH for r in once.collect()) == [1.0, 9.0]
    assert sorted(census.dedup_first(once).collect()) == sorted(once.collect())


def test_dedup_is_cut_before_the_shuffle(spark):
    plan = census.dedup_first(plot(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_tree_windows_share_one_exchange(spark):
    linked = census.previous_year(plot(spark))
    assert exchanges(linked) == 1
    assert exchanges(census.with_valid_span(census.with_tree_span(linked))) == 1


def test_single_census_is_not_linked(spark):
    assert "PrevYR" not in census.prepare(plot(spark), "single").columns


def test_previous_year_skips_gaps(spark):
    rows = [("d", "P", "A", y, 1.0) for y in (2010, 2000, 2003)]
    linked = census.prepare(spark.createDataFrame(rows, SCHEMA))
    assert {r.YR: r.PrevYR for r in linked.collect()} == {2000: None, 2003: 2000, 2010: 2003}


def test_sort_keeps_every_copy_in_order(spark):
    hot = spark.range(100).select(
        F.lit("d").alias("dsn"), F.lit("P").alias("PlotID"), F.lit("T").alias("TreeID"),
        F.lit(2000).alias("YR"), F.lit(1.0).alias("DBH"),
    )
    rest = spark.range(50).select(
        F.lit("d").alias("dsn"), F.lit("P").alias("PlotID"),
        F.concat(F.lit("S"), F.col("id").cast("string")).alias("TreeID"),
        F.lit(2000).alias("YR"), F.lit(None).cast("double").alias("DBH"),
    )
    got = census.census_sort(hot.unionByName(rest)).collect()
    assert len(got) == 150
    assert [r.TreeID for r in got] == sorted(r.TreeID for r in got)
    assert sum(r.TreeID == "T" for r in got) == 100


def test_sort_has_one_exchange_and_spreads_exact_copies(spark):
    hot = spark.range(40_000).select(
        F.lit("d").alias("dsn"), F.lit("P").alias("PlotID"), F.lit("T").alias("TreeID"), F.lit(2000).alias("YR"),
        F.lit(-0.0).alias("DBH"), F.create_map(F.lit("k"), F.lit("v")).alias("m"),
    )
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ordered = census.census_sort(hot)
        assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        parts = ordered.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert len(parts) > 3 and sum(r["count"] for r in parts) == 40_000
    assert ordered.where("CAST(DBH AS STRING) = '-0.0' AND m['k'] = 'v'").count() == 40_000


def test_hot_tree_and_hot_plot_give_the_same_statuses(spark):
    """A third of the rows are copies of one measurement, and one plot holds most trees."""
    copies = spark.range(6000).select(
        F.lit("d").alias("dsn"), F.lit("P1").alias("PlotID"), F.lit("A").alias("TreeID"),
        F.lit(2000).alias("YR"), F.lit(10.0).alias("DBH"),
    )
    others = spark.range(12000).select(
        F.lit("d").alias("dsn"), F.lit("P1").alias("PlotID"),
        F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")).alias("TreeID"),
        (F.lit(2000) + 5 * (F.col("id") / 4000).cast("int")).cast("int").alias("YR"),
        F.lit(3.0).alias("DBH"),
    )
    derived = status.derive_status(census.prepare(plot(spark).unionByName(copies).unionByName(others)))
    assert derived.count() == 17 + 12000
    named = derived.where(F.col("TreeID").isin(*TREES))
    assert {t: "".join(s) for t, s in by_tree(named).items()} == EXPECTED


def brute_force(rows, treatment):
    """The census rules on plain lists, one dataset and tree at a time."""
    first = {}
    for dsn, plot_id, tree, year, dbh in sorted(rows, key=lambda r: (r[:4], r[4] is not None, r[4])):
        first.setdefault((dsn, plot_id, tree, year), dbh)
    plot_first, dataset_last, trees = {}, {}, {}
    for (dsn, plot_id, tree, year), dbh in first.items():
        plot_first[dsn, plot_id] = min(year, plot_first.get((dsn, plot_id), year))
        dataset_last[dsn] = max(year, dataset_last.get(dsn, year))
        trees.setdefault((dsn, plot_id, tree), []).append((year, dbh))
    out = set()
    for (dsn, plot_id, tree), rows_of_tree in trees.items():
        measured = [y for y, dbh in rows_of_tree if dbh is not None]
        previous = None
        for year, dbh in rows_of_tree:
            if measured and year == measured[0] > plot_first[dsn, plot_id]:
                code = "2"
            elif dbh is None:
                code = "1" if measured and year > measured[-1] else "9"
            else:
                code = "0"
            out.add((dsn, plot_id, tree, year, previous, dbh, code))
            previous = year
        if treatment and previous < dataset_last[dsn]:
            out.add((dsn, plot_id, tree, dataset_last[dsn], previous, None, treatment))
    return out


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_censuses_match_brute_force(spark, seed, threshold):
    """With small tables broadcast, and with every join sort-merged."""
    rng = random.Random(seed)
    rows = [
        (f"d{rng.randrange(3)}", f"P{rng.randrange(4)}", f"T{rng.randrange(60)}",
         2000 + 5 * rng.randrange(5), rng.choice([None, None, 1.0, 2.0, 3.0]))
        for _ in range(1500)
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        mapped = spark.createDataFrame(rows, SCHEMA)
        full = status.derive_full(census.prepare(mapped), "dead", years_from=mapped)
        got = full.select(*SCHEMA.replace(" string", "").replace(" int", "").split(", ")[:4], "PrevYR", "DBH", "Status")
        result = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(result) == len(set(result))
    assert set(result) == brute_force(rows, "1")


SKEW_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
}


def test_a_hot_plot_is_split_when_plots_are_too_many_to_broadcast(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW_SETTINGS}
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        df = spark.range(200000, numPartitions=8).selectExpr(
            "concat('d', id % 500 % 7) AS dsn", "concat('P', id % 500) AS PlotID",
            "concat('T', id % 60000) AS TreeID", "CAST(2000 + id % 5 AS INT) AS YR",
            "IF(id % 7 = 0, NULL, DOUBLE(id)) AS DBH",
        )
        hot = (F.substring("TreeID", 2, 9).cast("int") % 3) == 0
        df = df.withColumns(
            {"PlotID": F.when(hot, "HOT").otherwise(F.col("PlotID")),
             "dsn": F.when(hot, "d0").otherwise(F.col("dsn"))}
        )
        full = status.derive_full(census.prepare(df), "dead", years_from=df)
        assert full.groupBy().count().first()[0] > 0
        full.collect()
        plan = full._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in plan.split("Initial Plan")[0]


def random_rows(seed, n=400):
    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    return [
        (pick("a", "b", "c"), pick("P", "Q", "R", None), pick(*"TUVWX", None), pick(2000, 2001, 2005, 2009, None), pick(1.0, 2.0, None, float("nan")), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("treatment", ["dead", "missing", "none"])
def test_markers_give_the_same_rows_as_the_plot_join(spark, seed, treatment):
    df = spark.createDataFrame(random_rows(seed), f"{SCHEMA}, payload long").where("dsn <> 'c' or YR <> 2009")
    kinds = spark.createDataFrame([("b", "single")], "dsn string, census_type string")
    typed = census.with_census_type(df, kinds).withColumn("Status", F.lit("5"))
    kind, where = F.col("census_type"), F.col("dsn") != "c"
    joined = status.derive_full(census.prepare(df, tie_break=["payload"]), treatment, years_from=df)
    marked = status.prepare_and_derive(df, treatment, ["payload"])
    rows = lambda d: sorted((tuple(str(v) for v in r) for r in d.select(sorted(d.columns)).collect()))
    assert rows(marked) == rows(joined)
    joined = status.derive_full(
        census.prepare(typed, kind, ["payload"]), treatment, years_from=typed, census_type=kind, where=where
    )
    assert rows(status.prepare_and_derive(typed, treatment, ["payload"], census_type=kind, where=where)) == rows(joined)


def test_wide_rows_move_twice_when_plots_cannot_be_broadcast(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/wide"
    df = spark.createDataFrame(random_rows(3), f"{SCHEMA}, payload long")
    df.write.mode("overwrite").parquet(path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        full = status.prepare_and_derive(spark.read.parquet(path), "dead", ["payload"])
        text = full._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        blocks = [b for b in text.split("\n\n") if ") Exchange" in b.strip().split("\n")[0]]
        assert sum("payload" in b for b in blocks) == 2
        assert full.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
