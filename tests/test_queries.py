"""Every registered query against its SQL on the smallest tables, values and types."""

import compare
import pytest

import __spark_entry__ as registry
from stemledger.plans import entries

# those of the library proper; optional parts have tests of their own
QUERIES = {name: registry.queries()[name] for name in entries.QUERIES}
ORACLES = {name: registry.oracle_sql()[name] for name in entries.ORACLES}


@pytest.fixture(scope="module")
def con():
    return compare.duck(compare.DATA)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, compare.DATA)
    assert compare.spark_rows(df) == compare.duck_rows(con, ORACLES[name])
    assert compare.types_differ(df, con, ORACLES[name]) == {}


def test_every_query_has_rows_and_an_oracle(spark):
    assert set(ORACLES) == set(QUERIES)


def test_entry_gives_rows(spark):
    df = registry.entry(spark)
    assert df.columns == ["dsn", "PlotID", "Status", "n_rows"]
    assert not df.isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["scan_parquet"](spark, compare.DATA).where("l_quantity >= 10"))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in text


def test_rules_are_counted_in_hash_aggregates_of_one_scan(spark):
    from stemledger.operators import validate
    from stemledger.plans.entries import prepared_coded

    df = prepared_coded(spark, compare.DATA).select(
        "dsn", "PlotID", "TreeID", "YR", "PrevYR", "Status", "DBH"
    )
    path = f"{spark.conf.get('spark.checkpoint.dir')}/rules"
    df.write.mode("overwrite").parquet(path)
    text = plan(validate.findings(spark.read.parquet(path), check_linkage=True))
    assert text.count("FileScan") == 1
    assert "SortAggregate" not in text and "Window" not in text and "Join" not in text


def test_status_needs_no_broadcast_hint(spark):
    text = QUERIES["derive_full"](spark, compare.DATA)._jdf.queryExecution().analyzed().toString()
    assert "UnresolvedHint" not in text and "ResolvedHint" not in text
