"""Header findings from lists of headers, one or several rows per dataset."""

from stemledger.operators import headers

SCHEMA = "dsn string, headers array<string>"
ODD = [
    ("once", ["b", "a", "b", "", "column_1", "b", ""]),
    ("clean", ["a", "b", "c"]),
    ("nulls", [None, "x", None, None]),
    ("one null", [None]),
    ("none", []),
    ("null list", None),
    ("blank", [""]),
    ("case", ["A", "a", "COLUMN_1"]),
    ("split", ["a", "b", "column_"]),
    ("split", ["a", "c", "column_"]),
    ("split", None),
    (None, ["a", ""]),
    (None, ["a"]),
]


def rows(df):
    return sorted((tuple(r) for r in df.select("dsn", "problem", "header", "n").collect()), key=repr)


def test_lists_give_the_findings_of_their_catalogue(spark):
    lists = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    long = spark.createDataFrame([(dsn, i, h) for dsn, hs in ODD for i, h in enumerate(hs or [])], "dsn string, ordinal int, header string")
    found = headers.header_list_findings(lists)
    assert rows(found) == rows(headers.header_findings(long))
    assert found.schema["n"].dataType == headers.header_findings(long).schema["n"].dataType
    assert ("split", "duplicate_header", "a", 1) in rows(found)
    assert (None, "duplicate_header", "a", 1) in rows(found)
    assert rows(headers.header_list_findings(lists.where("false"))) == []


def test_more_split_datasets_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr("stemledger.operators.joins.FEW_GROUPS", 2)
    given = [(f"d{i}", [f"h{j}" for j in range(3)]) for i in range(9) for _ in range(1 + i % 2)]
    found = headers.header_list_findings(spark.createDataFrame(given, SCHEMA))
    assert rows(found) == sorted((f"d{i}", "duplicate_header", f"h{j}", 1) for i in range(1, 9, 2) for j in range(3))


def test_headers_of_a_list_are_judged_without_a_shuffle(spark):
    lists = spark.createDataFrame(ODD[:8], SCHEMA)
    plan = headers._findings_within(lists)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
