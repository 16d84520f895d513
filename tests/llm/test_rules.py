"""Quality rules: measurements by brute force and SQL, policies and ablations from the stored bits alone."""

import re

import compare
import pytest
from hypothesis import given
from hypothesis import strategies as st

from stemledger.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    count = lambda p: len(re.findall(p, text))
    return (
        len(words), sum(map(len, words)), count(r"[#*$%&|<>]"), dup, len(covered), len(lines),
        count("[0-9]"), count("[A-Z]"), count("[a-z]"),
    )


@given(st.text(alphabet="ab A\n\t#|1é\x0b\x85 😀", max_size=80))
def test_measurements_of_any_text(text):
    assert rules.measure(text) == brute(text)


EDGES = ["", " \n\t", "one", "a b c a b c", "a a a a", "é\x85é é", "x\ny\nx\n \n x\nx", "#" * 9, "w " * 70000, "z" * 100000]


@pytest.mark.parametrize("text", EDGES)
def test_measurements_of_odd_texts(text):
    want = brute(text) if len(text) < 1000 else None
    got = rules.measure(text)
    assert want is None or got == want
    assert got[0] == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "v9") for i, t in rows], "doc_id long, text string, failed long, policy string")


def test_nulls_ids_repeats_and_clashing_columns(spark):
    rows = [(2**53 + 1, "a b c"), (None, "a b c"), (1, None), (1, None), (3, "")]
    got = rules.ledger(docs(spark, rows)).select("doc_id", *rules.MEASURES).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert rules.ledger(docs(spark, [])).count() == 0


def test_policies_read_only_bits(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good), (2, "short"), (3, good + " ###########"), (4, good.upper() + " $$$$$$$$$$"), (5, good.upper())]
    kept = {}
    ledger = rules.ledger(docs(spark, rows)).select("doc_id", "failed", "n_words")
    for version, policy in rules.POLICIES.items():
        out = rules.apply_policy(ledger, policy)
        assert {r["policy"] for r in out.collect()} == {version}
        kept[version] = {r["doc_id"] for r in out.collect() if r["kept"]}
    assert kept == {"base": {1, 3, 4, 5}, "v1": {1}, "v2": {1, 3, 5}}


def test_ablations_equal_policies_without_the_rule(spark):
    ledger = queries.table(spark, compare.DATA, "documents").transform(rules.ledger).select("doc_id", "failed", "n_words").cache()
    everything = [(r["failed"], r["n_words"]) for r in ledger.collect()]
    for policy in rules.POLICIES.values():
        def keeps(bits, without=0, policy=policy):
            bits &= ~without
            return not bits & policy.required and (bits & policy.counted).bit_count() <= policy.tolerated

        want = {}
        for rule in rules.RULES:
            bit = rules.BIT[rule.name]
            if bit & (policy.required | policy.counted):
                spared = [w for f, w in everything if f & bit and not keeps(f) and keeps(f, bit)]
                alone = sum(f & (policy.required | policy.counted) == bit and not keeps(f) for f, _ in everything)
                failing = [w for f, w in everything if f & bit]
                want[rule.name] = (len(failing), sum(failing), len(spared), sum(spared), alone)
        got = {r["rule"]: tuple(r)[1:] for r in rules.ablations(ledger, policy).collect()}
        assert got == want
    ledger.unpersist()


def test_query_matches_sql(spark):
    df = queries.QUERIES["op12_quality"](spark, compare.DATA)
    con, sql = compare.duck(compare.DATA), queries.ORACLES["op12_quality"]
    assert compare.spark_rows(df) == compare.duck_rows(con, sql)
    assert compare.types_differ(df, con, sql) == {}
