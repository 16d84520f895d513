"""Secrets in texts, with column functions only: a trigram index narrows which text each rule is tried on.

From each rule's pattern a Boolean query is derived: every clause must hold, a clause holds if all trigrams of one of
its alternatives occur. The inverted index holds, for the trigrams that some query needs, the rows whose lower-cased text has
them; postings are intersected by counting, and only candidates are verified with the pattern itself.
Rules whose pattern has no trigram that must occur are tried on every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length decides
    least: int = 0  # characters it needs; shorter matches are dropped, and not tried again


#: Order of the kinds; the first three are the base kinds.
RULES = (
    Rule(
        "assign",
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        8,
    ),
    # a run matches from its start or not at all, so the least length can stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
BASE = RULES[:3]
#: Literal strings that one stretch of a pattern may expand to.
MOST_LITERALS = 32

Clause = tuple[frozenset[str], ...]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses of trigrams of the lower-cased text without which ``pattern`` cannot match; none if there are none."""
    clauses: list[Clause] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if run and all(len(s) >= 3 for s in run):
            found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            # an alternative that asks for more than another one adds nothing
            clauses.append(tuple(sorted((a for a in found if not any(b < a for b in found)), key=sorted)))
        run = {""}

    for node in parser.parse(pattern):
        strings = _literals([node])
        if strings is None:
            close()
        elif len(run) * len(strings) <= MOST_LITERALS:
            run = {a + b for a in run for b in strings}
        else:
            close()
            run = strings
    close()
    return clauses


def _literals(nodes: list) -> set[str] | None:
    """All strings that a stretch can match, lower-cased, or None if they are too many."""
    found = {""}
    for kind, value in nodes:
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            strings = {chr(v).lower() for _, v in value}
        elif kind is op.SUBPATTERN:
            strings = _literals(list(value[3]))
        elif kind is op.BRANCH:
            each = [_literals(list(b)) for b in value[1]]
            strings = None if any(s is None for s in each) else set().union(*each)
        elif kind is op.MAX_REPEAT and value[1] is not op.MAXREPEAT and value[1] <= 2:
            inner = _literals(list(value[2]))
            strings = None
            if inner is not None:
                powers, strings = {""}, set()
                for n in range(value[1] + 1):
                    strings |= powers if n >= value[0] else set()
                    powers = {a + b for a in powers for b in inner}
        else:
            return None
        if strings is None or len(found) * len(strings) > MOST_LITERALS:
            return None
        found = {a + b for a in found for b in strings}
    return found


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, kinds): rows whose postings satisfy the queries of these rules."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    wanted = sorted({t for clauses in queries.values() for clause in clauses for alt in clause for t in alt})
    folded = F.lower("text")
    present = F.array_compact(F.array(*(F.when(folded.contains(t), F.lit(t)) for t in wanted)))
    keyed = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    postings = keyed.select("doc_id", "text_hash", F.explode(present).alias("trigram"))
    terms = [
        (kind, c, a, trigram, len(alt), len(clauses))
        for kind, clauses in queries.items()
        for c, clause in enumerate(clauses)
        for a, alt in enumerate(clause)
        for trigram in sorted(alt)
    ]
    columns = "kind string, clause int, alternative int, trigram string, need int, clauses int"
    table = docs.sparkSession.createDataFrame(terms, columns)  # as long as the rules, whatever the data
    row = ["doc_id", "text_hash"]
    met = (
        postings.distinct()
        .join(F.broadcast(table), "trigram")
        .groupBy(*row, "kind", "clause", "alternative", "need", "clauses")
        .count()
        .filter("count = need")
    )
    whole = met.groupBy(*row, "kind", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses")
    return whole.groupBy(*row).agg(F.collect_set("kind").alias("kinds"))  # as many kinds as rules at most


def _spans(rule: Rule, order: int) -> Column:
    """Matches of ``rule`` in the text as (start, kind order, kind, end); offsets in code points.

    The pieces between the matches give their places.
    """
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    empty = F.array().cast("array<struct<start: int, nth: int, kind: string, end: int, ok: boolean>>")

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        ok = F.length(F.regexp_extract(x["1"], rule.pattern, rule.group)) >= rule.least
        one = F.struct(
            start.alias("start"), F.lit(order).alias("nth"), F.lit(rule.kind).alias("kind"), end.alias("end"), ok.alias("ok")
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(a.alias("0"), b.alias("1")))
    all_found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), add)["found"]
    return F.when(text.rlike(rule.pattern), F.filter(all_found, lambda s: s["ok"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "secrets") -> DataFrame:
    """``docs`` with ``column``, an array of (start, nth, kind, end, ok) by start and then rule.

    A null or empty text has none. A repeated row is scanned for itself; very long texts are scanned whole.
    Extra columns stay as they are, except for one named like ``column``, which is replaced. Empty tables stay empty.
    """
    full = [r for r in rules if not trigram_query(r.pattern)]
    indexed = [r for r in rules if trigram_query(r.pattern)]
    keys = candidates(docs, tuple(indexed)).select(
        F.col("doc_id").alias("_key_id"), F.col("text_hash").alias("_key_hash"), F.col("kinds").alias("_kinds")
    )
    rows = docs.drop(column).withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(
        keys, F.col("doc_id").eqNullSafe(F.col("_key_id")) & (F.col("_hash") == F.col("_key_hash")), "left"
    )
    empty = F.array().cast("array<struct<start: int, nth: int, kind: string, end: int, ok: boolean>>")
    parts = []
    for order, rule in enumerate(rules):
        found = _spans(rule, order)
        parts.append(found if rule in full else F.when(F.array_contains("_kinds", rule.kind), found).otherwise(empty))
    spans = F.when(F.col("text").isNull(), empty).otherwise(F.array_sort(F.concat(*parts)))
    return rows.withColumn(column, spans).drop("_hash", "_key_id", "_key_hash", "_kinds")


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced; overlapping spans become one."""
    found = scan(docs, column="_secrets")

    def keep(state: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        piece = F.when(s["start"] >= state["at"], F.concat(gap, F.lit(mask))).otherwise(F.lit(""))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["text"], piece).alias("text")
        )

    done = F.aggregate("_secrets", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), keep)
    rest = F.concat(done["text"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    text = F.when(F.size("_secrets") > 0, rest).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("_secrets")


def digest(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the secrets of ``scan`` per document."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("secrets", lambda s: s["nth"] < len(BASE))


    def counted(nth: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["nth"] == nth)).cast("long")

    counts = [counted(nth).alias(f"n_{rule.kind}") for nth, rule in enumerate(RULES)]
    return scan(docs).select(
        "doc_id",
        *counts,
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", name), ",").alias("spans"),
    )
