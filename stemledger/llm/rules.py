"""Quality rules as a ledger of bitmasks: every rule is evaluated once, policies and ablations read only the stored bits.

1. ``measured`` takes the measurements of each whole text in one pass.
2. ``ledger`` evaluates every rule of ``RULES`` once on them and stores one bit per failed rule.
3. ``apply_policy`` keeps documents by a versioned policy: a mask of rules that must hold and a mask of rules of which a
   number may fail. Another version needs no text, only the ledger.
4. ``ablations`` counts documents per distinct bitmask (as many as rule sets that occur) and asks, with bitwise operations
   on these, what each rule decides alone and what goes missing without it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols, and the white space between words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTED = (SPACES, SYMBOLS, string.digits.encode(), string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

#: What is measured, all longs.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_capitals", "n_small")


@dataclass(frozen=True)
class Rule:
    """A document fails if the SQL condition over the measurements holds. The place in ``RULES`` is the rule's bit."""

    name: str
    fails: str


#: Only ever appended to, so that stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 5 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("many_digits", "2 * n_digits > word_chars"),
    Rule("mostly_capitals", "n_capitals > n_small"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]


def mask(*names: str) -> int:
    return sum(BIT[name] for name in names)


@dataclass(frozen=True)
class Policy:
    """Documents go that fail a rule of ``required`` or more than ``tolerated`` rules of ``counted``."""

    version: str
    required: int
    counted: int = 0
    tolerated: int = 0


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", BASE | mask("many_symbols", "repeated_lines", "short_words", "long_words", "many_digits", "mostly_capitals")),
        Policy("v2", BASE, mask(*(r.name for r in RULES[2:])), 1),
    )
}
#: Policy of the registered query.
CURRENT = "v1"


def measure(text: str | None) -> tuple[int, ...]:
    """``MEASURES`` of one text. Lines count if they hold a word; a line counts as repeated if an earlier one is the same."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode(errors="surrogatepass")
    words = data.split()  # at exactly the characters of SPACES
    lines = [line for line in data.split(b"\n") if line.strip()]
    spaces, symbols, digits, capitals, small = (len(data) - len(data.translate(None, c)) for c in COUNTED)
    return (
        len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines),
        digits, capitals, small,
    )


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a run of ``window`` words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = dict.fromkeys(words)
    number.update(zip(number, range(len(number))))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
    runs = ids[:n]
    for k in range(1, window):  # runs are numbered anew each time, so that numbers stay small
        runs = runs * len(number) + ids[k : k + n]
        runs = np.unique(runs, return_inverse=True)[1]
    twice = np.bincount(runs)[runs] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int(np.count_nonzero(np.cumsum(edges)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of every document.

    Nulls: a null text counts as empty, with zeros; a null id is kept. Texts of any length are measured whole. Repeated rows
    are each measured. Extra columns are not looked at. An empty table gives no rows.
    """
    ddl = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    out = pa.schema([(name, pa.int64()) for name in ("doc_id", *MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py()) for t in batch.column("text")], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, rows.T)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): each rule's bit is set in ``failed`` where the document fails the rule."""
    bits = [F.when(F.expr(rule.fails), F.lit(BIT[rule.name])).otherwise(F.lit(0)) for rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs).withColumn("failed", failed.cast("long"))


def keeps(policy: Policy, failed: Column) -> Column:
    """Whether a policy keeps a document with these failure bits."""
    kept = failed.bitwiseAND(F.lit(policy.required)) == 0
    return kept & (F.bit_count(failed.bitwiseAND(F.lit(policy.counted))) <= policy.tolerated)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the policy's version; no text is read."""
    return rows.withColumns({"kept": keeps(policy, F.col("failed")), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents and words that fail it, that only it removes (kept again without it), and that it
    removes on its own (kept by a policy without any rule but removed by this one alone).

    Reads one row per distinct bitmask of the ledger, at most two to the number of rules, whatever the corpus.
    """
    masks = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    ruled = [(r.name, BIT[r.name]) for r in RULES if BIT[r.name] & (policy.required | policy.counted)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit")) for n, b in ruled)))
    split = masks.withColumn("r", each).select("failed", "docs", "words", "r.rule", "r.bit")
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    removed = ~keeps(policy, F.col("failed"))
    spared = keeps(policy, F.col("failed").bitwiseAND(F.bitwise_not(F.col("bit"))))
    alone = F.col("failed").bitwiseAND(F.lit(policy.required | policy.counted)) == F.col("bit")

    def count(what: str, condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(what))), F.lit(0)).cast("long").alias(name)

    return split.groupBy("rule").agg(
        count("docs", fails, "docs_failed"),
        count("words", fails, "words_failed"),
        count("docs", fails & removed & spared, "docs_spared_without"),
        count("words", fails & removed & spared, "words_spared_without"),
        count("docs", alone & removed, "docs_removed_alone"),
    )
