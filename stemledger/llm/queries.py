"""Registered queries of the operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.llm import (
    alignment, cosine, langid, mixing, nearsets, packing, pii, repeats, rules, secrets, treesearch, warc, whitening,
)
from stemledger.llm.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


@query
def op5_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine.links(table(spark, sf_dir, "embeddings"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return treesearch.search(rows, rows.filter("vec_id % 20 = 0"))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearsets.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "source",
        F.col("_tokens").alias("n_tokens"),
        F.col("_epoch").alias("epoch"),
        F.col("_block").alias("block"),
        F.col("_order").alias("block_order"),
    )


ORACLES["op7_mixing"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
         CAST(greatest(1, (octet_length(encode(coalesce(text, ''))) + 3) // 4) AS BIGINT) AS n_tokens,
         CAST('0x' || substr(md5('mix|' || doc_id), 1, 15) AS BIGINT) AS place
  FROM documents),
sizes AS (SELECT s, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY s),
shares AS (SELECT s, tokens, tokens / (SELECT sum(tokens) FROM sizes) AS p FROM sizes),
bisect AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT step, lo, hi,
               (SELECT max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) FROM shares) <= 1.25 AS ok
        FROM bisect WHERE step < 30)),
x AS (SELECT hi AS x FROM bisect WHERE step = 30),
weights AS (
  SELECT s, CAST(tokens AS BIGINT) AS tokens,
         CAST(floor(pow(p, x) / (SELECT sum(pow(p, x)) FROM shares, x) * (SELECT sum(tokens) FROM sizes) + 0.5) AS BIGINT) AS budget
  FROM shares, x),
plan AS (
  SELECT s, budget // tokens AS times, budget - budget // tokens * tokens AS rest,
         CAST(ceil(tokens / 1000000.0) AS BIGINT) AS n FROM weights),
placed AS (SELECT d.*, p.times, p.rest, d.place % p.n AS block FROM docs d JOIN plan p USING (s)),
blocks AS (
  SELECT s, block, rest, sum(n_tokens) AS size,
         rest - sum(sum(n_tokens)) OVER (
           PARTITION BY s ORDER BY CAST('0x' || substr(md5('mix|' || s || '|' || block), 1, 15) AS BIGINT), block
         ) + sum(n_tokens) AS remains
  FROM placed GROUP BY s, block, rest),
cut AS (
  SELECT d.*, b.remains, b.size,
         sum(d.n_tokens) OVER (PARTITION BY d.s, d.block ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.n_tokens) OVER (PARTITION BY d.s, d.block, d.place) AS own,
         min(d.place) OVER (PARTITION BY d.s, d.block) AS first
  FROM placed d JOIN blocks b USING (s, block)),
counted AS (
  SELECT *, times + CASE WHEN remains >= size OR 2 * (remains - upto + own) >= own
      OR (times = 0 AND remains = rest AND rest > 0 AND place = first) THEN 1 ELSE 0 END AS copies FROM cut)
SELECT doc_id, source, n_tokens, CAST(e.epoch AS BIGINT) AS epoch, block,
       CAST('0x' || substr(md5(concat_ws('|', 'mix', e.epoch, s, block)), 1, 15) AS BIGINT) AS block_order
FROM counted, LATERAL (SELECT unnest(range(copies)) AS epoch) e
"""


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), rules.POLICIES[rules.CURRENT])
    base_failed = F.col("failed").bitwiseAND(F.lit(rules.BASE)) != 0
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return kept.select("doc_id", *base, base_failed.alias("base_failed"), "kept", "failed")


# bits and limits as in rules.RULES, written out
ORACLES["op12_quality"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
runs AS (
  SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER place, lead(word, 2) OVER place) AS run,
         lead(word, 2) OVER place IS NOT NULL AS whole
  FROM words WINDOW place AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs WHERE whole) WHERE n > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
counted_lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_small
  FROM docs d LEFT JOIN counted_lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
ruled AS (
  SELECT *, CAST(
      (n_words < 50)::INT * 1 + (100 * n_repeat_words > 50 * n_words)::INT * 2 + (10 * n_symbols > n_words)::INT * 4
      + (n_dup_lines > 5 AND 10 * n_dup_lines > 3 * n_lines)::INT * 8 + (word_chars < 2 * n_words)::INT * 16
      + (word_chars > 20 * n_words)::INT * 32 + (2 * n_digits > word_chars)::INT * 64 + (n_capitals > n_small)::INT * 128
    AS BIGINT) AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed
FROM ruled
"""


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
