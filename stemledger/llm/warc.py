"""WARC archives, written and read back as Spark text with the format's own separators.

Reading verifies the chain of record boundaries: the text source splits archives at every occurrence of the version line,
so each task emits candidate records and, from the stated length, the offset at which the next one must begin.
Pointer jumping from the start of each archive keeps the candidates that the chain reaches; the others are
occurrences inside a payload and go back into the record that holds them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemledger.llm.shared import staged

#: Fixed by the format.
MAGIC = "WARC/1.1\r\n"
HEAD_END = "\r\n\r\n"
RECORD_END = "\r\n\r\n"
#: Bits of the bitmap that tells payloads with copies.
BITMAP = 1 << 24
#: Written into every record unless the caller gives another.
DATE = "2000-01-01T00:00:00Z"


def decide(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The pages with payload (null: empty), its bytes and digest, and what kind of record each becomes.

    Of pages with equal payloads of at least ``least_bytes``, the one with the largest id is the response
    and the others revisit it. Ids of copies are compared by a combined maximum, so a payload may have any number of copies.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha1(F.col("payload").cast("binary"))
    )
    # small payloads are never compared: null keys join nothing
    key = F.when(F.col("payload_bytes") >= least_bytes, F.sha2(F.col("payload").cast("binary"), 256))
    rows = rows.withColumn("same", key)
    kept = rows.filter("same is not null").groupBy("same").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    kept = staged(kept.filter("n > 1 and kept is not null").drop("n"), "warc-copies")
    # payloads without copies, all but a few, stay where they are
    met = _with_likely(rows, kept)
    alone = met.filter(~F.col("likely")).withColumn("kept", F.lit(None).cast("long"))
    out = met.filter("likely").join(kept, "same", "left").select(alone.columns).union(alone).drop("same", "likely")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept"))
    return out.withColumn("refers_to", refers).drop("kept")


def _with_likely(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with ``likely``, false only where ``same`` is no key of ``members``: a bitmap of fixed size tells."""
    at = F.pmod(F.xxhash64("same"), F.lit(BITMAP))
    bits = members.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )  # BITMAP bits in all
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)) & F.col("same").isNotNull()
    met = rows.withColumn("part", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "part", "left")
    return met.withColumn("likely", bit).drop("part", "bits")


def write(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = DATE, records_per_file: int = 50_000) -> None:
    """Write a record per page to archives under ``path``; revisits carry no payload."""
    rows = decide(pages, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null without a value
    head = F.concat_ws(
        "\r\n",
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\p{Cntrl}]", "")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    records = rows.select(F.concat(F.lit(MAGIC), head, F.lit(HEAD_END), body).alias("value"))
    # the text writer's line end is the format's record end
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, head, payload, broken) per record that the chain reaches from the start of its archive.

    ``broken`` is true where a chain stops before the archive's end: the record there has no sound length
    or successor; it is returned as far as it goes. An empty folder of archives gives no rows.
    """
    chunks = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("nth"),
            "value",
        )
    )
    # numbers hold for one reading only: another may split the files elsewhere
    chunks = staged(chunks, "warc-chunks", "zstd")
    head = F.substring_index("value", HEAD_END, 1)
    split = chunks.withColumn("head", F.when(F.col("value").contains(HEAD_END), head))
    stated = F.regexp_extract(F.concat(F.lit("\r\n"), "head", F.lit("\r\n")), r"(?i)\r\nContent-Length: *([0-9]{1,18})\r\n", 1)
    narrow = split.select(
        "file",
        "block",
        "nth",
        F.octet_length("value").cast("long").alias("bytes"),
        F.coalesce(
            F.octet_length("head") + len(HEAD_END) + stated.try_cast("long") + len(RECORD_END), F.lit(-1)
        ).cast("long").alias("claims"),
    )
    # chunks that are not exactly one whole record: few in sound archives, of any number in others
    odd = staged(
        narrow.groupBy("file").applyInPandas(
            _chain, "file string, nth long, record long, broken boolean"
        ),
        "warc-odd",
    )
    keys = ["file", "nth"]
    whole = split.join(odd.select(*keys), keys, "left_anti").select("file", "head", "value", F.lit(False).alias("broken"))
    parts = split.join(odd.filter("record >= 0"), keys)
    joined = parts.groupBy("file", "record").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), MAGIC
        ).alias("value"),
        F.bool_or("broken").alias("broken"),
    )
    joined = joined.select("file", F.substring_index("value", HEAD_END, 1).alias("head"), "value", "broken")
    out = whole.filter("head is not null").unionByName(joined)
    size = F.length("value") - F.length("head") - len(HEAD_END) - F.when(F.col("broken"), 0).otherwise(len(RECORD_END))
    payload = F.substring(F.col("value"), F.length("head") + len(HEAD_END) + 1, F.greatest(size, F.lit(0)))
    return out.select("file", "head", payload.alias("payload"), "broken")


def _chain(group: pd.DataFrame) -> pd.DataFrame:
    """Chunks of one archive that are not records of their own, with the record they belong to (-1: none)."""
    group = group.sort_values(["block", "nth"])
    length, claims = group["bytes"].to_numpy(), group["claims"].to_numpy()
    n, magic = len(group), len(MAGIC)
    # chunk 0 is what stands before the first version line; chunk i > 0 has one before it
    start = np.concatenate([[0], np.cumsum(length[:-1] + magic)])
    start[1:] -= magic
    end = start[-1] + (magic if n > 1 else 0) + length[-1]
    next_at = np.where(claims >= 0, start + magic + claims, -1)
    place = np.searchsorted(start[1:], next_at) + 1  # index of the chunk that begins there
    sound = (next_at >= 0) & (place < n)
    sound[sound] = start[place[sound]] == next_at[sound]
    jump = np.where(sound, place, np.arange(n))  # a chain that cannot go on stays where it is
    reached = np.zeros(n, dtype=bool)
    if n > 1 and length[0] == 0:
        reached[1] = True
    step = jump.copy()
    while True:
        more = reached.copy()
        more[step[reached]] = True
        if (more == reached).all():
            break
        reached, step = more, step[step]
    record = np.maximum.accumulate(np.where(reached, np.arange(n), -1))
    last = ~sound & reached & (next_at != end)
    nth = group["nth"].to_numpy()
    whole = reached & ~last & (np.append(record[1:] != record[:-1], True))
    broken = np.where(record >= 0, last[np.maximum(record, 0)], True)
    return pd.DataFrame(
        {
            "file": group["file"],
            "nth": nth,
            "record": np.where(record >= 0, nth[np.maximum(record, 0)], -1),
            "broken": broken,
        }
    )[~whole]


def field(name: str) -> Column:
    """A header field of a record's ``head``, or null."""
    text = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")), rf"(?i)\r\n{name}: *([^\r\n]*)\r\n", 1)
    return F.nullif(text, F.lit(""))


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: payload bytes and digest, record type, and the response a revisit refers to.

    Extra columns of the archives' pages are not looked at, empty archives give no rows, and payloads of any length are read whole.
    Bytes and digest are those of the payload as read back; a revisit takes them from its response. Nulls: a null page
    is an empty payload, a null page id stays null and is never referred to. Repeated rows are records of their own.
    """
    number = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    records = read(spark, path).select(
        number("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("own_bytes"),
        F.sha1(F.col("payload").cast("binary")).alias("own_digest"),
    )
    records = staged(records, "warc-records")  # narrow; payloads are not read again
    # repeated rows of a response are alike, so one of them stands for all
    responses = records.filter("record_type = 'response' and page_id is not null").groupBy("page_id").agg(
        F.max(F.struct("own_bytes", "own_digest")).alias("full")
    )
    revisits = records.filter("record_type = 'revisit'").join(
        responses.withColumnRenamed("page_id", "refers_to"), "refers_to", "left"
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    out = records.filter("record_type = 'response'").select(
        "page_id",
        F.col("own_bytes").alias("payload_bytes"),
        F.col("own_digest").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    more = revisits.withColumn("payload_bytes", F.col("full.own_bytes")).withColumn(
        "payload_digest", F.col("full.own_digest")
    )
    return out.unionByName(more.select(*columns))
