import hashlib

from helpers import rows_of
from stemledger.llm import warc

PAGES = "page_id long, url string, html string, digest string, kept long"


def pages(spark, payloads):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nX: y", p, "d", 1) for i, p in payloads], PAGES)


def expected(payloads):
    out = []
    for i, p in payloads:
        b = (p or "").encode()
        top = max((j for j, q in payloads if q == p and j is not None), default=None)
        refers = top if len(b) >= 1000 and top is not None and top != i else None
        kind = "response" if refers is None else "revisit"
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, refers))
    return sorted(out, key=str)


def test_round_trip_with_records_inside_payloads(spark, folder):
    fake = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 700
    given = [
        (0, "a"), (1, None), (2, ""), (3, fake), (4, fake * 50), (5, warc.MAGIC), (6, f"x{warc.MAGIC}y\r\n\r\n"),
        (7, big), (8, big), (9, big), (10, "z" * 999), (11, "z" * 999), (12, "z" * 1000), (13, "z" * 1000),
        (14, "\r\n\r\n" * 400), (15, "q" * 300_000 + fake), (None, big), (16, "same"), (16, "same"), (17, fake * 50),
    ]
    warc.write(pages(spark, given).repartition(3), f"{folder}/a", records_per_file=4)
    got = sorted(rows_of(warc.page_records(spark, f"{folder}/a")), key=str)
    assert got == expected(given)
    payloads = [r["payload"] for r in warc.read(spark, f"{folder}/a").collect()]
    assert payloads.count(fake * 50) == 1 and payloads.count(fake) == 1
    assert not any(r["broken"] for r in warc.read(spark, f"{folder}/a").collect())


def test_splits_and_broken_chain(spark, folder):
    given = [(i, f"{i} " * (i % 90)) for i in range(400)]
    warc.write(pages(spark, given).coalesce(1), f"{folder}/b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert sorted(rows_of(warc.page_records(spark, f"{folder}/b")), key=str) == expected(given)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    text = f"{warc.MAGIC}A: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n{warc.MAGIC}Content-Length: 9\r\n\r\nab\r\n\r\n{warc.MAGIC}x"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n\n\n").text(f"{folder}/c")
    rows = warc.read(spark, f"{folder}/c").collect()
    assert sorted(r["broken"] for r in rows) == [False, True]


def test_empty_table(spark, folder):
    warc.write(pages(spark, []), f"{folder}/d")
    assert warc.page_records(spark, f"{folder}/d").count() == 0
