import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm.common import fresh_path
from fleetlens.llm.warc import read_warc, warc_round_trip, write_warc

PAGES = "page_id long, url string, html string"
OUT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
MAGIC = "WARC/1.0\r\n"


def brute(data, min_bytes=1000):
    best = {}
    for i, _, html in data:
        body = (html or "").encode()
        if len(body) >= min_bytes and i is not None:
            best[body] = max(best.get(body, i), i)
    out = []
    for i, _, html in data:
        body = (html or "").encode()
        to = best.get(body) if len(body) >= min_bytes else None
        again = to is not None and to != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def data():
    rng = random.Random(1)
    whole = [
        "x" * 1200, "é" * 700, "y" * 999, "y" * 1000, "", None, MAGIC * 30,
        MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
        "a\r\n\r\n" + MAGIC + "Content-Length: 3\r\n\r\nabc\r\n\r\n" + MAGIC + "Content-Length: 99999999999999999999999\r\n\r\n",
    ]
    bits = ["ab", MAGIC, "\r\n", "\r\n\r\n", "<p>é</p>", "Content-Length: 7\r\n\r\n", "WARC/1.0\n"]
    rows = []
    for i in range(120):
        html = rng.choice(whole) if i % 2 else "".join(rng.choice(bits) for _ in range(rng.randrange(300)))
        rows.append((i, None if i % 17 == 0 else f"http://h/{i}\r\nWARC-Type: x", html))
    return rows + [
        (None, "u", "x" * 1200), (None, None, None), (7, "u", "y" * 1000), (7, "u", "y" * 1000), (-5, "u", "x" * 1200), (2**40, "", "z" * 200_000),
    ]


@pytest.fixture
def split_bytes(spark):
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("n", ["20000", "128m"])
def test_round_trip_with_magic_in_payloads(spark, split_bytes, n):
    """Records and payload pieces fall on every side of split ends at 20,000 bytes."""
    split_bytes(n)
    pages = spark.createDataFrame(data(), PAGES).withColumns({c: F.lit(1) for c in ("payload", "file", "seq", "again_id", "block")})
    got = sorted((tuple(r) for r in warc_round_trip(pages.repartition(3)).select(*OUT).collect()), key=str)
    assert got == brute(data())


def test_archive_layout_and_foreign_lines(spark):
    path = fresh_path(spark, "warc-test")
    write_warc(spark.createDataFrame([(1, "http://a/", "hi")], PAGES).coalesce(1), path)
    raw = b"".join(r.content for r in spark.read.format("binaryFile").load(path).select("content").collect())
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    assert lines[0] == b"WARC/1.0" and b"WARC-Target-URI: http://a/" in lines and rest.endswith(b"\r\n\r\nhi\r\n\r\n")
    assert int(next(x for x in lines if x.startswith(b"Content-Length")).split(b":")[1]) == len(rest) - 4
    assert [tuple(r) for r in read_warc(spark, path).select("page_id", "payload_bytes").collect()] == [(1, 2)]


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []
