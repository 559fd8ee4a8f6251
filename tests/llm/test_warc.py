import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm.warc import Members, member, read_warc, write_warc

BIG = "x" * 1200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4", "small"),
        (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "http://a/\r\nX-Page-ID: 9", "é" * 700),
        (8, "", "z" * 3_000_000), (None, "http://a/n", BIG), (9, "http://b", "é" * 700), (9, "http://b", "é" * 700),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.select("*", F.lit(1).alias("digest"), F.lit(2).alias("payload"), F.lit(3).alias("revisit"))


@pytest.mark.parametrize("split", [57, 1 << 20])
def test_archives_round_trip(pages, split):
    files = write_warc(pages.repartition(2), file_bytes=500)
    found = read_warc(files, split_bytes=split).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == 11
    for row in pages.collect():
        payload = (row.html or "").encode()
        assert by[row.page_id].payload_bytes == len(payload)
        assert by[row.page_id].payload_digest == hashlib.sha1(payload).hexdigest()
    kinds = {k: (r.record_type, r.refers_to) for k, r in by.items()}
    assert kinds[3] == ("response", None) and kinds[1] == kinds[2] == kinds[None] == ("revisit", 3)
    assert kinds[4] == kinds[5] == kinds[6] == kinds[8] == ("response", None)
    assert kinds[7] == ("revisit", 9) and kinds[9] == ("response", None)
    assert by[3].payload == BIG.encode() and by[1].payload == b""
    assert files.count() > 1


def test_false_magic_is_no_member():
    page = {"payload": b"a" * 50, "revisit": False, "refers_to": None, "url": "u", "page_id": 1}
    real = member(page, "2024-01-01T00:00:00Z")
    assert gzip.decompress(real).startswith(b"WARC/1.1")
    junk = b"\x1f\x8b\x08 not gzip" + gzip.compress(b"no record") + b"\x1f\x8b"
    content = junk + real + real
    members = Members(lambda offset, length: content[offset : offset + length], len(content), step=64)
    assert [at for at, _ in members.within(0, len(content))] == [len(junk), len(junk) + len(real)]
    assert [at for at, _ in members.within(1, len(junk) + 1)] == [len(junk)]


def test_no_pages(pages):
    assert read_warc(write_warc(pages.limit(0))).count() == 0


@pytest.mark.parametrize("split", [200_000, 1 << 20, 8 << 20])
def test_splits_read_little_more_than_their_bytes(split):
    chance = random.Random(1)
    records = [
        member({"payload": chance.randbytes(chance.randrange(100, 20_000)), "revisit": False, "refers_to": None, "url": "u", "page_id": i}, "2024-01-01T00:00:00Z")
        for i in range(400)
    ]
    content, longest = b"".join(records), max(map(len, records))
    found, whole = [], 0
    for low in range(0, len(content), split):
        high, seen = min(low + split, len(content)), [0, 0]

        def read(offset, length):
            seen[0] += min(length, len(content) - offset)
            seen[1] += 1
            return content[offset : offset + length]

        found += [at for at, _ in Members(read, len(content)).within(low, high)]
        assert seen[0] <= 1.2 * (high - low) + longest + (1 << 14)
        assert seen[1] <= 4 + (high - low) / (1 << 20)
        whole += seen[0]
    places = [0]
    for record in records[:-1]:
        places.append(places[-1] + len(record))
    assert found == places and whole <= 1.2 * len(content) + len(content) / split * (longest + (1 << 14))
