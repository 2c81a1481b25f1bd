"""Archives read back against hashing every payload; the bytes against the format."""

import base64
import gzip
import hashlib
import os

from gaugework.llm import warc

FORM = "page_id long, url string, html string, digest string"


def expected(rows, least=0):
    first = {}
    for i, _, html, _ in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, _ in rows:
        body = (html or "").encode()
        lead = first.get(html or "") if len(body) >= least else i
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = lead is None or i == lead
        out.append((i, len(body), digest, "response" if response else "revisit", None if response else lead))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/x", "<p>é</p>", "c"), (3, "http://a/y z\r\n", "<p>é</p>", "c"), (9, None, "<p>é</p>", "c"), (1, "u", None, "c"), (2, "u", "", "c"),
    (7, "v", "WARC/1.1\r\n\r\nfake\r\n\r\n" * 50, "c"), (8, "w", "x" * 300_000, "c"), (3, "http://a/y", "<p>é</p>", "c"), (None, "n", "<p>é</p>", "c"), (None, "n", "lone", "c"),
]


def back(spark, rows, **more):
    folder, index = warc.write(spark.createDataFrame(rows, FORM).repartition(3), **more)
    return folder, index, warc.read(folder, index)


def test_round_trip(spark):
    for least in (0, 5):
        _, _, records = back(spark, ROWS, least_bytes=least)
        got = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted(map(tuple, got.collect()), key=repr) == expected(ROWS, least)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in records.filter("payload is not null").collect()}
    assert texts[7] == ROWS[5][2] and texts[8] == ROWS[6][2]


def test_some_records_and_none(spark):
    folder, index, _ = back(spark, ROWS)
    some = warc.read(folder, index.filter("page_id in (3, 8)"))
    assert sorted({r["page_id"] for r in some.collect()}) == [3, 8]
    assert warc.read(folder, index.limit(0)).collect() == []
    assert back(spark, [])[2].collect() == []


def test_archives_are_plain_gzip_members(spark):
    folder, index, _ = back(spark, ROWS)
    place = folder.removeprefix("file://")
    data = b"".join(gzip.open(os.path.join(place, f)).read() for f in os.listdir(place))
    assert data.count(b"WARC-Type: response\r\n") + data.count(b"WARC-Type: revisit\r\n") == len(ROWS)
    assert b"WARC-Target-URI: http://a/y%20z%0D%0A\r\n" in data and data.count(b"WARC-Type: warcinfo") == len(os.listdir(place))


def test_ranges_join_neighbours():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 100_000, 5), ("b", 100_005, 5), ("b", 100_010, 9 << 20)]
    assert warc.ranges(places) == [[0, 1], [2], [3], [4]]
