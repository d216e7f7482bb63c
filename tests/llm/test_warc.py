"""WARC round trips, with magics and whole fake records inside payloads and blocks smaller than records."""

import hashlib

from lectern.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def result(spark, write, rows, kind="page_id long, url string, html string, digest string"):
    got = warc.op6_warc(spark, write(spark.createDataFrame(rows, kind), "pages")).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, *_ in rows:
        body = (h or "").encode()
        back = h in first and i != first[h]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if back else "response", first[h] if back else None))
    return sorted(out, key=str)


def test_payloads_with_magic(spark, write):
    bodies = [None, "", "x", "é" * 500, FAKE, FAKE * 40, "WARC/1.", "WARC/1.1\r\n" * 30, "a" * 20_000, "\r\n\r\n", "a" * 99 + FAKE, "a" * 150, "a" * 150, "tail WARC/1.0"]
    rows = [(i, f"http://x/{i}", bodies[i % len(bodies)], "clash") for i in range(90)] + [(None, None, "a" * 150, None), (None, "http://x/\r\nWARC/1.1\r\n", "n", None)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert result(spark, write, rows) == expected(rows)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_table_and_repeated_rows(spark, write):
    assert result(spark, write, []) == []
    rows = [(5, "u", "b" * 200, "")] * 2 + [(6, "u", "b" * 200, "")]
    assert result(spark, write, rows) == expected(rows)
