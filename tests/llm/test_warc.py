from __future__ import annotations

import hashlib

import duckdb
import pytest
import zstandard

from wayfare.llm import warc
from wayfare.llm.common import new_path

BIG = "x" * 1500
ROWS = [(1, "http://a/", BIG, "k"), (2, "http://b/\r\n", BIG, "k"), (3, None, "small", "k"), (4, "u", "small", "k"), (5, "u", None, "k"), (None, "u", BIG, "k"), (2, "http://b/", BIG, "k"), (6, "u", "é" * 500, "k"), (4, "u", "small", "k"), (None, "u", BIG, "k")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, address string")
    path = new_path(spark, "warc")
    warc.write(df, path)
    got = sorted(map(tuple, warc.read(spark, path).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for i, _, html, _ in ROWS:
        n = len((html or "").encode())
        again = n >= 1000 and html == BIG and i != 2
        want.append((i, n, sha(html), "revisit" if again else "response", 2 if again else None))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    ids = set()
    for r in warc.records(spark, path).collect():
        record, payload = bytes(r.record), bytes(r.payload)
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        ids.add(fields[b"WARC-Record-ID"])
        assert int(fields[b"Content-Length"]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        assert fields[b"WARC-Payload-Digest"] == b"sha1:" + hashlib.sha1(payload).hexdigest().encode()
        if fields[b"WARC-Type"] == b"response":
            assert rest.split(b"\r\n\r\n", 1)[1][:-4] == payload
        else:
            assert b"WARC-Refers-To" in fields
    assert len(ids) == len(ROWS)


def test_empty(spark):
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_damage_is_seen(spark):
    """In a payload, in a header, and where a revisit names no record."""
    path = new_path(spark, "warc")
    warc.write(spark.createDataFrame(ROWS[:2], "page_id long, url string, html string, address string"), path)
    bad = spark.read.parquet(f"{path}/payloads")
    rows = [(r.address, tuple(r.response), r.length, r.sha1, zstandard.compress(b"other")) for r in bad.collect()]
    heads = [(r.address, bytes(r.header)) for r in spark.read.parquet(f"{path}/headers").collect()]
    for name, changed, match in (
        ("digest", [(a, h.replace(b"sha1:", b"sha1:0", 1)) for a, h in heads], "does not match its header"),
        ("refers", [(a, h.replace(b"Refers-To: <urn:uuid:", b"Refers-To: <urn:uuid:0")) for a, h in heads], "no record"),
    ):
        spark.createDataFrame(changed, "address string, header binary").write.mode("overwrite").parquet(f"{path}/headers")
        with pytest.raises(Exception, match=match):
            warc.read(spark, path).collect()
        assert name
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its address"):
        warc.read(spark, path).collect()


def test_against_sql(spark):
    rows = [(k, f"http://h/{k}", "y" * (700 + 100 * (k % 8)) if k % 3 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(df, path)
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    assert sorted(map(tuple, warc.read(spark, path).collect())) == sorted(con.sql(warc.SQL).fetchall())
