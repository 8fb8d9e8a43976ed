"""WARC: records, the normaliser, and round trips against brute force."""

import gzip
import hashlib
import io
import json
import zlib

import pytest
from pyspark.sql import types as T

from marlstone.llm import warc as w

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("key", T.LongType())])
BIG, OTHER = "é" * 600, "x" * 1000
ROWS = [
    (1, "http://a/ b\n", BIG),
    (2, None, BIG),
    (5, "u", BIG),
    (3, "u", "x" * 999),
    (4, "u", "x" * 999),
    (6, "u", None),
    (7, "u", ""),
    (8, "u", OTHER),
    (8, "u", OTHER),
    (9, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50),
    (None, "u", BIG),
    (10, "u", "y" * 3_000_000),
]


def brute(rows):
    groups = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            groups[data] = max(groups.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = groups.get(data)
        revisit = last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(map(repr, out))


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "p", 1) for r in ROWS], SCHEMA).repartition(3)
    assert sorted(map(repr, map(tuple, w.round_trip(pages, f"file://{tmp_path}").collect()))) == brute(ROWS)
    names = sorted(p.name for p in tmp_path.iterdir())
    assert any(n.endswith(".mono.warc.gz") for n in names) and any(n.endswith(".idx") for n in names)


def test_folders(spark, tmp_path):
    """A path without a scheme is on Spark's default file system; a name with a space stays one."""
    folder = tmp_path / "a b"
    assert sorted(map(repr, map(tuple, w.round_trip(spark.createDataFrame([(*r, "p", 1) for r in ROWS], SCHEMA), str(folder)).collect()))) == brute(ROWS)
    assert any(p.name.endswith(".idx") for p in folder.iterdir())
    assert w.located(spark, str(tmp_path)).startswith("file:/")
    assert w.pyarrow_uri("s3a://bucket/k:1") == "s3://bucket/k:1" and w.pyarrow_uri("hdfs://host:9/k") == "hdfs://host:9/k"


def test_small_archives_and_contents(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    archives = w.write_archives(pages, f"file://{tmp_path}", archive_bytes=2000)
    assert archives.files.count() > 5
    read = w.read_archives(w.normalise_archives(archives)).collect()
    assert sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in read) == [(i, f"u{i}", f"page {i} " * 50) for i in range(40)]


def test_empty(spark, tmp_path):
    assert w.round_trip(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}").collect() == []


def test_normaliser():
    records = [w.page_record(i, "u", b"data %d" % i * 30_000, "d", None, False) for i in range(20)]
    mono = io.BytesIO()
    w.write_monolithic(iter(records), mono)
    assert zlib.decompressobj(31).decompress(mono.getvalue()) == b"".join(records)
    out = io.BytesIO()
    index = [json.loads(json.dumps(e)) for e in w.normalise(io.BytesIO(mono.getvalue()), out)]
    assert gzip.decompress(out.getvalue()) == b"".join(records)
    for i, entry in enumerate(index):
        member = out.getvalue()[entry["offset"] : entry["offset"] + entry["length"]]
        assert gzip.decompress(member) == records[i]
        headers, block = w.read_member(io.BytesIO(out.getvalue()), entry)
        assert w.page_of(headers["WARC-Record-ID"]) == i and block == b"data %d" % i * 30_000
    # What is normalised already comes out the same.
    again = io.BytesIO()
    assert list(w.normalise(io.BytesIO(out.getvalue()), again)) == index and again.getvalue() == out.getvalue()


def test_broken_streams():
    mono = io.BytesIO()
    w.write_monolithic(iter([w.page_record(1, "u", b"x" * 5000, "d", None, False)]), mono)
    for broken in (mono.getvalue()[:-20], gzip.compress(w.record({"WARC-Type": "response"}, b"abc")[:-3]), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\nabc\r\n\r\n")):
        with pytest.raises(ValueError):
            list(w.normalise(io.BytesIO(broken), io.BytesIO()))
