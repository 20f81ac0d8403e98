import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from frametide.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, payload string"
BIG, ODD = "x" * 1500, "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60


def digest(t):
    return hashlib.sha1((t or "").encode()).hexdigest()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a", BIG), (2, None, BIG), (3, "http://a b\r\nX: 1", "é" * 999), (4, "u", None), (5, "u", ODD), (7, "u", ODD), (7, "u", ODD), (8, "u", "short"), (9, "u", "short"), (None, "u", BIG), (None, "u", "é" * 500), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u", "z" * 999), (13, "u", "z" * 999)]
    for chunk, segment in ((1, 400), (7, W.SEGMENT), (700, 999), (1 << 20, 250), (1 << 20, W.SEGMENT)):
        path = f"file://{tmp_path}/w{chunk}-{segment}"
        W.write(spark.createDataFrame([(*r, "d", "p") for r in rows], SCHEMA), path, segment=segment)
        rows_read = W.read(spark, path, chunk=chunk)
        got = {}
        for r in W.resolved(W.by_record(rows_read)).collect():
            got.setdefault(r.record_id.removeprefix(W.ID), []).append((r.record_type, r.refers_to and r.refers_to.removeprefix(W.ID), r.payload_bytes, r.payload_digest))
        want = {}
        for i, _, t in rows:
            n = len((t or "").encode())
            same = [j for j, _, x in rows if x == t and j is not None]
            again = n >= 1000 and same and i != max(same)
            want.setdefault("null" if i is None else str(i), []).append(("revisit" if again else "response", str(max(same)) if again else None, n, digest(t)))
        assert W.by_record(rows_read).filter("not complete or not digest_ok").count() == 0
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    whole = rows_read.filter("record_type = 'response'").groupBy("archive", "record").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("c"), F.first("stated_digest").alias("d"))
    for r in whole.collect():
        assert "sha1:" + hashlib.sha1(b"".join(bytes(c.data) for c in r.c)).hexdigest() == r.d


def test_chunks_are_bounded_and_digests_grow(spark):
    body = bytes(range(256)) * 40
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r1>\r\nContent-Type: image/png\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    for data in (record * 2, gzip.compress(record * 2), gzip.compress(record) + gzip.compress(record)):
        rows = list(W.chunks(io.BytesIO(data), chunk=1000))
        assert [len(r["data"]) for r in rows] == ([1000] * 10 + [240]) * 2 and [r["record"] for r in rows] == [0] * 11 + [1] * 11
        assert all(r["digest"] == hashlib.sha1(body[: 1000 * r["chunk"] + len(r["data"])]).hexdigest() for r in rows)


def test_odd_archives():
    assert list(W.chunks(io.BytesIO(b""))) == [] and list(W.chunks(io.BytesIO(b"\r\n\r\n"))) == []
    cut = b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 100\r\n\r\nabc"
    assert [(r["record_id"], r["data"], r["complete"]) for r in W.chunks(io.BytesIO(cut))] == [("a", b"abc", False)]
    whole = b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nWARC-Segment-Number: 1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r["complete"] for r in W.chunks(io.BytesIO(whole))] == [False]  # further segments are missing
    more = b"WARC/1.0\r\nWARC-Type: continuation\r\nWARC-Record-ID: <b>\r\nWARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Number: 2\r\nWARC-Segment-Total-Length: 5\r\nContent-Length: 2\r\n\r\nde\r\n\r\n"
    assert [(r["record"], r["data"], r["total"], r["complete"]) for r in W.chunks(io.BytesIO(whole + more))] == [(0, b"abcde", 5, True)]
    assert [r["record_id"] for r in W.chunks(io.BytesIO(more))] == ["b"]
    with pytest.raises(ValueError):
        list(W.chunks(io.BytesIO(b"x" * (W.HEADER_BYTES + W.READ * 2))))


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    W.write(spark.createDataFrame([], SCHEMA), path)
    assert W.by_record(W.read(spark, path)).count() == 0


def test_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = W.query(spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(i, len(h.encode()), digest(h)) for i, h in pages.items()} and len(got) == len(pages)


def test_very_long_url(spark, tmp_path):
    rows = [(1, "http://" + "u" * 5_000_000, BIG, "d", "p"), (2, "v", "short", "d", "p"), (3, "http://" + "w" * (W.HEADER_BYTES + 1), None, "d", "p")]
    W.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/w")
    got = W.resolved(W.by_record(W.read(spark, f"file://{tmp_path}/w"))).collect()
    assert {(r.record_id.removeprefix(W.ID), r.payload_bytes, r.payload_digest) for r in got} == {(str(i), len(t or ""), digest(t)) for i, _, t, _, _ in rows}
