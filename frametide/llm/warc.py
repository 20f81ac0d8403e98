"""WARC archives as a chunked record table.

Writing: each page is one record of a gzipped archive, a task writing its own file through Spark's committer. A payload of more than
``SEGMENT`` characters is cut into segments as the standard has it, a record and its continuations, each a row of its own, so that none is put
together as a whole. Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest id is a response and the others
revisit it.

Reading: a task streams an archive and yields rows ``(archive, record, chunk, ...)`` of at most ``CHUNK`` payload bytes, across the
segments of a record, so that no record is ever held whole; each chunk carries the SHA-1 and the bytes of the payload up to its end, so
the last chunk's are the record's. That row also says whether the record is complete and whether the digest is the one stated.

Defined results: a null payload is empty; a null url gives a record without a target; revisits name the id they refer to
and take length and digest from that record; pages that repeat the largest id of their payload are all responses; a null
id is never referred to and revisits any page with an id; an empty table gives an archive without records; other columns
are not read, whatever their names. Archives may be plain or gzipped, in one member or many; a truncated record ends where the file does
and is marked as not complete; a continuation without its record is one of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametide.llm.common import dropped, scratch_path, table, written

REVISIT_BYTES = 1000
CHUNK = 1 << 20
READ = 1 << 18
#: Characters of a segment at most.
SEGMENT = 1 << 18
#: Tasks that read archives at most; with more files each reads several.
READ_TASKS = 20_000
#: Longest header block that a reader accepts, its long fields aside: of a field beyond ``FIELD_BYTES`` it holds the beginning only.
HEADER_BYTES, FIELD_BYTES = 1 << 20, 1 << 16
ID = "urn:frametide:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(*fields: Column | str) -> Column:
    """Lines joined by CRLF; a null field is left out."""
    return F.concat_ws("\r\n", *(F.lit(f) if isinstance(f, str) else f for f in fields))


def records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT) -> DataFrame:
    """``value``: the records of each page, one behind the other, each without its last line feed."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # the few payloads that occur more than once; which pages those are is found without moving payloads
    same = own.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    same, _ = written(same.filter("n > 1 and first_id is not null").select("digest", "first_id"), "repeated-payloads")
    joined = own.join(same, "digest", "left")
    revisit = (F.col("size") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("body") / segment).cast("int") - 1))
    parts = joined.select("page_id", "url", "digest", "size", "first_id", revisit.alias("revisit"), body.alias("body"))
    parts = parts.select(*parts.columns[:-1], F.size(cuts).alias("n"), F.posexplode_outer(F.transform(cuts, lambda i: F.substring("body", i * segment + 1, F.lit(segment)))).alias("k", "part"))
    http = _header("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", F.concat(F.lit("Content-Length: "), F.col("size")), "", "")
    id_ = F.concat(F.lit(ID), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"))
    date = "WARC-Date: 1970-01-01T00:00:00Z"
    shared = (F.concat(F.lit("WARC-Record-ID: <"), id_, F.lit(">")), target, date, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), "Content-Type: application/http; msgtype=response")
    response = F.concat(
        _header("WARC/1.1", "WARC-Type: response", *shared, F.when(F.col("n") > 1, "WARC-Segment-Number: 1"), F.concat(F.lit("Content-Length: "), F.octet_length(http) + F.octet_length("part")), "", ""),
        http,
        F.col("part"),
    )
    further = F.concat(
        _header(
            "WARC/1.1", "WARC-Type: continuation", F.concat(F.lit("WARC-Record-ID: <"), id_, F.lit(":segment:"), F.col("k") + 1, F.lit(">")), target, date,
            F.concat(F.lit("WARC-Segment-Origin-ID: <"), id_, F.lit(">")), F.concat(F.lit("WARC-Segment-Number: "), F.col("k") + 1),
            F.when(F.col("k") == F.col("n") - 1, F.concat(F.lit("WARC-Segment-Total-Length: "), F.octet_length(http) + F.col("size"))),
            F.concat(F.lit("Content-Length: "), F.octet_length("part")), "", "",
        ),
        F.col("part"),
    )
    again = _header(
        "WARC/1.1", "WARC-Type: revisit", *shared, f"WARC-Profile: {PROFILE}",
        F.concat(F.lit(f"WARC-Refers-To: <{ID}"), F.col("first_id"), F.lit(">")), "Content-Length: 0", "", "",
    )
    return parts.select(F.concat(F.when(F.col("revisit"), again).when(F.col("k") == 0, response).otherwise(further), F.lit("\r\n\r")).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT) -> None:
    """Write archives ``part-*.gz`` under ``path`` (any store that Spark writes)."""
    records(pages, id_col, url, payload, segment).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _plain(stream, size: int = READ) -> Iterator[bytes]:
    """The stream's bytes, unzipped where a member begins like gzip."""
    data = stream.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = stream.read(size)
        return
    unzip = zlib.decompressobj(31)
    while data:
        out = unzip.decompress(data, CHUNK)
        if out:
            yield out
        if unzip.eof:
            data = unzip.unused_data or stream.read(size)
            unzip = zlib.decompressobj(31)
        else:
            data = unzip.unconsumed_tail or stream.read(size)
    if rest := unzip.flush():
        yield rest


class _Reader:
    """A window over a stream of bytes that is never longer than a header block or a read."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.held = parts, b""

    def more(self) -> bool:
        part = next(self.parts, None)
        self.held += part or b""
        return part is not None

    def until(self, mark: bytes, shorten: bool = False) -> bytes | None:
        """Up to and with ``mark``; None at the end of the stream. ``shorten``: a block beyond ``HEADER_BYTES`` loses the ends of its long fields."""
        looked = 0
        while (at := self.held.find(mark, max(0, looked - len(mark)))) < 0:
            if shorten and len(self.held) > HEADER_BYTES:
                first, *lines = self.held.split(b"\r\n")
                lines = [x if len(x) <= FIELD_BYTES else x[:FIELD_BYTES] + x[-1:] * x.endswith(b"\r") for x in lines]
                self.held = b"\r\n".join([first, *lines])
            looked = len(self.held)
            if looked > HEADER_BYTES:
                raise ValueError("a WARC header block is too long")
            if not self.more():
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        """At least one byte and at most ``n``; none at the end."""
        while not self.held and self.more():
            pass
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}


class _Record:
    """A record whose payload is being read, over its segments."""

    def __init__(self, number: int, fields: dict[str, str]) -> None:
        self.fields = fields
        self.id = fields.get("warc-record-id", "").strip("<>")
        self.common = {"record": number, "record_id": self.id, "record_type": fields.get("warc-type"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "stated_digest": fields.get("warc-payload-digest")}
        self.digest, self.chunk, self.held, self.total, self.segment, self.complete = hashlib.sha1(), 0, bytearray(), 0, 1, True
        self.open = fields.get("warc-segment-number") == "1"  # more segments must come

    def row(self, last: bool) -> dict:
        self.digest.update(self.held)
        self.total += len(self.held)
        out = self.common | {"chunk": self.chunk, "data": bytes(self.held), "digest": self.digest.hexdigest(), "total": self.total, "last": last, "complete": self.complete and not self.open if last else None}
        self.chunk += 1
        self.held.clear()
        return out


def chunks(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of the chunks of each record, as they are read; a record without payload has one empty chunk."""
    reader, number, now = _Reader(_plain(stream)), -1, None
    while True:
        while not reader.held.lstrip(b"\r\n"):  # between records
            reader.held = b""
            if not reader.more():
                break
        reader.held = reader.held.lstrip(b"\r\n")
        block = reader.until(b"\r\n\r\n", shorten=True) if reader.held else None
        if block is None:
            if now:
                yield now.row(True)
            return
        fields = _fields(block)
        left = int(fields.get("content-length", 0))
        if now and fields.get("warc-type") == "continuation" and fields.get("warc-segment-origin-id", "").strip("<>") == now.id and fields.get("warc-segment-number") == str(now.segment + 1):
            now.segment += 1
            now.open = "warc-segment-total-length" not in fields
        else:
            if now:
                yield now.row(True)
            number += 1
            now = _Record(number, fields)
            if left and fields.get("content-type", "").lower().startswith("application/http"):
                before = reader.until(b"\r\n\r\n")
                left -= len(before or b"")
        while left > 0:
            if len(now.held) == chunk:
                yield now.row(False)
            part = reader.take(min(left, chunk - len(now.held)))
            if not part:
                break
            now.held += part
            left -= len(part)
        now.complete &= left <= 0


ROW = "archive string, record long, record_id string, record_type string, refers_to string, stated_digest string, chunk long, size long, digest string, total long, last boolean, complete boolean"
FIELDS = {
    "archive": pa.string(), "record": pa.int64(), "record_id": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "stated_digest": pa.string(), "chunk": pa.int64(), "size": pa.int64(),
    "digest": pa.string(), "total": pa.int64(), "last": pa.bool_(), "complete": pa.bool_(), "data": pa.binary(),
}


def _scan(chunk: int, with_data: bool):
    fields = {k: t for k, t in FIELDS.items() if with_data or k != "data"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in fields.items()], names=list(fields))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for row in chunks(stream, chunk):
                        row |= {"archive": path, "size": len(row["data"])}
                        if not with_data:
                            del row["data"]
                        rows.append(row)
                        held += row["size"] * with_data + 300
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(spark: SparkSession, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives under ``path``: the columns of ``ROW`` and, with ``with_data``, ``data``.

    Files are listed by Spark and opened by executors with pyarrow's file systems (file, hdfs, s3, gs). Without
    ``with_data`` chunks are measured and digested, but their bytes don't leave the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    tasks = max(1, min(files.count(), READ_TASKS))
    return files.repartition(tasks).mapInArrow(_scan(chunk, with_data), ROW + ", data binary" * with_data)


def by_record(chunk_rows: DataFrame) -> DataFrame:
    """One row per record: archive, record, record_id, record_type, refers_to, its own payload's length and digest, whether it is complete and,
    where it has a payload of its own, whether the digest is the one stated. No shuffle: the last chunk knows."""
    same = F.when(F.col("record_type") != "revisit", F.coalesce(F.col("stated_digest") == F.concat(F.lit("sha1:"), "digest"), F.lit(False)))
    return chunk_rows.filter("last").select(
        "archive", "record", "record_id", "record_type", "refers_to", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "complete", same.alias("digest_ok")
    )


def resolved(records_read: DataFrame) -> DataFrame:
    """``records_read``, each revisit with the length and digest of the payload that it refers to."""
    columns = ("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    full = records_read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("target"))
    full = full.agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("full"))
    # only records that refer to another are joined: the others share the null key
    again = records_read.filter("refers_to is not null").join(full, F.col("refers_to") == F.col("target"), "left")
    again = again.withColumns({c: F.coalesce(f"full.{c}", c) for c in columns[3:]})
    return records_read.filter("refers_to is null").select(*columns).unionByName(again.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    read_back, _ = written(by_record(read(spark, path, with_data=False)), "warc-records")
    dropped(spark, path)
    wrong = read_back.filter("not complete or not digest_ok").count()
    if wrong:
        raise ValueError(f"{wrong} records read back are cut off or not what was written")
    out = resolved(read_back)

    def page(name: str) -> Column:
        return F.expr(f"try_cast(substring({name}, {len(ID) + 1}) AS bigint)")

    return out.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN m END AS refers_to
FROM (SELECT page_id, h, m, strlen(h) >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m AS again
      FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m FROM pages) AS a) AS b
"""
