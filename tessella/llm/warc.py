"""WARC archives as a chunked record table.

Payloads travel as rows of (record, chunk number, bytes), cut on the JVM side,
both ways.  Each writing task streams the chunks of its records into one
archive of its own, a gzip member a record, with a running digest that has to
end at the one in the header, and returns an index row for each record.  The
index is a written table: only archives of tasks that it names count, so a
repeated or lost task leaves nothing but an unused file.  Reading streams a
record as rows of (record, chunk number, bytes), each with the count and
SHA-256 of the payload so far; no Python worker holds a record whole, however
large.

A record's id is made of its page id and payload digest, so a revisit can name
the response it refers to, and is held against it when the archives are read.

Archives are opened through Arrow's file systems, so the folder can be any
that the executors share.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.workspace import Workspace

CHUNK = 256 << 10
LEAST = 100  # equal payloads of at least so many bytes are stored once
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def classified(pages: DataFrame, payload: str = "html") -> DataFrame:
    """page_id, url, body (binary; null for revisits), payload_bytes, payload_digest, refers_to.

    Of equal payloads of at least LEAST bytes, the one with the smallest page
    id is the response.  Rows without an id come last; if no row has one, all
    are responses, as are rows that repeat the smallest id.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("payload_bytes", F.octet_length("body").cast("long")).withColumn("payload_digest", F.sha2("body", 256))
    firsts = rows.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull() & (F.col("payload_bytes") >= LEAST)
    rows = rows.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(again, F.col("first"))).drop("first")
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("body")).alias("body"), "payload_bytes", "payload_digest", "refers_to")


def _head(fields: list[tuple[str, str]]) -> bytes:
    clean = ((k, v.replace("\r", "").replace("\n", "")) for k, v in fields)
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in clean).encode() + b"\r\n"


def record_id(page_id, digest: str) -> str:
    """The name of the response of a page; equal for rows that repeat page id and payload."""
    return f"urn:page:{'none' if page_id is None else page_id}:{digest}"


def record_head(page_id, url, stored: int | None, size: int, digest: str, refers_to) -> bytes:
    """All that comes before the payload; stored: payload bytes in the record, None for a revisit, which has none."""
    kind = "revisit" if stored is None else "response"
    name = record_id(page_id, digest) + ("" if stored is not None else ":revisit")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(_HTTP) + (stored or 0)))]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    return _head(fields) + _HTTP


def payload_chunks(rows: DataFrame) -> DataFrame:
    """A row for each CHUNK bytes of body, in order; one for an empty or null body."""
    chunks = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("body"), F.lit(0)) / F.lit(CHUNK))).cast("int")
    out = rows.withColumn("chunks", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    part = F.substring(F.col("body"), F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return out.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("chunks") - 1).alias("last"), part.alias("chunk"))


class _Archive:
    """One archive, written record by record and chunk by chunk."""

    def __init__(self, store, path: str):
        self.out, self.at, self.begin = store.open_output_stream(path, compression=None), 0, 0
        self.packer = self.digest = None

    def _write(self, data: bytes) -> None:
        self.at += self.out.write(data) if data else 0

    def open(self, head: bytes) -> None:
        self.begin, self.digest = self.at, hashlib.sha256()
        self.packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._write(self.packer.compress(head))

    def add(self, chunk: bytes) -> None:
        self.digest.update(chunk)
        self._write(self.packer.compress(chunk))

    def close_record(self) -> tuple[int, int, str]:
        """(place, length, SHA-256 of the chunks) of the record."""
        self._write(self.packer.compress(b"\r\n\r\n"))
        self._write(self.packer.flush())
        return self.begin, self.at - self.begin, self.digest.hexdigest()


def _writer(folder: str):
    """Chunk rows, those of a record together -> the index of the task's archive."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, archive = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", None
        for batch in batches:
            index = []
            heads = [batch.column(c).to_pylist() for c in range(7)]
            for i, (page_id, url, size, digest, refers_to, number, last) in enumerate(zip(*heads, strict=True)):
                chunk = batch.column(7)[i].as_py()
                archive = archive or _Archive(store, f"{base}/{name}")
                if not number:
                    archive.open(record_head(page_id, url, None if chunk is None else size, size, digest, refers_to))
                if chunk:
                    archive.add(chunk)
                if last:
                    place, length, found = archive.close_record()
                    if chunk is not None and found != digest:
                        raise ValueError(f"the payload of page {page_id} has changed on its way to the archive")
                    index.append((name, place, length))
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "place", "length"])
        if archive:
            archive.out.close()

    return write


def write_archives(pages: DataFrame, work: Workspace, payload: str = "html") -> DataFrame:
    """Writes the archives; returns their index (archive, place, length), a written table."""
    return work.keep(payload_chunks(classified(pages, payload)).mapInArrow(_writer(f"{work.path}/archives"), "archive string, place long, length long"), "index")


class _Member:
    """The bytes of one gzip member, read a piece at a time."""

    def __init__(self, file, place: int, length: int):
        file.seek(place)
        self.file, self.left, self.unpack, self.held = file, length, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if not self.left and not self.unpack.unconsumed_tail:
            return False
        data = self.unpack.unconsumed_tail
        if not data:
            data = self.file.read(min(self.left, 64 << 10))
            self.left -= len(data)
        self.held += self.unpack.decompress(data, CHUNK)
        return True

    def upto(self, mark: bytes) -> bytes:
        while (k := self.held.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record ends before its header")
        head, self.held = self.held[:k], self.held[k + len(mark) :]
        return head

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        got, self.held = self.held[:size], self.held[size:]
        return got


_CHUNK_DDL = "archive string, record_id string, page_id long, record_type string, refers_to long, refers_to_record string, declared_bytes long, declared_digest string, chunk_no int, chunk binary, upto_bytes long, upto_digest string, last boolean"
_CHUNK_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]


def record_chunks(file, archive: str, place: int, length: int) -> Iterator[tuple]:
    """Chunk rows of one record; an empty payload has one empty chunk."""
    member = _Member(file, place, length)
    lines = member.upto(b"\r\n\r\n").decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = int(fields["Content-Length"])
    http = member.upto(b"\r\n\r\n")
    left, number, done, digest = block - len(http) - 4, 0, 0, hashlib.sha256()
    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    refers = int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None
    common = (archive, fields["WARC-Record-ID"], page, fields["WARC-Type"], refers, fields.get("WARC-Refers-To"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"))
    while True:
        part = member.take(min(left, CHUNK))
        if len(part) < min(left, CHUNK):
            raise ValueError(f"{archive} ends within a record")
        left, done = left - len(part), done + len(part)
        digest.update(part)
        yield (*common, number, part, done, digest.hexdigest(), not left)
        number += 1
        if not left:
            return


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, file, out, size = None, None, [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _CHUNK_KINDS, strict=True)], names=[x.split()[0] for x in _CHUNK_DDL.split(", ")])

        for batch in batches:
            for archive, place, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if archive != name:
                    name, file = archive, store.open_input_file(f"{base}/{archive}")
                for row in record_chunks(file, archive, place, length):
                    out.append(row)
                    size += len(row[9])
                    if size > 4 << 20 or len(out) > 5000:
                        yield emit()
                        out, size = [], 0
        if out:
            yield emit()

    return read


def read_archives(index: DataFrame, work: Workspace) -> DataFrame:
    """The chunk table of all records that the index names."""
    return index.mapInArrow(_reader(f"{work.path}/archives"), _CHUNK_DDL)


def round_trip(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Writes the pages, reads the archives back: one row a page.

    payload_bytes and payload_digest come from the bytes read: those of a
    revisit, which stores none, from the response that it names.  A revisit
    whose response is missing or differs from the revisit's own header raises.

    A null or empty payload is an empty response.  A row with a null id or url
    keeps its place with a null.  Ties: of equal payloads the smallest page id
    is the response, as is each row that repeats it; rows without an id revisit
    it, or are responses if no row has one.  Empty table: no rows.  A very long
    payload is cut into chunks; Spark holds its cell, no Python worker does.
    Only ``page_id``, ``url`` and the payload are read, so further columns of
    any name do no harm.
    """
    work = Workspace(pages.sparkSession, "warc")
    ends = work.keep(read_archives(write_archives(pages, work, payload), work).where("last").drop("chunk", "archive"), "ends")
    stored = ends.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("upto_bytes").alias("_n"), F.col("upto_digest").alias("_d")).distinct()
    responses = ends.where("record_type = 'response'").select("page_id", F.col("upto_bytes").alias("payload_bytes"), F.col("upto_digest").alias("payload_digest"), "record_type", "refers_to")
    again = ends.where("record_type = 'revisit'").join(stored, "refers_to_record", "left")
    same = (F.col("_n") == F.col("declared_bytes")) & (F.col("_d") == F.col("declared_digest"))
    digest = F.when(same, F.col("_d")).otherwise(F.raise_error(F.concat(F.lit("no such response as "), F.col("refers_to_record"))))
    return responses.unionByName(again.select("page_id", F.col("_n").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through archives and back; see ``round_trip`` for nulls, ties, repeats, empty tables and long payloads."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""
