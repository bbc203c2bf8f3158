"""WARC archives through a table of chunks (operator 11).

A payload is never built whole on its way: it is a run of rows (record, chunk number), each of at most `chunk_bytes`
bytes, that carry the digests and the size of the payload up to and with the chunk.

1. chunk_table(): every row of the pages becomes chunk rows in one narrow stage; they are written, so that the numbers
   of the records stand from then on.
2. header_table(): the last chunk of a record has its size and digests. Of equal payloads of at least `least_bytes`
   bytes the record with the largest id is the response, the others revisit it.
3. write_archives(): a record's header is one more row of it, before its chunks. Rows go to files by their record and are
   sorted by chunk number there; Spark's text writer, with the line end of WARC, writes and commits the files.
   A payload is in HTTP's chunked transfer coding, so each chunk is a line for its size and the bytes after it.
4. read_chunks(): one pass over the lines of a file in order gives the table of chunks again, with digests that are
   carried from chunk to chunk. read_records() keeps a record's last chunk, resolves revisits by joining them to what they refer
   to, and says whether the bytes have the digest that the header claims.

Memory: a task holds one chunk and one line; a record's rows are sorted by Spark, which spills. Files are as many as
`file_bytes` of payload each ask for, at least the session's shuffle partitions. They are compressed as whole files, so one
task reads one from its begin; files without compression may be split, so their lines are brought together by file first.
Lines of other writers' archives are as long as those made them.

Defined cases: a null payload is empty, and empty payloads are equal to each other; rows with the same id and payload (repeated
rows) are one response and its revisits; null ids come after all others and read back as null; a null url is the record's
own name; characters that a header can't hold are percent-encoded in it; payloads of any length and bytes are kept to the byte. An
empty table gives archives without records. Other columns of the pages aren't archived. Equal means equal in size, SHA-1 and SHA-256.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.llm.frames import arrow_map, own_tables, written

CHUNK_BYTES, FILE_BYTES = 1 << 20, 1 << 30
#: Bytes of chunk rows that a task gathers before it hands them on.
GATHERED = 2 << 20
_LONG, _TEXT, _BYTES = pa.int64(), pa.string(), pa.binary()
CHUNKS = pa.schema({
    "record": _LONG, "id": _LONG, "url": _TEXT, "chunk_no": _LONG, "data": _BYTES, "bytes_so_far": _LONG, "coded_so_far": _LONG, "sha1_so_far": _BYTES, "sha256_so_far": _BYTES, "last": pa.bool_(),
})
READ = pa.schema({
    "record_id": _TEXT, "record_type": _TEXT, "source_id": _TEXT, "target_uri": _TEXT, "refers_to": _TEXT, "claimed": _TEXT, "chunk_no": _LONG, "data": _BYTES, "bytes_so_far": _LONG, "digest_so_far": _TEXT, "last": pa.bool_(),
})
#: Words of the format.
VERSION, NEW_LINE = "WARC/1.1", "\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: A field of our own for the id of the page.
ID_FIELD = "X-Source-Id"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of CHUNKS, written. Every record has at least one, with no bytes if the payload has none."""
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, size, out = batch.select([0, 1, 2]).to_pylist(), 0, []
            for head, payload in zip(heads, batch.column(3), strict=True):
                view = memoryview(payload.as_buffer()) if payload.is_valid else memoryview(b"")  # no copy of the whole
                sha1, sha256, coded = hashlib.sha1(), hashlib.sha256(), 0
                for k, at in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                    data = bytes(view[at : at + chunk_bytes])
                    sha1.update(data)
                    sha256.update(data)
                    coded += len(_coded(data))
                    out.append((*head.values(), k, data, at + len(data), coded, sha1.digest(), sha256.digest(), at + chunk_bytes >= len(view)))
                    size += len(data)
                    if size >= GATHERED:
                        yield _batch(CHUNKS, out)
                        size, out = 0, []
            if out:
                yield _batch(CHUNKS, out)

    return written(arrow_map(rows, cut, from_arrow_schema(CHUNKS)), "warc-chunks")


def _coded(data: bytes | memoryview) -> bytes:
    """A chunk in HTTP's transfer coding: its size in hexadecimal on a line, and its bytes on one; nothing for no bytes, as 0 ends a payload."""
    return b"%X\r\n%b\r\n" % (len(data), data) if len(data) else b""


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def header_table(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """record, id, url, payload_bytes, coded (the bytes of its chunks in the archive), sha1 and, where the record revisits another, of_record, of_url.

    Copies are found by one aggregation that combines before the shuffle; the join back splits a hot payload (AQE).
    """
    ends = chunks.where("last").select("record", "id", "url", F.col("bytes_so_far").alias("payload_bytes"), F.col("coded_so_far").alias("coded"), F.col("sha1_so_far").alias("sha1"), F.col("sha256_so_far").alias("sha256"))
    same = ["payload_bytes", "sha1", "sha256"]
    first = F.max_by(F.struct("record", "url"), F.struct(F.col("id").isNotNull(), "id", -F.col("record"))).alias("of")
    copied = ends.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(first, F.count("*").alias("n")).where("n > 1").drop("n")
    other = F.col("of.record") != F.col("record")
    return ends.join(copied, same, "left").select("record", "id", "url", "payload_bytes", "coded", "sha1", F.when(other, F.col("of.record")).alias("of_record"), F.when(other, F.col("of.url")).alias("of_url"))


def _encoded(text: str) -> str:
    """Bytes that a header's value can't hold (controls, blanks and what isn't ASCII) percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode()).decode()


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def write_archives(chunks: DataFrame, headers: DataFrame, path: str, date: str | None = None, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Write the records as WARC files into the folder `path`, whose file system may be any that Spark writes to."""
    spark = chunks.sparkSession
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = uuid.uuid4().hex[:16]
    total = headers.agg(F.sum("payload_bytes")).head()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    head = headers.select("record", F.lit(-1).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("data"), "id", "url", "coded", "sha1", "of_record", "of_url", F.lit(False).alias("last"))
    body = chunks.select("record", "chunk_no", "data", "last")
    rows = head.unionByName(body, allowMissingColumns=True).repartition(files, "record").sortWithinPartitions("record", "chunk_no")

    def name(record: int) -> str:
        return f"<urn:uuid:{uuid.UUID(hex=f'{run}{record:016x}')}>"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skipping = False
        for batch in batches:
            out = []
            small = batch.drop_columns(["data"]).to_pylist()
            for r, data in zip(small, batch.column("data"), strict=True):
                if r["chunk_no"] < 0:
                    skipping = r["of_record"] is not None
                    out.append(header(r).encode())
                    continue
                if skipping:
                    continue
                said = _coded(memoryview(data.as_buffer())) + (b"0\r\n\r\n\r\n\r\n" if r["last"] else b"")
                if said:
                    out.append(said[:-2])  # the writer ends every row with a line end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["line"])

    def header(r: dict) -> str:
        own, other = name(r["record"]), r["of_record"]
        block = HTTP_HEAD if other is None else HTTP_HEAD.replace("Transfer-Encoding: chunked\r\n", "")
        fields = {
            "WARC-Type": "response" if other is None else "revisit", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": _encoded(r["url"] or own[1:-1]),
            "WARC-Payload-Digest": f"sha1:{base32(r['sha1'])}", "Content-Type": "application/http;msgtype=response", "Content-Length": len(block) + (r["coded"] + 5 if other is None else 0),
        }
        if r["id"] is not None:
            fields[ID_FIELD] = r["id"]
        if other is not None:
            fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": name(other), "WARC-Refers-To-Target-URI": _encoded(r["of_url"] or name(other)[1:-1]), "WARC-Refers-To-Date": date}
        said = NEW_LINE.join([VERSION, *(f"{k}: {v}" for k, v in fields.items()), "", block])
        return said[:-2] if other is None else said + NEW_LINE

    bound = arrow_map(rows, lines, "line binary").select(F.col("line").cast("string"))
    bound.write.option("lineSep", NEW_LINE).option("compression", compression).text(path)


def read_chunks(spark: SparkSession, path: str, payload: bool = True, splittable: bool = False) -> DataFrame:
    """The table of chunks (READ) of the archives in a folder or of a pattern; without `payload` only each record's last row, without bytes.

    A payload in chunked transfer coding gives its own chunks, another one a row for every CHUNK_BYTES or so. splittable: for
    archives that Spark may read in several parts, as those without compression.
    """
    found = spark.read.option("lineSep", NEW_LINE).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    if splittable:
        found = found.withColumn("line", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "block", "line").drop("line")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file = None, None
        for batch in batches:
            out, size = [], 0
            files, blocks = batch.column(0), batch.column(1)
            if not splittable and pc.max(blocks).as_py():
                raise ValueError("the archives are read in parts: splittable=True brings these together")
            same = file is not None and pc.all(pc.equal(files, file)).as_py()
            for i, value in enumerate(batch.column(2)):
                if not same and (here := files[i].as_py()) != file:
                    if reader is not None:
                        reader.end()
                    reader, file = Reader(payload), here
                for row in reader.line(value.as_py()):
                    out.append(row)
                    size += len(row[7])
                if size >= GATHERED:
                    yield _batch(READ, out)
                    out, size = [], 0
            if out:
                yield _batch(READ, out)
        if reader is not None:
            reader.end()

    return arrow_map(found, parse, from_arrow_schema(READ))


class Reader:
    """The state between two lines of one archive: the header's fields, the bytes of the block and chunk that are left, the payload's digest so far."""

    def __init__(self, payload: bool):
        self.payload, self.state = payload, self._between

    def line(self, line: bytes) -> Iterator[tuple]:
        return self.state(line) or ()

    def end(self) -> None:
        if self.state != self._between:
            raise ValueError(f"the archive ends within record {self.fields.get('warc-record-id')}")

    def _between(self, line: bytes) -> None:
        if line:
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record where one should begin: {line[:40]!r}")
            self.fields, self.state = {}, self._header

    def _header(self, line: bytes) -> list[tuple] | None:
        if line:
            name, _, value = line.decode(errors="replace").partition(":")
            self.fields[name.strip().lower()] = value.strip()
            return None
        self.left = int(self.fields["content-length"])
        self.chunk_no, self.bytes, self.sha1, self.held = 0, 0, hashlib.sha1(), []
        self.http = self.fields.get("content-type", "").startswith("application/http")
        self.chunked, self.state = False, self._http if self.http and self.left else self._plain
        return None if self.left else self._close()

    def _http(self, line: bytes) -> list[tuple] | None:
        self.left -= len(line) + 2
        if line.lower().replace(b" ", b"") == b"transfer-encoding:chunked":
            self.chunked = True
        if line and self.left > 0:
            return None
        self.state = self._size if self.chunked else self._plain
        return self._close() if self.left <= 0 else None

    def _size(self, line: bytes) -> list[tuple] | None:
        """The line before a chunk: its size, in hexadecimal; 0 ends the payload."""
        self.left -= len(line) + 2
        self.wanted = int(line.split(b";")[0], 16) + 2
        self.state = self._data if self.wanted > 2 else self._trailer
        return None

    def _data(self, line: bytes) -> list[tuple] | None:
        """A part of a chunk up to a line end, which is the chunk's own or ends it."""
        self.left -= len(line) + 2
        self.wanted -= len(line) + 2
        if self.wanted < 0:
            raise ValueError(f"a chunk of record {self.fields.get('warc-record-id')} is longer than its size says")
        self.held.append(line if not self.wanted else line + b"\r\n")
        if self.wanted:
            return None
        self.state = self._size
        return self._row()

    def _trailer(self, line: bytes) -> list[tuple] | None:
        self.left -= len(line) + 2
        return self._close() if not line else None

    def _plain(self, line: bytes) -> list[tuple] | None:
        """A line of a block without transfer coding; the block may end before its line end."""
        data = (line + b"\r\n")[: self.left]
        self.left -= len(data)
        self.held.append(data)
        if not self.left:
            return self._row() + self._close()
        return self._row() if sum(map(len, self.held)) >= CHUNK_BYTES else None

    def _row(self) -> list[tuple]:
        data = b"".join(self.held)
        self.held = []
        self.sha1.update(data)
        self.bytes += len(data)
        self.chunk_no += 1
        return [self._made(data, self.chunk_no - 1, False)] if self.payload and data else []

    def _close(self) -> list[tuple]:
        """The record's last row, without bytes."""
        self.state = self._between
        return [self._made(b"", self.chunk_no, True)]

    def _made(self, data: bytes, chunk_no: int, last: bool) -> tuple:
        f = self.fields
        return (f.get("warc-record-id"), f.get("warc-type"), f.get(ID_FIELD.lower()), f.get("warc-target-uri"), f.get("warc-refers-to"), f.get("warc-payload-digest"), chunk_no, data, self.bytes, base32(self.sha1.digest()), last)


def read_records(chunks: DataFrame) -> DataFrame:
    """record_id, source_id, target_uri, record_type, payload_bytes, payload_digest, refers_to (the source_id of what a revisit refers to), intact.

    chunks: of read_chunks(). Size and digest are measured over the bytes read; a revisit has those of the record that it refers
    to (null where that isn't among the chunks). intact: the measured digest is the one that the record's header claims.
    """
    ends = chunks.where("last").where(F.col("record_type").isin("response", "resource", "revisit"))
    of = ends.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("source_id").alias("of_source"), F.col("bytes_so_far").alias("of_bytes"), F.col("digest_so_far").alias("of_digest"))
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("of_digest")).otherwise(F.col("digest_so_far"))
    return ends.join(of, "refers_to", "left").select(
        "record_id", "source_id", "target_uri", "record_type", F.when(revisit, F.col("of_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"), digest.alias("payload_digest"),
        F.when(revisit, F.col("of_source")).alias("refers_to"), F.coalesce(F.concat(F.lit("sha1:"), digest) == F.col("claimed"), F.lit(False)).alias("intact"),
    )


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, **how) -> None:
    """Write the pages as WARC files into the folder `path`; how: of write_archives()."""
    with own_tables(pages.sparkSession):
        chunks = chunk_table(pages, id_col, url_col, payload_col, chunk_bytes)
        write_archives(chunks, written(header_table(chunks, least_bytes), "warc-headers"), path, **how)
