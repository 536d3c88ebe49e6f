"""WARC archives read and written as chunk rows.

``write_archives`` streams payloads to gzip members, one member a record.  ``read_chunks``
gives the chunked record table: a row per record and chunk number with the chunk's bytes,
its place, and the SHA-1 of the payload up to its end; the last chunk of a record is
marked and so carries the digest and length of the whole payload.  Neither holds more of a
record than a chunk, besides what the input row itself holds.

Of records with equal payloads the one with the largest id is written in full; the others
are revisit records that name it.  Equality is that of SHA-1 and length.

Every task attempt writes files under new names and returns them as rows, which Spark
commits to the manifest; only files of the manifest are read.

Contract: a null payload is empty, a null url is an empty target.  Ids are expected to be
unique; of equal payloads with equal ids all are written in full.  A record with a null id
never stands for others, and is written in full unless another has its payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import blocks, file_system, shared_folder, stored

#: Bytes of a chunk.
CHUNK = 1 << 20
#: Bytes of payload in an archive, after which a task begins another.
ARCHIVE = 1 << 29
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records have no time of capture in the table; a fixed one keeps archives reproducible.
DATE = b"1970-01-01T00:00:00Z"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(record: object) -> bytes:
    """The record id of a page, a name-based UUID."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{record}')}>".encode()


def revisits(pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", min_bytes: int = 0) -> DataFrame:
    """``id, url, payload`` and ``refers_to``: the id whose record this one revisits, else null."""
    rows = pages.select(
        F.col(f"`{id_column}`").alias("id"),
        F.coalesce(F.col(f"`{url_column}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload_column}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    keys = rows.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    full = (
        keys.where(F.col("size") >= min_bytes)
        .groupBy("digest", "size")
        .agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    found = rows.join(full, ["digest", "size"], "left")
    return found.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes ``rows`` of ``revisits`` and returns the stored manifest: ``file, records``."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)

    def run(batches):
        out, written, records, name = None, 0, 0, ""
        for table in blocks(batches, 8 << 20, "payload"):
            for record, url, payload, refers in zip(*(table.column(x) for x in ("id", "url", "payload", "refers_to")), strict=True):
                if out is None or written >= ARCHIVE:
                    if out:
                        out.close()
                        yield _manifest(name, records)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    files, place = file_system(f"{folder}/{name}")
                    out, written, records = files.open_output_stream(place, compression=None), 0, 0
                body = memoryview(payload.as_buffer())
                _write_record(out, record.as_py(), url.as_py(), body, refers.as_py(), chunk)
                written, records = written + len(body), records + 1
        if out:
            out.close()
            yield _manifest(name, records)

    manifest = rows.mapInArrow(run, "file string, records bigint")
    return stored(manifest, folder, "manifest")


def _manifest(name: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])


def _write_record(out, record: object, url: str, body: memoryview, refers: object, chunk: int) -> None:
    sha = hashlib.sha1()
    for i in range(0, len(body), chunk):
        sha.update(body[i : i + chunk])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    full = refers is None
    fields = [
        (b"WARC-Type", b"response" if full else b"revisit"),
        (b"WARC-Record-ID", record_uri(record)),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", " ".join(url.split()).encode()),
        (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(sha.digest()).encode()),
        (b"X-Page-ID", b"" if record is None else str(record).encode()),
    ]
    if not full:
        fields += [(b"WARC-Refers-To", record_uri(refers)), (b"X-Refers-To-Page-ID", str(refers).encode()), (b"WARC-Profile", PROFILE)]
    fields += [(b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % (len(http) + len(body) * full))]
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(gzip.compress(VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + http))
    if full:
        for i in range(0, len(body), chunk):
            out.write(gzip.compress(body[i : i + chunk]))
    out.write(gzip.compress(b"\r\n\r\n") + gzip.flush())


class _Members:
    """The bytes of a file of gzip members, a bounded buffer at a time."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.raw, self.ready, self.gzip = source, step, b"", bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            made = self.gzip.decompress(self.raw, self.step)
            self.raw = self.gzip.unconsumed_tail
            if self.gzip.eof:
                self.raw, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
            if made:
                self.ready += made
                return True

    def head(self) -> bytes | None:
        """Everything up to the next empty line, which is dropped; None at the end of the file."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.ready.strip():
                    raise OSError("the archive ends within a record")
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 4]
        return out

    def take(self, size: int) -> bytes:
        while len(self.ready) < size:
            if not self._more():
                raise OSError("the archive ends within a record")
        out = bytes(self.ready[:size])
        del self.ready[:size]
        return out


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def chunks_of(source, chunk: int = CHUNK):
    """Chunk rows of an open archive: record id, its fields, chunk number, offset, bytes, digest so far, last."""
    members = _Members(source)
    while (head := members.head()) is not None:
        fields = _fields(head)
        http = members.head()
        left = int(fields[b"content-length"]) - len(http) - 4
        length = int(_fields(http)[b"content-length"])
        sha, number, offset = hashlib.sha1(), 0, 0
        while True:
            data = members.take(min(chunk, left))
            sha.update(data)
            left -= len(data)
            yield fields, length, number, offset, data, sha.digest(), not left
            offset, number = offset + len(data), number + 1
            if not left:
                break
        if members.take(4) != b"\r\n\r\n":
            raise OSError("a record does not end with two empty lines")


def read_chunks(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest.

    ``record_id, chunk_no, last, page_id, url, record_type, refers_to, offset, chunk_bytes, payload_bytes``
    (of the whole payload, as the record states), ``digest_so_far, payload_digest`` (as the record states),
    ``intact`` (on the last chunk of a response: computed digest and length are the stated ones) and ``data``.
    An empty payload gives one empty chunk, a revisit record as well.
    """
    names = ["record_id", "chunk_no", "last", "page_id", "url", "record_type", "refers_to", "offset", "chunk_bytes", "payload_bytes", "digest_so_far", "payload_digest", "intact", "data"]
    text, number, flag = pa.string(), pa.int64(), pa.bool_()
    kinds = [text, number, flag, text, text, text, text, number, number, number, text, text, flag, pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        rows, held = [], 0
        for given in batches:
            for name in given.column("file").to_pylist():
                files, path = file_system(f"{folder}/{name}")
                with files.open_input_stream(path, compression=None) as source:
                    for fields, length, at, offset, data, digest, last in chunks_of(source, chunk):
                        stated = fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                        kind = fields[b"warc-type"].decode()
                        so_far = base32_sha1(digest)
                        good = (so_far == stated and offset + len(data) == length) if last and kind == "response" else None
                        rows.append(
                            (fields[b"warc-record-id"].strip(b"<>").decode(), at, last, fields[b"x-page-id"].decode() or None, fields[b"warc-target-uri"].decode(), kind)
                            + (fields[b"x-refers-to-page-id"].decode() if b"x-refers-to-page-id" in fields else None, offset, len(data), length, so_far, stated, good)
                            + (data if with_data else None,)
                        )
                        held += len(data) * with_data + 500
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    schema = (
        "record_id string, chunk_no bigint, last boolean, page_id string, url string, record_type string, refers_to string, offset bigint, "
        "chunk_bytes bigint, payload_bytes bigint, digest_so_far string, payload_digest string, intact boolean, data binary"
    )
    files = manifest.select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns their chunk table, without data."""
    folder = shared_folder(spark, "warc")
    manifest = write_archives(revisits(pages, id_column, payload_column, url_column, min_bytes), folder)
    return read_chunks(spark, manifest, folder, with_data=False)
