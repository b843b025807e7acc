"""WARC archives: written one gzip member a record, read back in sequence.

A task writes the records of its partition to one archive on the shared folder
and answers with a line of the manifest. Only archives that the manifest names
are read, so what a lost or repeated task left behind is never seen. The reader
inflates members as the bytes come, frames blocks by Content-Length and checks
digests; a damaged record raises.

Null html is an empty payload. Rows that repeat a page_id are records of their
own; of equal payloads all rows with the largest page_id are responses. A null
page_id is written as an empty record name and read back as null; it never is
the response that others refer to while another page has the payload. Very long
payloads are one record each. An empty table gives no archive and an empty table.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import stored
from recordloom.session import scratch_path, table

LEAST_BYTES = 1_000        # payloads below it are never revisits
READ_BYTES = 1 << 18       # of an archive at a time
ARCHIVE_BYTES = 64 << 20   # of payload in one archive, about
DATE = "1970-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "archive string, records bigint, bytes bigint"
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes bigint, payload_digest string, payload binary"


class Damaged(ValueError):
    """A record that is not as its headers say."""


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One record as a gzip member of its own.

    A revisit has the headers of the response only; its digest and length are
    those of the full payload.
    """
    block = HTTP + (payload if kind == RESPONSE else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(size),
        "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if kind == REVISIT:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def members(source: io.RawIOBase, size: int = READ_BYTES) -> Iterator[bytes]:
    """The inflated members of a gzip file, read a piece at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    begun = False
    while True:
        data = data or source.read(size)
        if not data:
            if begun:
                raise Damaged("the archive ends inside a record")
            return
        begun = True
        try:
            out.append(z.decompress(data))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out, begun = zlib.decompressobj(31), [], False


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record; lengths and digests are checked."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise Damaged("no record begins here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged(f"a block of {len(rest) - 4} bytes where {n} are announced")
    block = rest[:n]
    said = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if said and hashlib.sha1(block).hexdigest() != said:
        raise Damaged("block digest")
    if headers["warc-type"] == RESPONSE:
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
            raise Damaged("payload digest")
    return headers, block


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, size and refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    named = stored(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= LEAST_BYTES), "digests")
    groups = stored(named.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last"), "equal")
    again = named.join(groups, "digest").where(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")))
    again = stored(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "last").distinct(), "revisits")
    full = pages.select("page_id", "url", F.encode(html, "UTF-8").alias("payload"), F.sha1(html).alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
    return full.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_d")), "left").select(
        "page_id", "url", "payload", "digest", "size", F.col("last").alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) under ``folder``; gives the manifest."""
    spark = pages.sparkSession
    rows = with_revisits(pages)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = out = None
        n = size = held = 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            ids, urls, payloads, digests, sizes, refers = batch.columns
            for k in range(len(batch)):
                if out is None:
                    name, n, size, held = f"{uuid.uuid4().hex}.warc.gz", 0, 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                to, payload = refers[k].as_py(), payloads[k].as_py()
                data = record(RESPONSE if to is None else REVISIT, ids[k].as_py(), urls[k].as_py(), payload, digests[k].as_py(), sizes[k].as_py(), to)
                out.write(data)
                n, size, held = n + 1, size + len(data), held + len(payload)
                if held >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(rows.mapInArrow(put, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest; without ``payloads`` that column is null."""
    whole = id_type in ("bigint", "int")
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kind = kinds[id_type]

    def name(value: str | None):
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return (int(text) if whole else text) if text else None

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(f"{base}/{archive}", compression=None) as source:
                    for member in members(source):
                        h, block = parse(member)
                        payload = block.partition(b"\r\n\r\n")[2]
                        rows.append((name(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], name(h.get("warc-refers-to")),
                                     int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), payload if payloads else None))
                        held += len(payload)
                        if held >= READ_BYTES * 16:
                            yield _records(rows, kind)
                            rows, held = [], 0
                if rows:
                    yield _records(rows, kind)

    archives = manifest.select("archive")
    return archives.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "archive").mapInArrow(get, RECORD.format(id=id_type))


def _records(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    a = list(zip(*rows, strict=True))
    types = (kind, pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.binary())
    names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(a, types, strict=True)], names=names)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    back = read(write(pages, folder), folder, pages.schema["page_id"].dataType.simpleString(), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""
