"""WARC archives with revisit records resolved.

1. Every page becomes a response record of an archive, written by the task that holds it; only headers
   (where the record lies, payload digest and length) come back.
2. Headers are shuffled by payload digest: the smallest page_id of each digest is its original, and
   the other records join it to become revisits. Payloads don't move.
3. Each archive is read again with its records' decisions and written anew with fresh headers:
   originals whole, revisits without payload, naming the original's record and URI.

Archives are gzip members, one a record, and can be read by any WARC reader.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, open_shared, partitions, pieces_of, stored

#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Uncompressed bytes from which a task starts a new archive.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member; header values lose line breaks."""
    lines = ["WARC/1.1"] + [f"{k}: {' '.join(v.split())}" for k, v in headers.items()] + [f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an archive, one at a time."""
    at, left = 0, b""
    while True:
        z, out, start, used = zlib.decompressobj(31), [], at, 0
        while not z.eof:
            data = left or stream.read(1 << 20)
            left = b""
            if not data:
                break
            used += len(data)
            out.append(z.decompress(data))
        if not used:
            return
        if not z.eof:
            raise ValueError("an archive is cut short")
        left = z.unused_data
        at += used - len(left)
        raw = b"".join(out)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield start, headers, rest[: int(headers["Content-Length"])]


def _page(value: int | None) -> str:
    return "" if value is None else str(value)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives with a response for every page; a row of headers for each: page_id, uri, archive, at, digest, payload_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = path = None
        size = at = 0
        for batch in pieces_of(batches):
            rows = []
            for page, uri, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f is None:
                    path, size, at = f"{folder}/raw-{uuid.uuid4().hex}.warc.gz", 0, 0
                    f = open_shared(path, "wb")
                payload = html.encode()
                digest = hashlib.sha256(payload).hexdigest()
                own = record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response", "X-Page-ID": _page(page), "X-Payload-Length": str(len(payload))}, HTTP + payload)
                f.write(own)
                rows.append((page, uri, path, at, digest, len(payload)))
                at += len(own)
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    f.close()
                    f = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["page_id", "uri", "archive", "at", "digest", "payload_bytes"])
        if f is not None:
            f.close()

    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("uri"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return stored(clean.mapInArrow(run, "page_id long, uri string, archive string, at long, digest string, payload_bytes long"), "warc-headers")


def resolve(headers: DataFrame) -> DataFrame:
    """Every record's archive and place, with the original (page_id, uri) it revisits, if any.

    The original of a digest is its smallest page_id (nulls last), then place; a digest's minimum is
    aggregated before the shuffle, and only digests with more records are joined.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "at", "uri")
    first = headers.where(F.col("payload_bytes") >= LEAST).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = headers.alias("h").join(first.alias("f"), "digest", "left")
    again = F.col("first").isNotNull() & ~((F.col("h.archive") == F.col("first.archive")) & (F.col("h.at") == F.col("first.at")))
    return joined.select("h.archive", "h.at", again.alias("again"), F.when(again, F.col("first.page_id")).alias("refers_to"), F.when(again, F.col("first.uri")).alias("refers_uri"))


def rewrite(decisions: DataFrame, folder: str) -> DataFrame:
    """Write each archive anew; returns a row (archive) per new file. A task holds one archive's decisions."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        todo = dict(zip(group["at"].to_pylist(), zip(group["again"].to_pylist(), group["refers_to"].to_pylist(), group["refers_uri"].to_pylist(), strict=True), strict=True))
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        with open_shared(key[0].as_py(), "rb") as source, open_shared(path, "wb") as out:
            for at, headers, block in records(source):
                again, page, uri = todo[at]
                new = {k: v for k, v in headers.items() if k != "Content-Length"} | {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>"}
                if again:
                    new |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": uri or "", "WARC-Refers-To-Date": DATE, "X-Refers-To-Page-ID": _page(page)}
                    block = HTTP
                out.write(record(new, block))
        return pa.table({"archive": [path]})

    # few rows stand for much work: tasks by number, which adaptive execution doesn't merge
    dealt = decisions.repartition(partitions(decisions.sparkSession), "archive")
    return stored(dealt.groupBy("archive").applyInArrow(run, "archive string"), "warc-files")


def read_back(archives: DataFrame) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are taken from its payload (and must be those of its headers), a
    revisit's from its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open_shared(path, "rb") as f:
                    for _, h, block in records(f):
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = block[len(HTTP) :]
                            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, n):
                                raise ValueError(f"a payload of {path} isn't what its headers say")
                        rows.append((number(h["X-Page-ID"]), n, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def deduplicated_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The archives (one row each) that hold every page once as response or as a revisit of an equal payload.

    Null html counts as empty (payloads under 100 bytes are always responses); null urls are empty; a
    null page_id is never the original while a page of its digest has one; of repeated rows one is the
    response and the others revisit it; an empty table gives no archives; other columns play no part.
    """
    folder = folder or new_path(spark, "warc")
    headers = write(pages, folder)
    decisions = resolve(headers)
    out = rewrite(decisions, folder)
    raw = headers.select("archive").distinct().toPandas()["archive"]
    for path in raw:  # one path a file, as many as tasks wrote
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)
    discard(headers)
    n = out.count()
    return out.repartition(max(1, min(n, partitions(spark))))
