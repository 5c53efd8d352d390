"""WARC archives: a writer with revisit records, and a splittable reader.

write_archives() puts a record of each page, a gzip member of its own, into
archives in a shared folder, one a task, under a name of the attempt, so that
a task that runs again writes another file; the manifest lists the files of
the tasks that succeeded. Of pages with equal payloads (by SHA-1) of at least
`least_bytes` bytes, the one with the largest page_id is a response, the others
are revisits that refer to it and hold no payload.

read_archives() cuts the files into byte ranges. A task scans its range for
gzip magic, validates each candidate by decoding the head of its record, and
owns the records that start inside its range, reading past its end where a
record goes on. Members stand one behind another, so after the first valid
one the next begins where it ends.

A null html is an empty payload; a very long one is one record, whatever range
its end lies in. Rows with the same page_id and payload are
written each, with the same type. A null page_id comes before all others and
is passed on as null. An empty table gives no records. Other columns of the
input are ignored. Files are reached through pyarrow's file systems (local,
HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
HEAD_BYTES = 4096
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None):
    digits = name[len("<urn:page:") : -1] if name else ""
    return int(digits) if digits else None


def record(page_id, url, payload: bytes, digest: str, response_id, size: int) -> bytes:
    """One record: a response with its payload, or a revisit (response_id given) with the HTTP head alone."""
    revisit = response_id is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in (url or "") if c not in "\r\n")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {uri}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(response_id)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple:
    """A decoded record as a row of RECORDS; a payload that contradicts its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = field["warc-type"], field.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != found:
            raise ValueError(f"record {field['warc-record-id']}: its payload has digest {found}, not {digest}")
        digest = found
    else:
        sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size, payload = int(sizes[0]) if sizes else 0, None
    return page_of(field["warc-record-id"]), field.get("warc-target-uri"), kind, page_of(field.get("warc-refers-to")), size, digest, payload


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, response_id) of each page that another one's payload stands for; no payload is moved."""
    keys = pages.select("page_id", "digest", "size").where(F.col("size") >= least_bytes)
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1")
    # a new expression as key: both sides are shuffled for the join, so that a hot digest can be split
    groups = groups.select(F.concat("digest", F.lit(b"")).alias("key"), "response_id")
    found = keys.join(groups, keys.digest == groups.key).where("page_id IS NULL AND response_id IS NOT NULL OR page_id < response_id")
    return found.select("page_id", "digest", "response_id").dropDuplicates(["page_id", "digest"])


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", level: int = 6) -> DataFrame:
    """Write the archives now; the manifest (path, bytes, records) as a written table."""
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("html"))
    df = df.select("*", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("size"))
    again = revisits(df, least_bytes).withColumnsRenamed({"page_id": "id2", "digest": "digest2"})
    df = df.join(again, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")
    df = df.select("page_id", "url", F.when(F.col("response_id").isNull(), F.col("html")).alias("html"), "digest", "size", "response_id")
    files, root = file_system(folder)
    files.create_dir(root, recursive=True)

    def run(batches):
        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        out, total, count = None, 0, 0
        for batch in batches:
            for page_id, url, html, digest, size, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system, name = file_system(path)
                    out = system.open_output_stream(name, compression=None)
                data = member(record(page_id, url, html or b"", base64.b32encode(digest).decode(), response_id, size), level)
                out.write(data)
                total, count = total + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.record_batch({"path": [path], "bytes": pa.array([total], pa.int64()), "records": pa.array([count], pa.int64())})

    return runtime.written(df.mapInArrow(run, "path string, bytes long, records long"), "manifest")


class Source:
    """A file read in blocks, forwards."""

    def __init__(self, path: str, size: int, block: int = 1 << 20):
        system, name = file_system(path)
        self.file, self.size, self.block = system.open_input_file(name), size, block

    def at(self, start: int, n: int | None = None) -> bytes:
        return self.file.read_at(max(0, min(n or self.block, self.size - start)), start)


def is_head(data: bytes) -> bool:
    """Whether a gzip member that starts here begins with a WARC record's head."""
    try:
        return zlib.decompressobj(31).decompress(data, 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def decode(source: Source, start: int) -> tuple[bytes, int]:
    """The member at `start`, decoded, and where it ends."""
    z, at, out = zlib.decompressobj(31), start, []
    while not z.eof:
        data = source.at(at, 1 << 16)
        if not data:
            raise ValueError(f"the member at {start} ends before its stream does")
        out.append(z.decompress(data))
        at += len(data)
    return b"".join(out), at - len(z.unused_data)


def first_member(source: Source, start: int, end: int) -> int | None:
    """The first valid member that starts in [start, end)."""
    at = start
    while at < end:
        data = source.at(at, min(source.block, end - at) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        while hit >= 0:
            if is_head(source.at(at + hit, HEAD_BYTES)):
                try:
                    _, after = decode(source, at + hit)
                    if after == source.size or source.at(after, len(MAGIC)) == MAGIC:
                        return at + hit
                except (zlib.error, ValueError):
                    pass
            hit = data.find(MAGIC, hit + 1)
        at += max(1, len(data) - len(MAGIC) + 1)
    return None


def records_of(path: str, size: int, start: int, end: int):
    """The records that start in [start, end), as rows of RECORDS."""
    source = Source(path, size)
    at = first_member(source, start, end)
    while at is not None and at < end:
        data, at = decode(source, at)
        yield parse(data)


def read_archives(manifest: DataFrame, *, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the files of a manifest (path, bytes), read range by range."""
    step = int(range_bytes)
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start"))
    spark = manifest.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(manifest.select(F.sum(F.ceil(F.col("bytes") / step))).first()[0] or 0))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                held, room = [], 0
                for row in records_of(path, size, start, min(start + step, size)):
                    held.append(row if payloads else (*row[:-1], None))
                    room += len(row[-1] or b"") if payloads else 100
                    if room > runtime.SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, room = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return ranges.repartition(n, "path", "start").mapInArrow(run, RECORDS)


def op8_warc(spark, sf_dir):
    folder = f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(runtime.table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """Digests, types and references straight from the table, in DuckDB; base32 from the hex digits, five bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = "(strpos('0123456789abcdef', substr(h, CAST({} AS INT), 1)) - 1)"
    pair = f"({digit.format('5 * i // 4 + 1')} * 16 + (CASE WHEN 5 * i // 4 + 2 > 40 THEN 0 ELSE {digit.format('5 * i // 4 + 2')} END))"
    value = f"(({pair} >> CAST(3 - (5 * i) % 4 AS INT)) & 31)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('{letters}', CAST({value} + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN m USING (h)
"""
