"""WARC archives of pages, and a splittable reader for them."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.session import settle, shared_dir

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 1000
SPLIT_BYTES = 8 << 20
WINDOW = 1 << 20
# Dates are no part of the pages table; every record carries this one.
DATE = "1970-01-01T00:00:00Z"
PARTS = ("page_id", "url", "payload", "digest", "refers_to")
MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest and refers_to of every row; null html is an empty payload.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response
    (refers_to null), the others revisit it. Equal means same SHA-256 and length; the SHA-1 is what
    archives state. Rows that repeat the largest page_id are all responses; a null page_id is smaller than
    any other. Copies are counted together before they meet, and only repeated payloads are joined back.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= least
    copies = (
        rows.where(long_enough)
        .groupBy(F.sha2("payload", 256).alias("same"))
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    keyed = rows.withColumn("same", F.when(long_enough, F.sha2("payload", 256)))
    joined = keyed.join(copies, "same", "left")
    revisit = F.when(F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page/{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the HTTP headers of the page and no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(rows: DataFrame, folder: str, max_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write the rows of ``with_revisits`` as gzipped WARC files below ``folder``, which all tasks must reach.

    Each task writes its own files under names of its attempt, and a new one beyond ``max_bytes``. The
    returned manifest (path, bytes, records) is a stored table: files of attempts that failed are not in it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, file, size, records, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in PARTS), strict=True):
                if out is None:
                    file, size, records = f"{name}-{len(done):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                data = member(record(*row), level)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= max_bytes:
                    out.close()
                    done.append((f"{folder}/{file}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{file}", size, records))
        yield _table(done, MANIFEST)

    return settle(rows.select(*PARTS).mapInArrow(write, MANIFEST))


def _inflate(source, at: int, first: bytes, most: int | None = None) -> bytes:
    """The gzip member that begins at ``at``, or its first ``most`` bytes. ``first`` is what is read there."""
    reader, out, chunk = zlib.decompressobj(31), [], first
    got = 0
    while chunk:
        part = reader.decompress(chunk, 0 if most is None else most - got)
        out.append(part)
        got += len(part)
        at += len(chunk)
        if reader.eof or (most is not None and got >= most):
            return b"".join(out)
        chunk = source.read_at(WINDOW, at) if at < source.size() else b""
    raise zlib.error("the member does not end")


def _starts(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Places in [start, end) where a gzip member with a WARC record begins, and the bytes read there."""
    size = source.size()
    at = start
    while at < end:
        window = source.read_at(min(WINDOW, size - at), at)
        place = window.find(MAGIC)
        while place >= 0 and at + place < end:
            first = window[place:]
            if len(first) < 4096 and at + len(window) < size:
                first = source.read_at(min(WINDOW, size - at - place), at + place)
            try:
                valid = _inflate(source, at + place, first[:4096], 8).startswith(b"WARC/1.")
            except zlib.error:
                valid = False
            if valid:
                yield at + place, first
            place = window.find(MAGIC, place + 1)
        at += max(1, len(window) - len(MAGIC) + 1)


def parse(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = [fields.get(x) for x in ("X-Page-Id", "X-Refers-To-Page-Id")]
    own, other = (None if x is None else int(x) for x in number)
    return own, fields.get("WARC-Target-URI"), fields["WARC-Type"], other, digest, length, payload


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archives in ``manifest`` (path, bytes), read in byte ranges by independent tasks.

    A task scans its range for the gzip magic, accepts a place only if the member decodes to a WARC header,
    and owns the records that start inside, reading on past its end where the last one needs it. Payload
    digests are checked. An empty manifest gives an empty table.
    """
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    )
    spread = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                out, held, start = [], 0, row["start"]
                with store.open_input_file(path) as source:
                    for at, first in _starts(source, start, min(start + split_bytes, row["bytes"])):
                        out.append(parse(_inflate(source, at, first)))
                        held += len(out[-1][-1])
                        if held > 4 << 20:
                            yield _table(out, RECORDS)
                            out, held = [], 0
                yield _table(out, RECORDS)

    return spread.mapInArrow(scan, RECORDS)


def archive_folder(spark: SparkSession) -> str:
    folder = shared_dir(spark)
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
