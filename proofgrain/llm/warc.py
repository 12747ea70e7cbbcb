"""WARC archives of pages: a writer with payload revisits, and a splittable reader.

Writer: one record per page, each its own gzip member.  Pages of equal payload are found by
their digest; the smallest page_id is a ``response``, the others are ``revisit`` records that
refer to it.  Payloads shorter than ``revisit_from`` bytes are always responses.

Reader: archives are cut into byte ranges without regard to members.  A task looks for the
gzip magic in its range, takes a place for a member only if it decodes and begins with a WARC
header, and owns each record that starts inside its range, reading on past the range's end to
finish the last one.

Null html is an empty payload.  Rows that repeat both the smallest page_id and its payload are
all responses.  A null page_id sorts after all others.  Null urls get a ``urn:page:`` target.
An empty table gives no archive and no rows.  Columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrain.llm.common import batch, new_folder, staged, utf8
from proofgrain.llm.huffman import files_at

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
READ_BYTES = 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One WARC record, uncompressed."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, revisit_from: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives; returns their manifest: path, size, records."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    smallest = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    dealt = rows.join(smallest, "digest").select(
        "page_id", "url", "html", "refers_to", (~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("html") >= revisit_from)).alias("revisit"))
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())])
    target, base = files_at(folder)
    target.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = files_at(folder)
        part, out, name, size, n, done = TaskContext.get().partitionId(), None, "", 0, 0, []
        for rows in batches:
            for page, url, payload, first, again in zip(rows.column("page_id").to_pylist(), rows.column("url").to_pylist(), utf8(rows.column("html")), rows.column("refers_to").to_pylist(), rows.column("revisit").to_pylist(), strict=True):
                if out is None:
                    name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = fs.open_output_stream(name, compression=None), 0, 0
                data = member(record(page, url, payload, digest_of(payload), first, again))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        yield batch(schema, *([x[i] for x in done] for i in range(3)))

    return staged(dealt.mapInArrow(run, "path string, size bigint, records bigint"), "manifest")


def parsed(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a record, or None if this isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.lower()] = value.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return fields, rest[: int(length)]


def owned_records(source, size: int, begin: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of the members that start in [begin, end) of an open file."""
    buffer, base = b"", begin  # buffer holds the bytes from base on

    def more() -> bool:
        nonlocal buffer
        at = base + len(buffer)
        if at >= size:
            return False
        source.seek(at)
        buffer += source.read(min(read_bytes, size - at))
        return True

    while base < end:
        at = buffer.find(MAGIC)
        if at < 0:
            drop = max(0, len(buffer) - len(MAGIC) + 1)
            buffer, base = buffer[drop:], base + drop
            if not more():
                return
            continue
        buffer, base = buffer[at:], base + at
        if base >= end:
            return
        unpacker, out, fed, good = zlib.decompressobj(31), [], 0, True
        try:
            while not unpacker.eof:
                if fed == len(buffer) and not more():
                    good = False
                    break
                out.append(unpacker.decompress(buffer[fed:]))
                fed = len(buffer)
                if len(out) == 1 and not out[0][:7] == b"WARC/1."[: len(out[0])]:
                    good = False
                    break
        except zlib.error:
            good = False
        found = parsed(b"".join(out)) if good else None
        taken = fed - len(unpacker.unused_data) if found else 1
        buffer, base = buffer[taken:], base + taken
        if found:
            yield found


def read(spark: SparkSession, manifest: DataFrame, folder: str, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest and, if asked for, payload (null for revisits)."""
    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint"))).alias("begin")
    ranges = manifest.where("size > 0").select("path", "size", begin).repartition(spark.sparkContext.defaultParallelism * 2, "path", "begin")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = files_at(folder)
        for rows in batches:
            for path, size, begin in zip(*(rows.column(c).to_pylist() for c in ("path", "size", "begin")), strict=True):
                out, held = [], 0
                with fs.open_input_file(path) as source:
                    for fields, block in owned_records(source, size, begin, begin + split_bytes):
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                        payload, n = None, int(fields["x-payload-length"])
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if digest_of(payload) != digest or len(payload) != n:
                                raise ValueError(f"{path}: the payload of {fields['warc-record-id']} is damaged")
                        page, first = (int(fields[x]) if x in fields else None for x in ("x-page-id", "x-refers-to-page"))
                        out.append((page, fields["warc-target-uri"], kind, first, n, digest, payload if payloads else None))
                        held += len(payload or b"") * payloads
                        if held > 8 << 20:
                            yield batch(schema, *([x[i] for x in out] for i in range(7)))
                            out, held = [], 0
                yield batch(schema, *([x[i] for x in out] for i in range(7)))

    return ranges.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    return read(spark, write(pages, folder, revisit_from), folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex),
bits AS (
  SELECT hex, first_id, array_to_string(list_transform(string_split(hex, ''), lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', CAST(4 * (instr('0123456789abcdef', h) - 1) + 1 AS BIGINT), 4)), '') AS b
  FROM first),
named AS (
  SELECT hex, first_id, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest
  FROM bits)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN named USING (hex)
"""
