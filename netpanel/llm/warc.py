"""WARC archives, written with an index and read back through it.

Every page is one gzip member of a WARC 1.1 file. Of the pages with equal payloads of at least
``least_bytes``, that with the largest page_id is a response and the others are revisits, which hold no
payload but its digest and the page they refer to. The index is written first-class: a row for each
record with file, offset, length, URL, digest and type. Readers select index rows, sort them by file and
offset, join neighbouring ranges into one read, and parse only those bytes.

Equal payloads are found by SHA-1 and length, aggregated before any shuffle of rows; a payload that a
third of all pages share is looked up by broadcast (``shared.lookup``), so no task gets all its copies.

Nulls, empties, repeats: a null html is an empty payload, a null url leaves the target URI out, and
control characters in a URL are percent-encoded. A page with a null page_id is a response of its
own and is not referred to. If rows repeat the largest page_id of a payload, each is a response. An empty
table gives no archive and no row. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared

#: Ranges of one archive nearer than this are read by one call, of at most READ_BYTES.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
#: The date of all records.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
#: Bytes of archives that a task reads.
TASK_BYTES = 128 << 20

INDEX_COLUMNS = "path string, offset long, length long, page_id long, url string, digest string, record_type string"
INDEX_NAMES = [c.split()[0] for c in INDEX_COLUMNS.split(", ")]


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    h = hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """The bytes of a record, its payload's digest and its type."""
    digest = digest_of(payload)
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush(), digest, kind


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; checks lengths and, of a response, the digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if len(rest) != len(block) + 4 or fields["WARC-Type"] == "response" and f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return fields, payload


def originals(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, int]:
    """Of each payload that several pages have: digest, keeper (the largest page_id), copies; and the number of pages."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    found = pages.select(F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"), F.col("page_id").cast("long").alias("page_id"))
    total = pages.count()
    groups = shared.written(found.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "payloads", rows=total)
    return groups.select("digest", "keeper", "copies"), total


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes an archive for each task below ``folder``; returns the index, which is written too."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = shared.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():08d}.warc.gz"
        attempt, out, at = f"{root}/{name}.{task.taskAttemptId()}", None, 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None:
                        out = fs.open_output_stream(attempt, compression=None)
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    member, digest, kind = record(row["page_id"], row["url"], payload, row["refers_to"])
                    rows.append((f"{folder}/{name}", at, len(member), row["page_id"], row["url"], digest, kind))
                    at += out.write(member)
                columns = zip(*rows, strict=True) if rows else [[]] * len(INDEX_NAMES)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=INDEX_NAMES)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            fs.move(attempt, f"{root}/{name}")

    shared.bound_batches(pages)
    groups, total = originals(pages, least_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = shared.lookup(rows.withColumn("digest", F.sha1(payload)), groups, "digest", "copies", total)
    refers = F.when((F.octet_length(payload) >= least_bytes) & (F.col("page_id") != F.col("keeper")), F.col("keeper"))
    return shared.written(rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(archive, INDEX_COLUMNS), "warc-index")


def read_ranges(fs, path: str, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of ranges (offset, length) sorted by offset; near ones share a read."""
    with fs.open_input_file(path) as f:
        k = 0
        while k < len(ranges):
            begin, end, j = ranges[k][0], sum(ranges[k]), k + 1
            while j < len(ranges) and ranges[j][0] - end <= GAP_BYTES and sum(ranges[j]) - begin <= READ_BYTES:
                end = max(end, sum(ranges[j]))
                j += 1
            data = f.read_at(end - begin, begin)
            for offset, length in ranges[k:j]:
                yield data[offset - begin : offset - begin + length]
            k = j


def read_archives(selected: DataFrame, keep_html: bool = False) -> DataFrame:
    """Reads the records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, tuple] = {}
        for batch in batches:
            want: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                want.setdefault(path, []).append((offset, length))
            for path, ranges in want.items():
                fs, local = handles[path] if path in handles else handles.setdefault(path, shared.filesystem(path))
                rows = []
                for member in read_ranges(fs, local, ranges):
                    fields, payload = parse(member)
                    number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                    row = (number("X-Page-ID"), fields.get("WARC-Target-URI"), number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page-ID"))
                    rows.append((*row, payload.decode("utf-8", "surrogatepass") if fields["WARC-Type"] == "response" else None) if keep_html else row)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * keep_html]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * keep_html]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * keep_html
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    ranged = selected.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return ranged.mapInArrow(read, schema)
