"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A shard is two files. ``shard-N.rec`` holds one frame for each document:

    u64 payload length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload

(all little-endian; the mask rotates by 15 bits and adds a constant, so that a checksum of data that
holds checksums stays useful). The payload is the document's ids as little-endian integers of the
width that the vocabulary needs. ``shard-N.idx`` holds a header (magic, id width, number of frames)
and then for each frame the key, the offset, the number of ids and flags, of fixed size, so that any
frame is found by its number and read alone.

Shards are ascending ranges of doc_id, sorted within. A task writes its shard under a name of its own
attempt and renames it when it is whole, so a lost or repeated task leaves no half shard; a shard's
place in the order is its partition's.

Nulls, empties, repeats: a null text is an empty one, whose record holds only the end id. A null
doc_id sorts first, and comes back as null. Repeated doc_ids keep a record each, ordered by text.
An empty table gives no shard and no row. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.llm import shared, tokens

# Fixed values of the file format: the mask's constant (as in other masked-checksum record files), magic, index layout.
MASK_DELTA = 0xA282EAD8
MAGIC = b"NPREC\x01\x00\x00"
INDEX = np.dtype([("key", "<i8"), ("offset", "<u8"), ("n_ids", "<u4"), ("flags", "<u4")])
NULL_KEY = 1

#: Ranges of one shard nearer than this are read by one call.
GAP_BYTES = 1 << 16
#: Most bytes of one call.
READ_BYTES = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> bytes:
    """The payload of the frame that begins at ``at``; raises ValueError if a checksum is wrong."""
    head = bytes(data[at : at + 8])
    (size,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked(head):
        raise ValueError(f"the length at byte {at} is damaged")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or struct.unpack("<I", data[at + 12 + size : at + 16 + size])[0] != masked(payload):
        raise ValueError(f"the record at byte {at} is damaged")
    return payload


def write_shard(fs, path: str, attempt: str, rows: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Writes rows (key, payload) to path.rec and path.idx; returns the numbers of records and ids."""
    at, entries, total = 0, [], 0
    with fs.open_output_stream(f"{path}.rec.{attempt}") as out:
        for key, payload in rows:
            entries.append((key or 0, at, len(payload) // width, NULL_KEY if key is None else 0))
            at += out.write(frame(payload))
            total += len(payload) // width
    with fs.open_output_stream(f"{path}.idx.{attempt}") as out:
        out.write(MAGIC + struct.pack("<II", width, 0) + struct.pack("<Q", len(entries)))
        out.write(np.array(entries, INDEX).tobytes())
    for kind in ("rec", "idx"):
        fs.move(f"{path}.{kind}.{attempt}", f"{path}.{kind}")
    return len(entries), total


def read_index(fs, path: str) -> tuple[np.dtype, np.ndarray]:
    with fs.open_input_file(f"{path}.idx") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{path}.idx is not an index")
    width, _ = struct.unpack("<II", data[8:16])
    (n,) = struct.unpack("<Q", data[16:24])
    return np.dtype(f"<u{width}"), np.frombuffer(data, INDEX, n, 24)


def read_records(fs, path: str, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number, ids) of the wanted records, in that order of reading that the file has; neighbours share a read."""
    dtype, index = read_index(fs, path)
    order = np.arange(len(index)) if wanted is None else np.unique(wanted)
    begin = index["offset"][order].astype(np.int64)
    size = index["n_ids"][order].astype(np.int64) * dtype.itemsize + 16
    with fs.open_input_file(f"{path}.rec") as f:
        k = 0
        while k < len(order):
            j = k + 1
            while j < len(order) and begin[j] - (begin[j - 1] + size[j - 1]) <= GAP_BYTES and begin[j] + size[j] - begin[k] <= READ_BYTES:
                j += 1
            data = f.read_at(int(begin[j - 1] + size[j - 1] - begin[k]), int(begin[k]))
            for i in range(k, j):
                yield int(order[i]), np.frombuffer(unframe(data, int(begin[i] - begin[k])), dtype)
            k = j


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes shards below ``folder``.

    Returns the manifest: shard (place in the order), path, records, ids, and start: the number of
    ids in all shards before. It is written too, so that reading needs no second encoding.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc = TaskContext.get(), tokens.encoder(vocabulary)
        fs, root = shared.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, end = f"shard-{task.partitionId():08d}", np.array([end_id], enc.dtype).tobytes()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (ids + end for ids in enc.encode(batch.column(1).to_pylist())), strict=True)

        some = rows()
        first = next(some, None)
        if first is None:
            return
        n, ids = write_shard(fs, f"{root}/{name}", str(task.taskAttemptId()), _chain(first, some), enc.dtype.itemsize)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{folder}/{name}"], "records": [n], "ids": [ids]})

    shared.bound_batches(docs)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    manifest = shared.written(ranged.mapInArrow(shard, "shard long, path string, records long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def scan_records(manifest: DataFrame) -> DataFrame:
    """Rows of all records of a manifest: doc_id, start, n_tokens, ids_crc32, shard, record; checksums are verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = shared.filesystem(row["path"])
                _, index = read_index(fs, path)
                starts = row["start"] + np.concatenate([[0], np.cumsum(index["n_ids"].astype(np.int64))])
                found: dict[str, list] = {c: [] for c in ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")}
                for k, ids in read_records(fs, path):
                    entry = index[k]
                    values = (None if entry["flags"] & NULL_KEY else int(entry["key"]), int(starts[k]), len(ids), tokens.crc32_of(ids), row["shard"], k)
                    for column, value in zip(found.values(), values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in found.items()})

    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("shard", "path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, record long")


def _chain(first, rest):
    yield first
    yield from rest
