"""Vector bin packing of token sequences: the dot-product heuristic under three limits at once.

An example has a number of tokens, of which those at its end bear loss (for plain documents all do),
and takes a segment of the sequence it lies in. A sequence holds at most ``max_tokens`` tokens,
``max_segments`` segments and ``max_loss`` loss-bearing tokens. A task keeps ``window`` open examples.
It fills one sequence at a time: of the examples that fit, it places the one whose demand (tokens,
segments, loss, each as a share of its limit) has the largest dot product with what is left of the
sequence. When none fits, the best one is cut to fill what is left, and its rest stays open. A sequence
that the segment or loss limit ends early is cut back to the largest power of two, which needs
no padding, and so are the last sequences of a task. So sequences are padded only if cutting is off.

Each task packs the rows that it reads: no shuffle, and memory for ``window`` examples and a batch.
Sequence ids are the partition's number times 2^40 plus the place within it; partitions of a file
scan do not change when a task is repeated. With ``ordered`` the sequences follow the rows of the files of a written table: ids grow
with the number in a file's name, the first row of the part of the file that a task reads, and the place within it; a sequence
has rows of one file. With ``oldest_first`` each sequence begins with the example that has been open for longest, so none waits for more than
``window`` sequences. That needs different numbers in the files' names, as Spark
gives them; other tables are packed as without it.

Nulls, empties, repeats: a null text is an empty one, of the end id alone. A null doc_id stays null.
Repeated rows are packed each. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared, tokens

#: Numbers in the name of a file that Spark wrote: of its task, and of the file among the task's.
FILE_NAME = r"^part-(\d+)(?:-[0-9a-f-]*?)?(?:[-.]c(\d+))?\."
#: Bits of a sequence id in order: the file, the first row that a task reads of it, the place.
FILE_BITS, ROW_BITS, PLACE_BITS = 24, 22, 17


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 2048
    max_segments: int = 256
    max_loss: int = 2048
    window: int = 64
    cut: bool = True
    oldest_first: bool = False


@dataclass(frozen=True)
class Piece:
    item: int
    start: int
    length: int
    offset: int


def power_of_two(n: int) -> int:
    """The largest power of two up to n."""
    return 1 << (n.bit_length() - 1)


class Packer:
    """Packs items as they come; ``add`` and ``flush`` give the sequences that are done, as lists of pieces."""

    def __init__(self, limits: Limits):
        self.at = limits
        n = limits.window + 1
        # of each open example: its number, where its rest begins, tokens and loss-bearing tokens of the rest
        self.item, self.start, self.size, self.loss = (np.zeros(n, np.int64) for _ in range(4))
        self.n = 0

    def add(self, item: int, size: int, loss: int) -> Iterator[list[Piece]]:
        if not self.at.cut and (size > self.at.max_tokens or loss > self.at.max_loss):
            raise ValueError("an example that may not be cut is larger than a sequence")
        if size <= 0:
            return
        self._put(item, 0, size, loss)
        while self.n >= self.at.window:
            yield self._sequence()

    def flush(self) -> Iterator[list[Piece]]:
        while self.n:
            yield self._sequence()

    def _put(self, item: int, start: int, size: int, loss: int) -> None:
        if self.n == len(self.item):
            for name in ("item", "start", "size", "loss"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros(16, np.int64)]))
        k, self.n = self.n, self.n + 1
        self.item[k], self.start[k], self.size[k], self.loss[k] = item, start, size, loss

    def _take(self, k: int, length: int) -> tuple[int, int, int, int]:
        """Takes the first tokens of the open example k: its number, start, length and loss-bearing tokens."""
        size, loss = int(self.size[k]), int(self.loss[k])
        taken = (int(self.item[k]), int(self.start[k]), length, max(0, length - (size - loss)))
        if length < size:
            self.start[k] += length
            self.size[k] -= length
            self.loss[k] = loss - taken[3]
        else:
            self.n -= 1
            for a in (self.item, self.start, self.size, self.loss):
                a[k] = a[self.n]
        return taken

    def _sequence(self) -> list[Piece]:
        at = self.at
        tokens_left, segments_left, loss_left = at.max_tokens, at.max_segments, at.max_loss
        placed: list[tuple[int, int, int, int]] = []
        while tokens_left and segments_left and self.n:
            size, loss = self.size[: self.n], self.loss[: self.n]
            score = size * (tokens_left / at.max_tokens**2) + loss * (loss_left / at.max_loss**2)  # the segment's part is the same for all
            fits = (size <= tokens_left) & (loss <= loss_left)
            if at.oldest_first and not placed:
                fits &= self.item[: self.n] == self.item[: self.n].min()
                score = np.where(self.item[: self.n] == self.item[: self.n].min(), score, -1.0)
            if fits.any():
                k = int(np.where(fits, score, -1.0).argmax())
                length = int(size[k])
            elif at.cut:
                most = np.where(score < 0, 0, 1) * np.minimum(tokens_left, np.minimum(size, size - loss + loss_left))
                k = int(np.where(most > 0, score, -1.0).argmax())
                length = int(most[k])
                if length <= 0:
                    break
            else:
                break
            placed.append(self._take(k, length))
            tokens_left -= length
            segments_left -= 1
            loss_left -= placed[-1][3]
        if at.cut and tokens_left:
            back = (at.max_tokens - tokens_left) - power_of_two(at.max_tokens - tokens_left)
            while back:
                item, start, length, loss = placed.pop()
                give = min(back, length)
                keep = length - give
                self._put(item, start + keep, give, min(loss, give))
                if keep:
                    placed.append((item, start, keep, max(0, loss - give)))
                back -= give
        out, offset = [], 0
        for item, start, length, _ in placed:
            out.append(Piece(item, start, length, offset))
            offset += length
        return out


def _numbers(name: str) -> tuple[int, int] | None:
    found = re.search(FILE_NAME, name)
    return (int(found[1]), int(found[2] or 0)) if found else None


def file_order(docs: DataFrame) -> tuple[Column, Column] | None:
    """The number of a row's file and its place there, if ``docs`` is a table of files that Spark numbered."""
    numbers = [_numbers(f.rsplit("/", 1)[-1]) for f in docs.inputFiles()]  # names alone
    if not numbers or None in numbers or len(set(numbers)) < len(numbers) or max(n for n, _ in numbers) >= 1 << FILE_BITS - 4 or max(c for _, c in numbers) >= 16:
        return None
    name = F.col("_metadata.file_name")
    part, more = (F.regexp_extract(name, FILE_NAME, k) for k in (1, 2))
    number = part.cast("long") * 16 + F.when(more == "", F.lit(0)).otherwise(more).cast("long")
    try:
        docs.select(number, "_metadata.row_index")
    except AnalysisException:  # not a plain scan of files
        return None
    return number, F.col("_metadata.row_index")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), ordered: bool = False) -> DataFrame:
    """Packs every text of ``docs``, all tokens bearing loss; a row for each piece.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and sequence_tokens: the
    sequence's tokens before padding.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer, first = tokens.encoder(vocabulary), Packer(limits), TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype)
        kept: dict[int, list] = {}  # of open examples: doc_id, ids, tokens not yet placed
        rows: list[tuple] = []
        count = made = 0

        def place(sequences: Iterator[list[Piece]]) -> None:
            nonlocal made
            for pieces in sequences:
                total = sum(p.length for p in pieces)
                for p in pieces:
                    doc = kept[p.item]
                    rows.append((doc[0], p.start, p.length, tokens.crc32_of(doc[1][p.start : p.start + p.length]), len(doc[1]), first + made, p.offset, total))
                    doc[2] -= p.length
                    if not doc[2]:
                        del kept[p.item]
                made += 1
                if file is not None and made >> PLACE_BITS:
                    raise ValueError("a task has too many sequences for ids in order")

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
            out = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(NAMES, columns, strict=True)})
            rows.clear()
            return out

        file = None
        for batch in batches:
            ids_of = enc.encode(batch.column(1).to_pylist())
            for doc_id, raw, number, row in zip(batch.column(0).to_pylist(), ids_of, *(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                if number != file:  # never without an order
                    place(packer.flush())
                    file, first, made = number, (number << ROW_BITS + PLACE_BITS) + (row << PLACE_BITS), 0
                    if row >> ROW_BITS:
                        raise ValueError("a file has too many rows for ids in order")
                ids = np.concatenate([np.frombuffer(raw, enc.dtype), end])
                kept[count] = [doc_id, ids, len(ids)]
                place(packer.add(count, len(ids), len(ids)))
                count += 1
            yield batch_of()
        place(packer.flush())
        yield batch_of()

    shared.bound_batches(docs)
    number, row = (file_order(docs) if ordered else None) or (F.lit(None).cast("long"), F.lit(None).cast("long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("file"), row.alias("row"))
    return texts.mapInArrow(pack, ", ".join(f"{c} long" for c in NAMES))


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
