"""Context-triggered piecewise hashing of whole texts, and the likeness of two such fingerprints.

A rolling hash over the last 8 bytes of the UTF-8 text (a shift register of 64 bits, mixed) decides
after each byte whether a piece ends there: at block size b = 2^k it does if the k low bits are
all ones, so the boundaries of 2b are among those of b. Each piece gives one of 64 letters, from a
polynomial hash of its bytes. A fingerprint is ``b:s:s2:s4``: the letters at block sizes b, 2b and 4b,
where b is the largest one with at least PIECES / 2 pieces (1 for texts of up to PIECES bytes). Runs of one letter are cut to 3; letters
beyond PIECES fold into the last one, which then hashes the whole rest of the text.

Likeness is 1 - (edits / total length), with inserts and deletes of letters as edits (a changed letter
is one of each), taken at the block sizes that both have; the best counts. Signatures that share no run of
letters (5, or half of the shorter one) have likeness 0, as chance matches do not make a copy. It is found
by bit-parallel longest common subsequence, over all pairs of a batch at once.

Nulls, empties, repeats: a null text is an empty one; empty texts have fingerprint "1:::" and likeness
1 to each other, 0 to others. Rows are in the order of doc_id (null first) and, for repeated ids, of
text; each row's next document is the row that follows, the last one's is the first, and a table of one
row is its own next document. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpanel.llm import shared

#: Letters of a signature at most.
PIECES = 64
#: A likeness above 0 needs so long a common run of letters.
COMMON = 5
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)

# Odd multipliers of the mixing and of the polynomial.
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D
_powers = np.ones(1, np.uint64)


def _weights(n: int) -> np.ndarray:
    """Powers of the polynomial's base."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _powers = out
    return _powers[:n]


def _boundaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes after which pieces may end, and how many low bits of the rolling hash are ones there.

    Places whose level is far below that of any block size in use are left out, unless too few remain.
    """
    n = len(data)
    padded = np.zeros(n + 7, np.uint8)
    padded[7:] = data
    with np.errstate(over="ignore"):
        h = np.ndarray((n,), "<u8", padded, 0, (1,)) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.uint32((1 << max(0, (n // PIECES).bit_length() - 2)) - 1)
    at = np.flatnonzero((h & least) == least)
    if len(at) + 1 < min(PIECES // 2, n):
        at = np.arange(n)
    low = h[at].astype(np.uint64)
    low = ~low & (low + np.uint64(1))  # the lowest zero bit
    return at, (np.log2(low.astype(np.float64)) + 0.5).astype(np.int64)


def _letters(sums: np.ndarray, starts: np.ndarray) -> str:
    """The signature of pieces: their polynomials, freed of the piece's place, then mixed to a letter."""
    with np.errstate(over="ignore"):
        sums = sums * _inverse(starts)
        sums ^= sums >> np.uint64(31)
        sums *= _MIX
    letters = LETTERS[(sums >> np.uint64(58)).astype(np.int64)]
    if len(letters) > 3:
        same = letters[1:] == letters[:-1]
        run = np.zeros(len(letters), bool)
        run[3:] = same[2:] & same[1:-1] & same[:-2]
        if run.any():
            letters = letters[~run]
    if len(letters) > PIECES:
        rest = hashlib.md5(letters[PIECES - 1 :].tobytes()).digest()[0] & 63
        letters = np.append(letters[: PIECES - 1], LETTERS[rest])
    return letters.tobytes().decode()


_INVERSE = pow(_BASE, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def _inverse(at: np.ndarray) -> np.ndarray:
    global _inverses
    n = int(at[-1]) + 1
    if len(_inverses) < n:
        size = max(n, 2 * len(_inverses), 4096)
        out = np.full(size, _INVERSE, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        _inverses = out
    return _inverses[at]


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "1:::"
    at, level = _boundaries(data)
    counts = np.bincount(level, minlength=34)[::-1].cumsum()[::-1]  # boundaries at each level or above
    k = int(np.flatnonzero(counts + 1 >= min(PIECES // 2, len(data)))[-1]) if len(data) > PIECES else 0
    at, level = at[level >= k], level[level >= k]
    starts = np.concatenate([[0], at + 1]) if len(at) else np.zeros(1, np.int64)
    level = np.append(level, 64)  # of each piece's end; the text's end bounds a piece at every size
    if starts[-1] == len(data):
        starts, level = starts[:-1], np.append(level[:-2], 64)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((data + np.uint64(1)) * _weights(len(data)), starts)
    out = [_letters(sums, starts)]
    for step in (1, 2):
        begin = np.concatenate([[0], np.flatnonzero(level[:-1] >= k + step) + 1])
        with np.errstate(over="ignore"):
            out.append(_letters(np.add.reduceat(sums, begin), starts[begin]))
    return f"{1 << k}:" + ":".join(out)


def _pairs(a: str, b: str) -> list[tuple[str, str]]:
    """The signatures of two fingerprints at the block sizes that both have."""
    (x, *s), (y, *t) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    return [(s[i], t[j]) for i in range(3) for j in range(3) if x << i == y << j]


def _common_run(a: str, b: str) -> bool:
    n = min(COMMON, max(1, min(len(a), len(b)) // 2))
    return not {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1))


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness, from 0 to 1, of each pair of fingerprints."""
    out = np.zeros(len(pairs))
    who, first, second = [], [], []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            out[k] = 1
            continue
        for s, t in _pairs(a, b):
            if s and t and _common_run(s, t):
                who.append(k)
                first.append(s)
                second.append(t)
    if who:
        n, m = (np.array([len(s) for s in x]) for x in (first, second))
        score = 2 * _common(first, second) / (n + m)
        np.maximum.at(out, who, score)
    return out


def _common(first: list[str], second: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences: a bit of a word for each letter of the first signature."""
    rows = np.arange(len(first))
    masks = np.zeros((len(first), 129), np.uint64)  # column 128: no letter
    a, b = (np.full((len(first), PIECES), 128, np.int64) for _ in range(2))
    for x, signatures in ((a, first), (b, second)):
        for k, s in enumerate(signatures):
            x[k, : len(s)] = np.frombuffer(s.encode(), np.uint8)
    for i in range(PIECES):
        masks[rows, a[:, i]] |= np.uint64(1 << i)
    masks[:, 128] = 0
    v = np.full(len(first), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for j in range(PIECES):
            hit = v & masks[rows, b[:, j]]
            v = (v + hit) | (v - hit)
    zero = ~v
    return np.bitwise_count(zero & _low(np.array([len(s) for s in first]))).astype(np.int64)


def _low(n: np.ndarray) -> np.ndarray:
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(rows: list[tuple[int | None, str, str, str, str]]) -> pa.RecordBatch:
    """Result rows of (doc_id, text, fingerprint, next text, next fingerprint)."""
    ids, sizes, hashes, prints, edits, ask = [], [], [], [], [], []
    for doc_id, text, own, following, its in rows:
        new = edited(text, following)
        ids.append(doc_id)
        sizes.append(len(text))
        hashes.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
        prints.append(own)
        edits.append(own if new == text else fingerprint(new))
        ask += [(own, edits[-1]), (own, its)]
    near = likeness(ask)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids, sizes, hashes, prints, edits, near[::2], near[1::2]), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of a sorted range but for its last row, which comes with its text, as does the first."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def edge(kind: int | None, batch: pa.RecordBatch, text: str | None) -> pa.RecordBatch:
        n = batch.num_rows
        extra = [pa.array([part] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([text] * n, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*_SCHEMA.names, "part", "edge", "edge_text"])

    last = None  # doc_id, text, fingerprint
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            rows = []
            for doc_id, text in zip(batch.column(0)[k : k + 512].to_pylist(), batch.column(1)[k : k + 512].to_pylist(), strict=True):
                text = text or ""
                own = last[2] if last and last[1] == text else fingerprint(text)
                if last:
                    rows.append((*last, text, own))
                else:
                    yield edge(0, _compared([(doc_id, "", own, "", own)]), text)
                last = doc_id, text, own
            if rows:
                yield edge(None, _compared(rows), None)
    if last:
        yield edge(1, _compared([(last[0], "", last[2], "", last[2])]), last[1])


def _of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _compared(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)))


def with_next(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, its edited text's, and how like it the edited text and the next document are.

    One range shuffle orders the documents; a task compares neighbours within its range and
    hands on its first and last document, of which there are two for each task.
    """
    shared.bound_batches(docs)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    found = shared.written(ranged.mapInArrow(_of_sorted, COLUMNS + ", part long, edge int, edge_text string"), "fingerprints")
    first = found.filter("edge = 0").select("part", F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("part")  # a row for each task
    ring = first.select("part").withColumns({"next": F.lead("part").over(order), "lowest": F.min("part").over(Window.partitionBy())})
    ring = ring.select("part", F.coalesce("next", "lowest").alias("next_part"))
    last = found.filter("edge = 1").select("part", "doc_id", "edge_text", "fingerprint").join(ring, "part")
    edges = last.join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "edge_text", "fingerprint", "next_text", "next_print")
    return found.filter("edge is null").select(*_SCHEMA.names).unionByName(edges.mapInArrow(_of_edges, COLUMNS))
