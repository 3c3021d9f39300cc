"""Near duplicates by SimHash, linked through the anchors of a covering code.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 (seed 42) of the text's shingles,
repeats included. Two fingerprints link if at most ``bits`` of them differ. Then one of the two halves of
32 bits differs in at most ``bits // 2`` = s, 0 or 1. On 31 bits of a half the anchors are the words of
the Hamming code, which is perfect: every pattern is within its covering radius of 1 of exactly one anchor,
its home. Two patterns within s of each other are both within 1 + s of the home of either, so each
fingerprint is copied to every anchor within 1 + s (16 at most), and per anchor the fingerprints at home are
compared with all there. Equal fingerprints are one before that.

An anchor that is home to very many fingerprints (of which there are at most MOST_HOT) is divided by what the
link leaves of the other half: split in bits + 1 segments, one of them is equal, so each segment's value makes
a bucket of its own. All links within a bucket are found, and a spanning set of them is kept.

Nulls, empties, repeats: a null text is an empty one, with fingerprint 0, linked like any other. Rows that
repeat give a row each. A null doc_id is not the smallest id of a component; a component without other
ids has a null one. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import components, shared

#: Anchors with more fingerprints at home are divided ...
HOT_HOMES = 2000
#: ... but no more anchors than this; beyond, the bound above rises with the number of fingerprints.
MOST_HOT = 100_000
#: Groups up to this size are compared for all groups of a batch at once.
SMALL = 24
_SEED = 42

# Hamming code of 31 bits: the syndrome of a word is the XOR of its set bits' places (1 to 31).
_CHECKS = [np.uint64(sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)) for k in range(5)]
_WORD = np.uint64((1 << 31) - 1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words; of the whole sequence if it is shorter."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, _SEED)], np.uint64)
    ends = list(accumulate(map(len, found), lambda a, n: a + n + 1))
    xxh = xxhash.xxh64_intdigest
    return np.array([xxh(joined[a:b], _SEED) for a, b in zip([0, *[e + 1 for e in ends[: len(found) - words]]], ends[words - 1 :], strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    # 8 bits of all hashes at a time: a byte's bits spread over the bytes of a word, so 255 words add up without carry
    counts = np.zeros(64, np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    for k in range(0, n, 255):
        spread = _SPREAD[raw[k : k + 255]].sum(axis=0, dtype=np.uint64)
        counts += spread.astype("<u8").view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


_SPREAD = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of every row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "print"])

    shared.bound_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(prints, "doc_id long, print long")


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.uint64) & np.uint64(1)


def homes(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors that 31-bit patterns are nearest to, and their syndromes."""
    syndrome = np.zeros(len(half), np.uint64)
    for k, check in enumerate(_CHECKS):
        syndrome |= _parity(half & check) << np.uint64(k)
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, np.uint64(1)) - np.uint64(1)), np.uint64(0))
    return half ^ flip, syndrome


def anchors(prints: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(half, rows, anchors, whether these are the rows' homes), for every anchor within 1 + reach (0 or 1) of a row's half."""
    rows = np.arange(len(prints))
    for half in (0, 1):
        pattern = (prints >> np.uint64(32 * half)) & _WORD
        home, syndrome = homes(pattern)
        yield half, rows, home, True
        if reach:
            off = np.flatnonzero(syndrome)  # a pattern that is an anchor has no other within 2
            for place in range(1, 32):
                other = syndrome[off] ^ np.uint64(place)
                at = off[(other > place)]  # each pair of places once; their XOR is the syndrome
                other = syndrome[at] ^ np.uint64(place)
                yield half, at, pattern[at] ^ np.uint64(1 << (place - 1)) ^ (np.uint64(1) << (other - np.uint64(1))), False


def _buckets(prints: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, print, at home) of the buckets that fingerprints are compared in."""
    for half, rows, anchor, home in anchors(prints, bits // 2):
        key = anchor | np.uint64(half << 31)
        dense = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        cold = ~dense
        yield key[cold], prints[rows[cold]], np.full(int(cold.sum()), home)
        if dense.any():
            key, own = key[dense], prints[rows[dense]]
            rest = own >> np.uint64(32 * (1 - half)) & np.uint64(0xFFFFFFFF)
            bounds = np.linspace(0, 32, bits + 2).astype(int)
            for segment, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                value = rest >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
                # a mixed key may meet another one's: that costs comparisons, never a link
                mixed = (key * np.uint64(0x9E3779B97F4A7C15)) ^ ((value + np.uint64(1 + (segment << 33))) * np.uint64(0xC2B2AE3D27D4EB4F))
                yield mixed | np.uint64(1 << 63), own, np.full(len(own), home)


def _links_of(key: np.ndarray, own: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of whole groups, sorted by key; of a large group a spanning set."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    group_size = np.repeat(sizes, sizes)
    left, right = [], []
    rows = np.flatnonzero((group_size > 1) & (group_size <= SMALL))
    k, o, h = key[rows], own[rows], home[rows]
    with np.errstate(over="ignore"):
        for shift in range(1, SMALL):
            if len(k) <= shift:
                break
            same = k[shift:] == k[:-shift]
            if not same.any():
                break
            hit = np.flatnonzero(same & (h[shift:] | h[:-shift]) & (np.bitwise_count(o[shift:] ^ o[:-shift]) <= bits))
            left.append(o[hit])
            right.append(o[hit + shift])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        o, h = own[s : s + n], home[s : s + n]
        a, b = _spanning(np.unique(o[h]), np.unique(o), bits)
        left.append(a)
        right.append(b)
    return np.concatenate([np.empty(0, np.uint64), *left]), np.concatenate([np.empty(0, np.uint64), *right])


def _spanning(inner: np.ndarray, every: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links between ``inner`` and ``every`` connect, no more than there are nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out: list[tuple[int, int]] = []
    for a in range(0, len(every), 1024):
        block = every[a : a + 1024]
        for b in range(0, len(inner), 4096):
            near = np.bitwise_count(block[:, None] ^ inner[None, b : b + 4096]) <= bits
            x, y = np.nonzero(near)
            x, y = block[x], inner[b + y]
            # a node links to its first match; matches of one node link in a chain: the same connections, fewer pairs
            first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.empty(0, bool)
            chain = np.flatnonzero(~first)
            pairs = np.concatenate([np.stack([x[first], y[first]], 1), np.stack([y[chain - 1], y[chain]], 1)])
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            for p, q in pairs.tolist():
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    out.append((p, q))
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect all that differ in at most ``bits`` bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover fingerprints that differ in up to 3 bits")

    def unsigned(column) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, _, anchor, _ in anchors(unsigned(batch.column(0)), 0):
                yield pa.RecordBatch.from_arrays([pa.array((anchor | np.uint64(half << 31)).view(np.int64))], names=["anchor"])

    total = prints.count()
    least = max(HOT_HOMES, 2 * total // MOST_HOT)
    found = prints.select("print").mapInArrow(at_home, "anchor long").groupBy("anchor").count().filter(F.col("count") > least).select("anchor").collect()
    hot = np.array([r.anchor for r in found], np.int64).view(np.uint64)  # at most MOST_HOT

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, home in _buckets(unsigned(batch.column(0)), bits, hot):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(home)], names=["key", "print", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool)]

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links_of(*columns, bits) if len(columns[0]) else (columns[0], columns[0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [unsigned(batch.column(0)), unsigned(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)]
            kept = [np.concatenate([x, y]) for x, y in zip(kept, new, strict=True)]
            if not len(kept[0]):
                continue
            last = int(np.searchsorted(kept[0].view(np.int64), kept[0].view(np.int64)[-1]))  # the last group may go on
            yield done([x[:last] for x in kept])
            kept = [x[last:] for x in kept]
        yield done(kept)

    copies = prints.select("print").mapInArrow(spread, "key long, print long, home boolean")
    sorted_copies = copies.repartition("key").sortWithinPartitions("key")
    return sorted_copies.mapInArrow(compare, "a long, b long").distinct()


def grouped(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach) of every row."""
    rows = shared.written(fingerprints(docs, words), "simhash-prints")
    total = rows.count()
    nodes = shared.written(rows.groupBy("print").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies")), "simhash-nodes", rows=total)
    roots = components.components(links(nodes, bits))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    plain, nodes = nodes, shared.written(rooted, "simhash-rooted", rows=total)
    shared.drop(plain)
    sizes = nodes.groupBy("root").agg(F.min("lowest").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_print = shared.lookup(nodes, sizes, "root", "members", nodes.count()).select("print", "copies", "component_id")
    out = shared.lookup(rows, of_print, "print", "copies", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
