"""Removal of repeated passages by compressed FM-indexes.

A window is ``length`` consecutive words. A window whose word sequence also starts earlier (in a
smaller doc_id, or in the same document) is repeated; the words that repeated windows cover are removed.

Hashes only choose which texts meet. Each window has an anchor, the smallest hash of its runs of GRAM words: equal windows
have equal anchors, neighbouring windows mostly share one, so an anchor stands for a stretch of text of up to
``length - GRAM + 1`` windows. A stretch whose anchor no other has cannot be repeated; all others go on.

A shard is a bounded set of such texts in document order. Its FM-index holds the Burrows-Wheeler transform in
a wavelet matrix of packed bits with block counts; of the suffix array only the first place of each repeated window is kept. All
windows of the shard stream through it by backward search, from their ends, for as long as at least two places
match: their matching statistics up to the threshold. A window that matches in full at an earlier place is repeated;
the others go on to the next shards:

1. the candidates of a batch of documents, as they lie: copies within it end here, before the shuffle;
2. the stretches of an anchor, wherever they came from. One with more than HOT of them is dealt to several shards, and what they
   leave goes on;
3. the windows that are left of such anchors, by the hash of a window, again in several shards if one has more than HOT of them: each
   leaves one, so this ends after a round or two, however often a passage occurs.

Every repeated window is found by an index, and words are compared exactly. A symbol of the index is a run of words (five for a
window of 20), of which a text of n words has n; they lie in as many sequences as the run has words, so a window
that starts anywhere is a sequence of symbols, and takes four steps in place of twenty.

Nulls, empties, repeats: a null text has no words. Texts shorter than a window lose nothing. A null doc_id
counts as larger than all others. Rows that repeat doc_id and text are one document, each with its result;
rows with one doc_id and different texts are ordered by a hash of the text. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared

#: Words of a window, and of the runs whose hashes choose anchors.
LENGTH, GRAM = 20, 6
#: Rows of one key that meet in one shard, about; a key with more is dealt to several.
HOT = 2000
#: Words of a shard, about.
SHARD_WORDS = 250_000
#: Words of a symbol of the index, at most.
SYMBOL = 5
#: The place of a null doc_id in the order of documents.
LAST = (1 << 63) - 1

_BASE = 0x5851F42D4C957F2D
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PackedBits:
    """A bit vector of packed words with counts of the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


def _ranked(values: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the runs of ``length`` values at each place (fewer at the end), in their order; equal runs have equal numbers."""
    rank, reach = np.unique(values, return_inverse=True)[1].astype(np.int64), 1
    while reach < length:
        step = min(reach, length - reach)  # runs may overlap: the first part is equal where the second decides
        rank, reach = np.unique(_pairs(rank, step), return_inverse=True)[1].astype(np.int64), reach + step
    return rank


def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
    after = np.zeros(len(rank), np.int64)
    after[: max(len(rank) - step, 0)] = rank[step:] + 1
    return rank * (int(after.max(initial=0)) + 1) + after


class FMIndex:
    """Index of a sequence of symbols 0 .. symbols - 1 for patterns of up to ``longest`` of them; 0 separates texts.

    ``order`` lists the sequence's places in the order that tells which of two is earlier. Suffixes are sorted by ``longest`` symbols, then by
    that order, which is enough for the intervals of patterns up to that length; the first place of an interval is its earliest.
    """

    def __init__(self, text: np.ndarray, symbols: int, longest: int, order: np.ndarray):
        self.n, self.symbols = len(text), symbols
        rank = _ranked(text, longest)[order]
        by = np.argsort(rank, kind="stable")
        places, rank = order[by], rank[by]
        column = text[places - 1]  # of the first suffix: the last symbol
        start = np.concatenate([[True], rank[1:] != rank[:-1]])
        several = start & ~np.append(start[1:], True)
        self.marks, self.firsts = PackedBits(several), by[several].astype(np.uint32)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.uint32)
        self.levels: list[PackedBits] = []
        self.depth = max(1, (symbols - 1).bit_length())
        for k in range(self.depth - 1, -1, -1):
            bits = (column >> k & 1).astype(bool)
            self.levels.append(PackedBits(bits))
            column = np.concatenate([column[~bits], column[bits]])
        self.first = self._path(np.arange(symbols), np.zeros(symbols, np.int64)).astype(np.uint32)

    def _path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first places of the transform end up in the wavelet matrix's order, going down by the symbol's bits."""
        for k, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> k & 1, self.n - bits.ones + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first places of the transform."""
        return self._path(symbol, at) - self.first[symbol]

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the stretches of ``text`` that end at ``ends``, backwards up to ``length`` symbols.

        Returns the symbols matched while at least two places of the index do, and the interval of these places.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        matched = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for step in range(length):
            symbol = text[ends[live] - step]
            a = self.below[symbol].astype(np.int64)
            if step:
                a, b = a + self.rank(symbol, lo[live]), a + self.rank(symbol, hi[live])
            else:  # all places that begin with the symbol
                b = self.below[symbol + 1].astype(np.int64)
            more = b - a >= 2
            live = live[more]
            lo[live], hi[live] = a[more], b[more]
            matched[live] += 1
        return matched, lo, hi

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """The earliest place (its number in ``order``) of the intervals, of several places each, of patterns of the full length."""
        return self.firsts[self.marks.rank(lo)].astype(np.int64)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated(stretches: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """Of each stretch, in their order: which of its windows also start earlier, found through an FM-index of all."""
    if not stretches:
        return []
    sizes = np.array([len(s) for s in stretches])
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return [np.zeros(0, bool) for _ in stretches]
    words = np.fromiter(map(_Numbers().__getitem__, chain.from_iterable(stretches)), np.int64, int(sizes.sum()))
    run = max(d for d in range(1, SYMBOL + 1) if length % d == 0)
    # runs of words in a stretch: those that start at r, r + run, ... are one sequence, with a separator after it
    runs = np.maximum(sizes - run + 1, 0)
    of = np.repeat(np.arange(len(sizes)), runs)
    at = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    symbol = _ranked(words, run)[at + np.repeat(np.cumsum(sizes) - sizes, runs)] + 1
    phase, whole, rest = at % run, runs[of] // run, runs[of] % run
    begins = np.cumsum(runs + run) - (runs + run)
    place = begins[of] + phase * (whole + 1) + np.minimum(phase, rest) + at // run
    text = np.zeros(int((runs + run).sum()), np.int64)
    text[place] = symbol
    order = np.concatenate([place, np.flatnonzero(text == 0)])
    steps = length // run
    index = FMIndex(text, int(symbol.max()) + 1, steps, order)
    starts = np.flatnonzero(at < windows[of])  # numbers in ``order``
    matched, lo, _ = index.matches(text, place[starts] + steps - 1, steps)
    full = np.flatnonzero(matched == steps)
    again = np.zeros(len(starts), bool)
    again[full] = index.earliest(lo[full]) < starts[full]
    return np.split(again, np.cumsum(windows)[:-1])


def in_shards(stretches: list[list[bytes]], length: int) -> list[np.ndarray]:
    """``repeated`` of stretches in shards of about SHARD_WORDS words, one after the other."""
    out: list[np.ndarray] = []
    shard: list[list[bytes]] = []
    held = 0
    for s in stretches:
        shard.append(s)
        held += len(s)
        if held >= SHARD_WORDS:
            out += repeated(shard, length)
            shard, held = [], 0
    return out + repeated(shard, length)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word that does not depend on its place."""
    from netpanel.llm.fingerprints import _inverse, _weights

    joined = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.concatenate([[0], _spaces(joined) + 1])
    with np.errstate(over="ignore"):
        # the space after a word is part of its sum, but for the last one: add it there
        sums = np.add.reduceat((joined + np.uint64(1)) * _weights(len(joined)), starts)
        sums[-1] += np.uint64(33) * _weights(len(joined) + 1)[-1]
        return _mixed(sums * _inverse(starts))


def _spaces(joined: np.ndarray) -> np.ndarray:
    """Where the spaces between joined words are: words hold none."""
    return np.flatnonzero(joined == 32)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(32)) * _MIX
        return h ^ h >> np.uint64(29)


def stretches(words: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of a document: their anchors, first windows, and numbers of windows."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = word_hashes(words)
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            grams += h[k : len(grams) + k] * np.uint64(pow(_BASE, k, 1 << 64))
    grams = _mixed(grams)
    choice = np.lib.stride_tricks.sliding_window_view(grams, length - gram + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], choice[1:] != choice[:-1]]))
    return grams[choice[first]], first, np.diff(np.append(first, n))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _words(text: str | None) -> list[bytes]:
    return raw(text).split()


def _pack(h: int, first: np.ndarray, count: np.ndarray, known: np.ndarray) -> np.ndarray:
    """First window (32 bits), number of windows (6), whether the anchor is known to repeat (1), hash of the text (24)."""
    return (np.int64(h & 0xFFFFFF) << 39) | (known.astype(np.int64) << 38) | (count << 32) | first


def _anchors_of(length: int):
    """Rows (key, id, packed) of all stretches; a stretch whose anchor the batch repeats is known, and sends one row for its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, texts = (batch.column(k).to_pylist() for k in range(3))
            anchor, owner, first, count = [], [], [], []
            for k, text in enumerate(texts):
                a, b, c = stretches(_words(text), length)
                anchor.append(a)
                first.append(b)
                count.append(c)
                owner.append(np.full(len(a), k))
            if not texts:
                continue
            anchor, first, count, owner = (np.concatenate(x) for x in (anchor, first, count, owner))
            _, at, which, copies = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = copies[which] > 1
            ids, hs = np.array(ids, np.int64), np.array(hs, np.int64)
            packed = _pack(0, first, count, known) | ((hs[owner] & 0xFFFFFF) << 39)
            # known ones go anywhere; the key only spreads them
            key = np.where(known, _mixed(ids[owner].view(np.uint64) ^ first.view(np.uint64)), anchor)
            tell = at[copies > 1]
            key = np.concatenate([key, anchor[tell]])
            row_id = np.concatenate([ids[owner], np.full(len(tell), -1)])
            own = np.concatenate([anchor, anchor[tell]])
            packed = np.concatenate([packed, np.full(len(tell), -1)])
            for k in range(0, len(key), 200_000):
                s = slice(k, k + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(own[s].view(np.int64)), pa.array(row_id[s]), pa.array(packed[s])], names=["key", "anchor", "id", "packed"])

    return run


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: the known stretches, and those whose anchor has another row."""

    def done(key: np.ndarray, anchor: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
        told = packed == -1
        known = ~told & (packed >> 38 & 1).astype(bool)
        ask = ~known
        k = key[ask]
        start = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        group = np.cumsum(start) - 1
        several = np.bincount(group, 1 + told[ask])[group] > 1 if len(k) else np.empty(0, bool)
        keep = known.copy()
        keep[np.flatnonzero(ask)[several & ~told[ask]]] = True
        return pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(ids[keep]), pa.array(packed[keep])], names=["anchor", "id", "packed"])

    kept = [np.empty(0, np.int64)] * 4
    for batch in batches:
        kept = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(kept, batch.columns, strict=True)]
        if len(kept[0]):
            last = int(np.searchsorted(kept[0], kept[0][-1]))
            yield done(*(x[:last] for x in kept))
            kept = [x[last:] for x in kept]
    yield done(*kept)


def _result(words: list[bytes], removed: np.ndarray | None) -> tuple[int, int, bytes]:
    if removed is None or not removed.any():
        return len(words), 0, b" ".join(words)
    return len(words), int(removed.sum()), b" ".join(w for w, r in zip(words, removed.tolist(), strict=True) if not r)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed & 0xFFFFFFFF, packed >> 32 & 63


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``keep_text`` also ``kept``: the kept words joined by a space, or
    the text as it is (null: empty) if none is removed.

    With ``keep_text`` the other columns of ``docs`` come too, but for ones of those names.
    """
    spark = docs.sparkSession
    shared.bound_batches(docs)
    if not GRAM <= length <= GRAM + 62:
        raise ValueError(f"a window has from {GRAM} to {GRAM + 62} words")
    names = ("n_words", "n_removed", "kept_sha256", "kept")
    others = [c for c in docs.columns if c.lower() not in (*names, "doc_id", "text")] if keep_text else []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*others).alias("_others") if others else F.lit(None).cast("int").alias("_others"))
    rows = rows.withColumn("_h", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFF)))

    anchors = rows.select("_id", "_h", "text").mapInArrow(_anchors_of(length), "key long, anchor long, id long, packed long")
    found = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_repeating, "anchor long, id long, packed long")
    found = found.select(F.col("id").alias("_id"), F.expr("shiftright(packed, 39) & 16777215L").alias("_h"), "packed", "anchor")
    per_doc = found.groupBy("_id", "_h").agg(F.collect_set(F.struct("packed", "anchor")).alias("_x"))
    per_doc = per_doc.select("_id", "_h", F.transform("_x", lambda x: x["packed"]).alias("_at"), F.transform("_x", lambda x: x["anchor"]).alias("_anchors"))
    per_doc = shared.written(per_doc, "repeating")  # before the texts move
    joined = rows.join(per_doc, ["_id", "_h"], "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: results of documents without candidates; 1: other documents' text; 2: what the batch's index leaves of their stretches."""
        for batch in batches:
            size = batch.num_rows
            kind, total, sha, text_of = [0] * size, [None] * size, [None] * size, [None] * size
            texts, ats, anchors = (batch.column(c).to_pylist() for c in ("text", "_at", "_anchors"))
            ids, hs = batch.column("_id").to_numpy(), batch.column("_h").to_numpy()
            docs_of: list[tuple[int, list[bytes], np.ndarray, np.ndarray]] = []
            for k in np.lexsort((hs, ids)).tolist():
                words = _words(texts[k])
                if not ats[k]:
                    total[k], _, left = _result(words, None)
                    sha[k] = hashlib.sha256(left).hexdigest()
                    if keep_text:
                        text_of[k] = raw(texts[k])
                    continue
                kind[k], text_of[k] = 1, raw(texts[k])
                first, count = _unpack(np.array(ats[k], np.int64))
                of = np.full(len(words) - length + 1, -1)  # the stretch of each window
                of[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())] = np.repeat(np.arange(len(first)), count)
                docs_of.append((k, words, of, np.array(anchors[k], np.int64)))
            none = pa.nulls(size, pa.int64())
            gone = pa.array([0 if n is not None else None for n in total], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), batch.column("doc_id"), batch.column("_others"), batch.column("_id"), batch.column("_h"), pa.array(total, pa.int64()), gone, pa.array(sha, pa.string()), pa.array(text_of, pa.binary()), pa.array([x if k else None for x, k in zip(ats, kind, strict=True)], pa.list_(pa.int64())), none, none, none], names=names_of)
            rows_of = _left_of(docs_of, length)
            for s in (slice(x, x + 20_000) for x in range(0, len(rows_of[0]), 20_000)):
                owner, first, count, anchor, words_of = (x[s] for x in rows_of)
                n = len(owner)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), none, pa.nulls(n, batch.column("_others").type), pa.array(ids[owner]), pa.array(hs[owner]), none, none, pa.nulls(n, pa.string()), pa.array(words_of, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array(anchor), pa.array(first), pa.array(count)], names=names_of)

    names_of = ["kind", "doc_id", "_others", "_id", "_h", "n_words", "n_removed", "kept_sha256", "kept", "_at", "key", "first", "windows"]
    kinds = "kind int, doc_id long, _others {}, _id long, _h long, n_words long, n_removed long, kept_sha256 string, kept binary, _at array<long>, key long, first long, windows long".format(rows.schema["_others"].dataType.simpleString())
    done = shared.written(joined.mapInArrow(split, kinds), "substrings", parts="kind")
    shared.drop(per_doc)
    of_kind = lambda k: done.filter(F.col("kind") == k)

    kept = _kept_windows(of_kind(2).select("_id", "_h", "first", "windows", F.col("kept").alias("words"), "key"), length)
    shared.delete(spark, f"{done._scratch}/kind=2")
    per_doc = reduce(DataFrame.unionByName, kept).groupBy("_id", "_h").agg(F.flatten(F.collect_list("starts")).alias("_kept"))
    candidates = of_kind(1).select("doc_id", "_others", "_id", "_h", "kept", "_at").join(per_doc, ["_id", "_h"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at, stays in zip(*(batch.column(c).to_pylist() for c in ("kept", "_at", "_kept")), strict=True):
                words = text.split()
                first, count = _unpack(np.array(at, np.int64))
                again = np.zeros(len(words) - length + 2, np.int64)  # stretches that begin, less those that end
                np.add.at(again, first, 1)
                np.add.at(again, first + count, -1)
                again = np.cumsum(again[:-1]) > 0
                again[np.array(stays or (), np.int64)] = False
                edge = np.zeros(len(words) + 1, np.int64)  # repeated windows that begin, less those that end
                edge[: len(again)] += again
                edge[length : length + len(again)] -= again
                n, m, left = _result(words, np.cumsum(edge[:-1]) > 0)
                out.append((n, m, hashlib.sha256(left).hexdigest(), (left if m else text) if keep_text else None))
            n, m, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_others"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())], names=["doc_id", "_others", "n_words", "n_removed", "kept_sha256", "kept"])

    result = ["doc_id", "_others", "n_words", "n_removed", "kept_sha256", "kept"]
    schema = "doc_id long, _others {}, n_words long, n_removed long, kept_sha256 string, kept binary".format(rows.schema["_others"].dataType.simpleString())
    both = of_kind(0).select(*result).unionByName(candidates.mapInArrow(remove, schema))
    if not keep_text:
        return both.select("doc_id", "n_words", "n_removed", "kept_sha256")
    return both.select("doc_id", *[F.col("_others")[c].alias(c) for c in others], "n_words", "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"))


def _left_of(docs_of: list[tuple[int, list[bytes], np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of documents (number, words, stretch of each window or -1, anchors of the stretches), in their order: the parts of stretches whose
    windows have no earlier place among these documents, as document, first window, number of windows, anchor and words."""
    runs, ends = [], []
    for _, words, of, _ in docs_of:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], of >= 0, [False]])))
        ends.append(len(runs) + len(edge) // 2)
        runs += [words[a : b + length - 1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    again, begin = in_shards(runs, length), 0
    owners, firsts, counts, keys, pieces = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for (k, words, of, anchors), end in zip(docs_of, ends, strict=True):
        live = of >= 0
        live[live] = ~np.concatenate(again[begin:end])
        begin = end
        first = np.flatnonzero(live & np.concatenate([[True], ~live[:-1] | (of[1:] != of[:-1])]))
        if not len(first):
            continue
        count = np.add.reduceat(live, first, dtype=np.int64) if len(first) else first  # what follows a part is not live, or the next part
        joined = b" ".join(words)
        at = np.append(_spaces(np.frombuffer(joined, np.uint8)), len(joined))
        pieces += [joined[a:b] for a, b in zip(np.where(first > 0, at[first - 1] + 1, 0).tolist(), at[first + count + length - 2].tolist(), strict=True)]
        owners.append(np.full(len(first), k))
        firsts.append(first)
        counts.append(count)
        keys.append(anchors[of[first]])
    return (*(np.concatenate(x) for x in (owners, firsts, counts, keys)), pieces)


def _kept_windows(found: DataFrame, length: int) -> list[DataFrame]:
    """Tables of _id, _h, starts: the windows that no earlier place has. ``found`` has parts of stretches: _id, _h, first, windows, words, key."""
    out: list[DataFrame] = []
    scratch: list[DataFrame] = []
    while True:
        sums = found.agg(F.count(F.lit(1)), F.sum(F.col("windows") + length)).first()
        if not sums[0]:
            shared.drop(*scratch)
            return out or [found.select("_id", "_h", F.array("first").alias("starts"))]
        done = shared.written(_round(found, length, *sums), "kept-windows")
        shared.drop(*scratch)
        out.append(done.filter("words is null").select("_id", "_h", "starts"))
        open_ = done.filter("words is not null").select("_id", "_h", F.explode(F.arrays_zip("starts", "words")).alias("x"))
        found = open_.select("_id", "_h", F.col("x.starts").alias("first"), F.lit(1).cast("long").alias("windows"), F.col("x.words").alias("words"), F.xxhash64("x.words").alias("key"))


def _round(found: DataFrame, length: int, total: int, words: int) -> DataFrame:
    """_id, _h, starts of the windows that a shard leaves of each part; with ``words`` where the part's key is dealt to several shards."""
    many = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).withColumn("salts", F.ceil(F.col("n") / HOT).cast("int"))
    many = shared.written(many, "hot-keys", rows=total)
    marked = shared.lookup(found, many, "key", "n", total)
    shards = max(1, math.ceil(words / SHARD_WORDS))
    salt = F.pmod(F.xxhash64("_id", "_h", "first"), F.coalesce("salts", F.lit(1)))
    dealt = marked.select(F.pmod(F.xxhash64("key", salt), F.lit(shards)).alias("shard"), "_id", "_h", "first", "words", F.col("salts").isNotNull().alias("open"))

    def through_index(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_id", "_h", "first"])
        texts = [w.split() for w in group["words"]]
        left = [np.flatnonzero(~a) for a in repeated(texts, length)]
        group = group.assign(
            starts=[x + first for x, first in zip(left, group["first"].to_numpy(), strict=True)],
            words=[[b" ".join(t[k : k + length]) for k in x] if o else None for t, x, o in zip(texts, left, group["open"], strict=True)],
        )
        return group[["_id", "_h", "starts", "words"]][[len(x) > 0 for x in left]]

    return dealt.groupBy("shard").applyInPandas(through_index, "_id long, _h long, starts array<long>, words array<binary>")
