"""Token counts of greedy longest-match word pieces, by an automaton that builds no pieces.

The pieces of a vocabulary form a trie over bytes. Every node has a failure link: where the greedy
match goes on once the longest piece on the node's path is taken off its front (and further pieces, until
what is left is again a path of the trie), with the number of pieces taken off, computed ahead. Reading a
word then takes one step for each byte: follow links, adding their counts, until the byte fits.
What is left at the word's end is taken off likewise. So a word's count needs time linear in its length.

Every single byte is a piece, so every word can be cut: a character that no piece begins with counts
as its bytes. A text's words are its runs of other than ASCII white space, each with the vocabulary's
word-begin mark before it. Words repeat; each Python worker keeps the counts of up to KEPT_WORDS words.

Nulls, empties, repeats: a null or empty text has 0 words and 0 tokens. Repeated rows give a row each.
An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared

#: Words whose counts a Python worker keeps; at this number it starts anew.
KEPT_WORDS = 1_000_000
KEPT_LENGTH = 64


class Automaton:
    """Counts greedy longest-match pieces of byte strings. ``pieces`` and all single bytes are the vocabulary."""

    def __init__(self, pieces: Iterable[bytes]):
        step: dict[int, int] = {}  # node * 256 + byte -> node
        ends = [False]
        depth = [0]
        for piece in {*pieces, *(bytes([b]) for b in range(256))}:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(False)
                    depth.append(depth[node] + 1)
                node = step[key]
            ends[node] = bool(piece) or ends[node]
        self.step, n = step, len(ends)
        #: Of each node but the root: where matching goes on, and how many pieces that takes off.
        self.fail, self.popped = [0] * n, [0] * n
        parents = sorted(step.items(), key=lambda x: depth[x[1]])
        order = deque(parents)
        while order:
            key, node = order.popleft()
            parent, b = key >> 8, key & 255
            if ends[node]:  # the whole path is a piece: it is taken, and nothing is left
                self.popped[node] = 1
                continue
            count, z = self.popped[parent], self.fail[parent]
            while True:
                if (z << 8 | b) in step:
                    self.fail[node], self.popped[node] = step[z << 8 | b], count
                    break
                count, z = count + self.popped[z], self.fail[z]

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for b in word:
            while (key := node << 8 | b) not in step:
                total += popped[node]
                node = fail[node]
            node = step[key]
        while node:
            total += popped[node]
            node = fail[node]
        return total


def sentence_pieces(path: str) -> tuple[list[bytes], str]:
    """The pieces of a sentencepiece vocabulary, without control and byte pieces, and its word-begin mark."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(lib.get_piece_size())
    return [lib.id_to_piece(k).encode() for k in ids if not (lib.is_control(k) or lib.is_byte(k) or lib.is_unknown(k) or lib.is_unused(k))], "▁"


class Counter:
    def __init__(self, path: str):
        pieces, mark = sentence_pieces(path)
        self.mark, self.automaton = mark.encode(), Automaton(pieces)
        self.kept: dict[bytes, int] = {}

    def count(self, text: str | None) -> tuple[int, int]:
        """(words, tokens) of a text."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        new = set(words).difference(self.kept)
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept = {}
                new = set(words)
            count, mark = self.automaton.count, self.mark
            found = {w: count(mark + w) for w in new}
            self.kept.update((w, n) for w, n in found.items() if len(w) <= KEPT_LENGTH)
            if any(len(w) > KEPT_LENGTH for w in new):
                get = self.kept.get
                return len(words), sum(found[w] if w in found else get(w) for w in words)
        return len(words), sum(map(self.kept.__getitem__, words))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every text; a map over the rows, without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            words, total = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    shared.bound_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
