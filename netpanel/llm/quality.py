"""Quality classifier: a generalised additive model with pairwise interactions.

Training is cyclic gradient boosting of shallow trees on binned features: in each round every feature in
turn gets a tree of at most LEAVES leaves on its bins, shrunk by the learning rate, so that no feature takes what
another explains as well. Trees of one feature add up to one lookup table. Then the pairs of features
whose best two-way cut explains most of what is left get tables of their own in the same way, by trees with one cut
along each axis. A score is the sigmoid of an intercept and one table entry for each feature and pair: bins are
found, entries added, for a whole batch at once.

Features come from the whole text alone (shares of kinds of characters, words and lines, entropy, lengths);
labels, lang, source and doc_id are never among them. The model is fitted on the driver, on at most
``most`` labelled rows (a parameter; those with the smallest hash of doc_id), none of them held out; everything
else is a map over the rows without a shuffle.

Nulls, empties, repeats: a null text is an empty one; empty texts get a score as others do. A null doc_id is
held out and its label is not used; null labels are not used. Of repeated labels of a doc_id the mean counts,
1 from 0.5. Repeated documents get a row each. With no usable label every score is 0.5, with labels of one
kind alone the smoothed share of 1. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared

BINS, PAIR_BINS, LEAVES = 32, 8, 4
ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 300, 0.08, 6, 100
#: Least labelled rows in a leaf, and the weight of a pseudo-row that draws leaves to 0.
LEAST_ROWS, SHRINK = 5, 1.0
#: Labelled rows that a model is fitted on, at most.
MOST_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = ("log_bytes", "upper", "digits", "symbols", "commas", "space", "beyond_ascii", "entropy", "word_bytes", "distinct_words", "distinct_lines", "line_words", "symbol_per_word", "longest_word", "top_byte", "repeats", "bars")

_KIND = np.zeros(256, np.int64)  # 0 other ASCII letter, 1 upper, 2 digit, 3 symbol, 4 comma or stop, 5 space, 6 beyond ASCII, 7 control
_KIND[65:91] = 1
_KIND[48:58] = 2
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_a:_b] = 3
_KIND[[44, 46]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[128:] = 6
_KIND[:9] = _KIND[14:32] = _KIND[127] = 7


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    kinds = np.bincount(_KIND, counts, 8) / n
    p = counts[counts > 0] / n
    words, lines = data.split(), data.split(b"\n")
    m = max(1, len(words))
    letters = max(kinds[0] + kinds[1], 1 / n)
    return [np.log1p(n), kinds[1] / letters, kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], float(-(p * np.log2(p)).sum()), sum(map(len, words)) / m, len(set(words)) / m, len(set(lines)) / len(lines), m / len(lines), kinds[3] * n / m, float(max(map(len, words), default=0)), p.max(), sum(map(eq, words, words[1:])) / m, counts[124] / m]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores, from 0 to 1, of rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        if self.pairs:
            coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for pair in self.pairs for j in pair}
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner bounds of bins with about equally many rows."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The step of each bin by a tree of at most LEAVES leaves: the best cut of any leaf, again and again."""
    cg, ch, cn = (np.concatenate([[0.0], np.cumsum(v)]) for v in (g, h, n))
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(leaves):
            at = np.arange(a + 1, b)
            at = at[(cn[at] - cn[a] >= LEAST_ROWS) & (cn[b] - cn[at] >= LEAST_ROWS)]
            if len(at):
                left, right, whole = ((cg[q] - cg[p]) ** 2 / (ch[q] - ch[p] + SHRINK) for p, q in ((a, at), (at, b), (a, b)))
                gain = left + right - whole
                i = int(gain.argmax())
                best = max(best, (float(gain[i]), k, int(at[i])))
        if not best[2]:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts, one along each axis: its gain, and the step of each cell."""
    def corners(v: np.ndarray) -> np.ndarray:
        s = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
        s[1:, 1:] = v.cumsum(0).cumsum(1)
        a, b, c, d = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([a, b - a, c - a, d - b - c + a])

    gs, hs, ns = corners(g), corners(h), corners(n)
    if not gs.size:
        return 0.0, np.zeros_like(g)
    gain = np.where(ns >= LEAST_ROWS, gs**2 / (hs + SHRINK), 0).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.where(ns[:, i, j] >= LEAST_ROWS, gs[:, i, j] / (hs[:, i, j] + SHRINK), 0)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits a model to rows of features and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_cuts(x[:, j], BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    total = np.full(len(y), model.intercept)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = gradients()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), rows[j])
            model.tables[j] += step
            total += step[bins[j]]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(k)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def cells(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]).astype(float)

    g, h = gradients()
    found = sorted(((_quadrants(cells(i, j, g), cells(i, j, h), cells(i, j, None))[0], i, j) for i in range(k) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in found[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(model.pairs):
            g, h = gradients()
            step = RATE * _quadrants(cells(i, j, g), cells(i, j, h), cells(i, j, None))[1]
            model.pair_tables[t] += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fits a model on the labelled documents that are not held out, ``most`` of them at most; of rows with one doc_id, that of the smallest text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
    known = known.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the broadcast below has at most that many rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["quality", "x"])

    shared.bound_batches(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    found = one.select("quality", "text").mapInArrow(rows, "quality int, x array<double>").collect()  # at most ``most`` rows
    found.sort()
    x = np.array([r.x for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r.quality for r in found], float))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` with score and predicted."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def score(texts):
        import pandas as pd

        x = np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    shared.bound_batches(docs)
    rows = docs.drop(*(c for c in docs.columns if c.lower() in ("score", "predicted")))
    rows = rows.withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
