"""Approximate nearest neighbours through learned partitions.

On a bounded sample, the k-nearest-neighbour graph is cut into balanced parts: k-means seeds, then rounds in
which every point moves to the part that most of its neighbours are in, as long as that part has room. A small
classifier (one hidden layer) learns which part a vector's neighbours are in, as a distribution.
Every row of the table is indexed in the part that the classifier finds most probable. A query goes to its most
probable parts, as many as a margin, measured on the sample against brute force, needs for the recall
asked for, and until they hold enough rows; all vectors there are compared exactly, in double precision.

Parts may be uneven on other data: each is divided into blocks of bounded size by row, and its queries into blocks too,
and a task compares one block of each. A query's best of all blocks are merged at the end.

Nulls, empties, repeats: vectors that are null, of another length than most, zero, or with a null or non-finite
component take no part: neither as queries nor as candidates. Rows with a null vec_id take no part.
Rows that share a vec_id are one candidate, at the smallest distance, and one query, whose distances are the smallest of its rows'. With fewer
candidates than k all are returned. Ties go to the smaller vec_id. An
empty table gives no row. Other columns are not read.

The number of parts grows with the root of the number of rows, up to what the sample can teach (a part for every SAMPLE_ROWS / PARTS_MOST
of its rows). Vectors without structure are compared with most parts, whatever the method: the margin follows the recall asked for.
Distances are found on vectors less the sample's mean; whatever rounding could place among the k nearest is measured again, exactly, on
the original ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpanel.llm import shared

#: Rows that the partition is learned on, at most, and of those, queries that its recall is measured on.
SAMPLE_ROWS, TRIAL_QUERIES = 10_000, 400
#: Parts of the sample's graph (the root of the number of rows, within these), neighbours in it, room of a part relative to an even share.
PARTS_LEAST, PARTS_MOST, NEIGHBOURS, ROOM = 16, 160, 10, 1.1
HIDDEN, EPOCHS, BATCH = 128, 30, 256
#: Recall aimed at on the sample.
TARGET = 0.95
#: Candidates and queries that one task compares at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 20_000


@dataclass
class Router:
    """The classifier, and the share of probability that a query's parts must hold."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def routes(self, x: np.ndarray, rows: np.ndarray, least: int) -> list[np.ndarray]:
        """The parts of each query, most probable first: until they hold ``mass`` and at least ``least`` rows."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.take_along_axis(p, order, 1).cumsum(1)
        many = rows[order].cumsum(1)
        enough = (held >= self.mass) & (many >= least)
        count = np.where(enough.any(1), enough.argmax(1) + 1, p.shape[1])
        return [o[:n] for o, n in zip(order, count, strict=True)]


def nearest(queries: np.ndarray, points: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Numbers of the k nearest points of each query, nearest first, by brute force."""
    out, norms = [], (points**2).sum(1)
    for a in range(0, len(queries), block):
        d = norms - 2 * queries[a : a + block] @ points.T
        best = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k] if k < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each point: seeds far apart, then rounds of moves to where most neighbours are, within the room of a part."""
    room = math.ceil(len(x) / parts * ROOM)
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(10):
        near = nearest(x, centres, 1)[:, 0]
        centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(parts)])
    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    part, left = np.full(len(x), -1), np.full(parts, room)
    for i in np.argsort(d.min(1), kind="stable"):
        choice = d[i].argsort()
        part[i] = choice[left[choice] > 0][0]
        left[part[i]] -= 1
    both = [set(row) for row in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].add(i)
    links = [np.fromiter(s, int) for s in both]
    for _ in range(8):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[links[i]], minlength=parts)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and left[best] > 0:
                left[part[i]] += 1
                left[best] -= 1
                part[i] = best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def learn(x: np.ndarray, k: int, parts: int = PARTS_LEAST, target: float = TARGET, seed: int = 1) -> Router:
    """Learns parts and router from a sample (rows of doubles)."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    x = x - mean
    scale = float(x.std()) or 1.0
    parts = max(1, min(parts, len(x) // 50))
    dims = x.shape[1]
    if parts == 1:
        return Router(mean, scale, np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = nearest(x, x, min(NEIGHBOURS + 1, len(x)))
    graph = np.array([[j for j in row if j != i][:NEIGHBOURS] for i, row in enumerate(graph)])
    part = balanced_parts(x, graph, parts, rng)
    # what is learned: where a point and its neighbours are
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    goal[np.arange(len(x)), part] += 2.0
    goal /= goal.sum(1, keepdims=True)
    z = x / scale
    w1, w2 = rng.normal(0, math.sqrt(2 / dims), (dims, HIDDEN)), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts))
    weights = [w1, np.zeros(HIDDEN), w2, np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = 2e-3 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            rows = order[a : a + BATCH]
            h = np.maximum(z[rows] @ weights[0] + weights[1], 0)
            p = h @ weights[2] + weights[3]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            e = (p - goal[rows]) / len(rows)
            back = (e @ weights[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                g = g + 1e-4 * weights[i]
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *weights)
    # the probability that a query's parts must hold: for each true neighbour, what is needed to reach its part
    p = router.probabilities(x + mean)
    home = p.argmax(1)
    trial = rng.choice(len(x), min(TRIAL_QUERIES, len(x)), replace=False)
    truth = nearest(x[trial], x, min(k + 1, len(x)))
    order = np.argsort(-p[trial], axis=1, kind="stable")
    held = np.take_along_axis(p[trial], order, 1).cumsum(1)
    rank = np.argsort(order, axis=1)
    before = np.concatenate([np.zeros((len(trial), 1)), held[:, :-1]], 1)
    need = np.concatenate([before[i, rank[i, home[[j for j in row if j != q]]]] for i, (q, row) in enumerate(zip(trial, truth, strict=True))])
    router.mass = float(np.nextafter(np.quantile(need, target, method="higher"), 2))
    return router


def usable(table: DataFrame) -> DataFrame:
    """vec_id and x (array of doubles) of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == F.lit(size.n if size else 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def search(table: DataFrame, k: int = 10, every: int = 100, parts: int | None = None, target: float = TARGET, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose vec_id is divisible by ``every``."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(table)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x").toPandas()
    if picked.empty:
        return table.sparkSession.createDataFrame([], schema)
    total = rows.count()
    router = learn(np.array(picked["x"].tolist(), float), k, parts or min(max(math.isqrt(total), PARTS_LEAST), PARTS_MOST), target)
    dims = len(router.mean)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = router.probabilities(_matrix(batch.column(1), dims)).argmax(1) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], names=["vec_id", "x", "part"])

    indexed = shared.written(rows.mapInArrow(index, "vec_id long, x array<double>, part int"), "ann-index")
    held = np.zeros(len(router.b2), np.int64)
    for r in indexed.groupBy("part").count().collect():  # a row for each part
        held[r.part] = r["count"]
    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "x")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                routes = router.routes(_matrix(batch.column(1), dims), held, k + 1)
                at = np.repeat(np.arange(batch.num_rows), [len(r) for r in routes])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(routes), pa.int32())], names=["query_id", "q", "part"])

    asked = shared.written(queries.mapInArrow(route, "query_id long, q array<double>, part int"), "ann-queries")
    blocks = {p: max(1, math.ceil(n / BLOCK_ROWS)) for p, n in enumerate(held)}
    query_blocks = {r.part: math.ceil(r["count"] / BLOCK_QUERIES) for r in asked.groupBy("part").count().collect()}
    of = lambda counts: F.create_map(*[F.lit(int(v)) for item in (counts or {0: 1}).items() for v in item])[F.col("part")]
    n, m = F.coalesce(of(blocks), F.lit(1)), F.coalesce(of(query_blocks), F.lit(1))
    left = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), n).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), m - 1)))
    right = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), m).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), n - 1)))

    def compare(points: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if points.empty or ask.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, q = np.array(points["x"].tolist(), float), np.array(ask["q"].tolist(), float)
        ids, asking = points["vec_id"].to_numpy(), ask["query_id"].to_numpy()
        most = k * int(np.unique(ids, return_counts=True)[1].max())  # the k-th different id is among so many rows
        y = x - router.mean
        norms, out = (y**2).sum(1), []
        slack = 8 * dims * np.finfo(float).eps  # of a sum of dims products, relative to the norms
        for a in range(0, len(q), 256):
            own, z = asking[a : a + 256], q[a : a + 256] - router.mean
            d = (z**2).sum(1)[:, None] + norms - 2 * z @ y.T
            d[own[:, None] == ids] = np.inf
            m = min(most, d.shape[1])
            kth = np.partition(d, m - 1, axis=1)[:, m - 1]
            for i, query in enumerate(own):
                bound = kth[i] + 2 * slack * ((z[i] ** 2).sum() + norms.max()) if np.isfinite(kth[i]) else np.finfo(float).max
                near = np.flatnonzero(d[i] <= bound)
                exact = np.sqrt(((x[near] - q[a + i]) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))
                _, once = np.unique(ids[near][best], return_index=True)
                best = best[np.sort(once)][:k]
                out.append((np.full(len(best), query), ids[near][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    key = ["part", "block", "query_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "query_id long, vec_id long, score double")
    # of a query at most k for each block that a row of its met
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    out = best.select("query_id", F.posexplode("best").alias("at", "found"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "found.vec_id", "found.score")
