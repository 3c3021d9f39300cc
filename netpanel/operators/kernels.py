"""Dense kernels of one group (a period's graph or points), on numpy arrays; grouped operators call them.

All randomness comes from a generator that the caller seeds by the group's key.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np

Array = np.ndarray


def squared_distances(x: Array, y: Array | None = None) -> Array:
    y = x if y is None else y
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


def leaves(x: Array, size: int) -> tuple[Array, Array]:
    """Places of points so that near ones lie together, by halves of the widest dimension, and where each part of up to ``size`` begins (and the last ends)."""
    order, parts, whole = np.arange(len(x)), [(0, len(x))], []
    while parts:
        a, b = parts.pop()
        if b - a <= size:
            whole.append(a)
            continue
        own, middle = x[order[a:b]], (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(own[:, int(np.ptp(own, axis=0).argmax())], middle)]
        parts += [(a, a + middle), (a + middle, b)]
    return order, np.array([*sorted(whole), len(x)])


def nearest(ids: Array, x: Array, others: Array, y: Array, k: int, height: int = 64, width: int = 1024) -> tuple[Array, Array, Array]:
    """Of each of ``ids`` at x the k nearest ``others`` (ascending) at y and their distances, itself left out; ties to the smaller one.

    Up to ``height`` points that lie together meet the parts of the others, nearest first, as long as one may hold a nearer one; ``height`` x ``width`` distances
    exist at a time; those that rounding cannot rule out are taken again from differences. In many dimensions there is one part.
    """
    few = x.shape[1] <= 16
    if not few:
        height, width = 4 * height, 4 * width
    if not len(ids) or not len(others):
        return ids[:0], others[:0], np.zeros(0)
    middle = y.mean(0)  # distances are of differences: less rounding near the middle
    u, v = x - middle, y - middle
    own_norms = (u**2).sum(1)
    slack = 16 * x.shape[1] * np.finfo(float).eps * (own_norms + (v**2).sum(1).max())  # of the sums, relative to the norms
    order, begin = leaves(v, height) if few else (np.arange(len(y)), np.array([0, len(y)]))
    v = v[order]
    norms = (v**2).sum(1)
    low, high = np.minimum.reduceat(v, begin[:-1]), np.maximum.reduceat(v, begin[:-1])
    groups, starts = leaves(u, height)
    out = []
    for s, e in zip(starts, starts[1:], strict=False):
        part = groups[s:e]
        own, at, fine = ids[part], u[part], slack[part]
        far = (np.maximum(np.maximum(low - at.max(0), at.min(0) - high), 0) ** 2).sum(1)  # squared, of each part
        turn = np.argsort(far, kind="stable")
        count = np.diff(begin)[turn]
        places = ranges(begin[turn], count)
        ends, bound = np.cumsum(count), far[turn]
        kept = np.zeros(0, int), np.zeros(0, int), np.zeros(0)  # row, place of the other, squared distance
        least = np.full(len(own), np.inf)
        a = 0
        while a < len(places) and bound[np.searchsorted(ends, a, "right")] <= (least + fine).max():
            upto = ends[np.searchsorted(bound, (least + fine).max(), "right") - 1]
            b = min(a + (width if a else max(width // 2, 2 * k + 2)), upto)
            some = places[a:b]
            d = at @ v[some].T
            d *= -2
            d += own_norms[part][:, None]
            d += norms[some]
            near = np.minimum(least, np.partition(d, k, axis=1)[:, k]) if a == 0 and b > k + 1 else least  # one may be the point itself
            row, place = np.nonzero(d <= (near + fine)[:, None])
            place = order[some[place]]
            other = others[place] != own[row]
            row, place = row[other], place[other]
            exact = np.concatenate([((y[place[c : c + 20000]] - x[part[row[c : c + 20000]]]) ** 2).sum(1) for c in range(0, len(row), 20000)] or [np.zeros(0)])
            row, place, exact = (np.concatenate(w) for w in zip(kept, (row, place, exact), strict=True))
            sort = np.lexsort((place, np.sqrt(exact), row))
            row, place, exact = row[sort], place[sort], exact[sort]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = row[rank < k], place[rank < k], exact[rank < k]
            least[row[rank == k - 1]] = exact[rank == k - 1]
            a = b
        out.append((part[kept[0]], others[kept[1]], np.sqrt(kept[2])))
    row, j, d = (np.concatenate(w) for w in zip(*out, strict=True))
    sort = np.argsort(row, kind="stable")
    return ids[row[sort]], j[sort], d[sort]


# ---------------------------------------------------------------------------------------------- graphs


#: A graph's paths of two links may be so many times its links to be listed.
HUBS = 64


def ranges(begin: Array, count: Array) -> Array:
    """The numbers begin, begin + 1, ... of each range, ``count`` of it, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


class Links:
    """A symmetric graph of n nodes without loops by its links (i < j, w), where a matrix of n x n would hold zeros."""

    def __init__(self, n: int, i: Array, j: Array, w: Array):
        order = np.lexsort((np.maximum(i, j), np.minimum(i, j)))
        self.n, self.i, self.j, self.w = n, np.minimum(i, j)[order], np.maximum(i, j)[order], np.asarray(w, float)[order]
        row, column, weight = np.concatenate([self.i, self.j]), np.concatenate([self.j, self.i]), np.concatenate([self.w, self.w])
        order = np.lexsort((column, row))
        self._column, self._weight = column[order], weight[order]
        self._some, self._starts = np.unique(row, return_index=True) if not len(row) else np.unique(row[order], return_index=True)

    @classmethod
    def of(cls, a: Array | Links) -> Links:
        if isinstance(a, cls):
            return a
        i, j = np.nonzero(np.triu(a, 1))
        return cls(len(a), i, j, a[i, j])

    def __len__(self) -> int:
        return self.n

    def degrees(self) -> Array:
        return self @ np.ones(self.n)

    def __matmul__(self, m: Array) -> Array:
        out = np.zeros((self.n, *m.shape[1:]))
        if len(self._some):
            weight = self._weight if m.ndim == 1 else self._weight[:, None]
            out[self._some] = np.add.reduceat(weight * m[self._column], self._starts, axis=0)
        return out

    def among(self, chosen: Array) -> Links:
        """The graph among the chosen nodes (ascending), numbered by their places."""
        place = np.full(self.n, -1)
        place[chosen] = np.arange(len(chosen))
        i, j = place[self.i], place[self.j]
        both = (i >= 0) & (j >= 0)
        return Links(len(chosen), i[both], j[both], self.w[both])

    def dense(self) -> Array:
        a = np.zeros((self.n, self.n))
        a[self.i, self.j] = a[self.j, self.i] = self.w
        return a

    def paths(self) -> tuple[Array, Array, Array] | None:
        """The matrix times itself by its entries (where each row begins, columns, values), made once; None if hubs would make them many times the links."""
        if not hasattr(self, "_paths"):
            count = np.zeros(self.n, int)
            count[self._some] = np.diff(np.append(self._starts, len(self._column)))
            many = count[self._column]
            self._paths = None
            if many.sum() <= HUBS * len(self._column):
                begin = np.append(0, np.cumsum(count))
                row, column, value = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
                parts = []
                for s in range(0, self.n, 16384):  # rows at a time
                    some = slice(begin[s], begin[min(s + 16384, self.n)])
                    second = ranges(begin[self._column[some]], many[some])
                    key = np.repeat(np.repeat(np.arange(self.n), count)[some], many[some]) * self.n + self._column[second]
                    key, at = np.unique(key, return_inverse=True)
                    parts.append((key, np.bincount(at, np.repeat(self._weight[some], many[some]) * self._weight[second], len(key))))
                key, value = (np.concatenate(v) for v in zip(*parts, strict=True)) if parts else (row, value)
                row, column = np.divmod(key, max(self.n, 1))
                self._paths = np.searchsorted(row, np.arange(self.n + 1)), column, value
        return self._paths


def spanning_tree(x: Array) -> tuple[Array, Array, Array]:
    """Ends and lengths of the edges of the minimum spanning tree of points, grown from the first one."""
    n = len(x)
    best, parent = np.full(n, np.inf), np.zeros(n, int)
    inside = np.zeros(n, bool)
    a, b, d = [], [], []
    now = 0
    for _ in range(n - 1):
        inside[now] = True
        step = np.sqrt(((x - x[now]) ** 2).sum(1))
        closer = ~inside & (step < best)
        best[closer], parent[closer] = step[closer], now
        now = int(np.where(inside, np.inf, best).argmin())
        a.append(parent[now])
        b.append(now)
        d.append(best[now])
    return np.array(a, int), np.array(b, int), np.array(d, float)


def maximum_spanning_edges(w: Array) -> tuple[Array, Array]:
    """Ends of the edges of a maximum spanning forest of a dense similarity (positive entries), grown from the first node of each tree."""
    return _maximum_spanning_tree(w)[:2]


def _maximum_spanning_tree(w: Array | Half) -> tuple[Array, Array, Array]:
    n = len(w)
    a, b, d = [], [], []
    waiting, now = np.ones(n, bool), 0
    best, parent = np.zeros(n), np.full(n, -1)
    for _ in range(n):
        waiting[now] = False
        row = w[now]
        closer = waiting & (row > best)
        best[closer], parent[closer] = row[closer], now
        best[now] = 0
        new = int(best.argmax())
        if best[new] <= 0:  # the tree is whole
            new = int(waiting.argmax())
        else:
            a.append(parent[new])
            b.append(new)
            d.append(best[new])
        now = new
    return np.array(a, int), np.array(b, int), np.array(d, float)


def strongest(s: Array, k: int, mutual: bool) -> Array:
    """A symmetric graph of each row's k largest positive entries: chosen by both sides (smaller weight) or either (larger)."""
    s = s.copy()
    np.fill_diagonal(s, 0)
    n = len(s)
    order = np.argsort(-s, axis=1, kind="stable")[:, : min(k, n - 1)] if n > 1 else np.zeros((n, 0), int)
    chosen = np.zeros_like(s)
    np.put_along_axis(chosen, order, np.maximum(np.take_along_axis(s, order, 1), 0), 1)
    return np.minimum(chosen, chosen.T) if mutual else np.maximum(chosen, chosen.T)


def standardised(g: Array) -> Array:
    """Columns with mean 0 and deviation 1; constant ones 0, missing values 0."""
    mean = np.nanmean(np.where(np.isfinite(g), g, np.nan), axis=0) if len(g) else np.zeros(g.shape[1])
    sd = np.nanstd(np.where(np.isfinite(g), g, np.nan), axis=0) if len(g) else np.ones(g.shape[1])
    return np.nan_to_num((g - np.nan_to_num(mean)) / np.where(sd > 0, sd, 1.0))


def shrinkage(z: Array) -> float:
    """The Ledoit-Wolf intensity for centred rows z (times x variables), through the Gram matrix of times alone."""
    return shrinkage_of_gram(z @ z.T, z.shape[1])


def shrinkage_of_gram(gram: Array, p: int) -> float:
    """The same from the Gram matrix of p variables, which may come as a sum over parts of them."""
    t = len(gram)
    if not t or not p:
        return 1.0
    mu = np.trace(gram) / t / p
    square = (gram**2).sum() / t**2
    beta = ((np.diag(gram) ** 2).sum() / t - square) / (p * t)
    delta = (square - p * mu**2) / p
    return float(min(max(beta, 0.0), delta) / delta) if delta > 1e-15 else 1.0


def shrunk_correlation(z: Array) -> tuple[Array, float]:
    """Correlation after shrinkage towards a multiple of the identity, and the intensity."""
    t, p = z.shape
    d = shrinkage(z)
    cov = (1 - d) * (z.T @ z) / max(t, 1)
    cov[np.diag_indices(p)] += d * np.trace(z.T @ z) / max(t, 1) / p
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / sd / sd[:, None]
    np.fill_diagonal(corr, 1.0)
    return corr, d


def lagged_correlations(g: Array, lags: tuple[int, ...]) -> dict[int, tuple[Array, float]]:
    """By lag: the shrunk correlation of growth rows (times x entities) with rows ``lag`` earlier, the larger of both orders."""
    out = {}
    for lag in lags:
        if lag == 0:
            out[0] = shrunk_correlation(standardised(g))
        elif lag < len(g) - 2:
            joint, d = shrunk_correlation(standardised(np.hstack([g[lag:], g[:-lag]])))
            n = g.shape[1]
            block = joint[:n, n:]
            out[lag] = np.maximum(block, block.T), d
    return out


def comovement(g: Array, k: int, lags: tuple[int, ...], mutual: bool = True) -> Array:
    """Graph of entities that grow together: the largest correlation over lags, floored at 0, k strongest."""
    n = g.shape[1]
    if len(g) < 3:
        return np.zeros((n, n))
    best = np.zeros((n, n))
    for corr, _ in lagged_correlations(g, lags).values():
        np.maximum(best, corr, out=best)
    best[best < 1e-12] = 0
    return np.minimum(strongest(best, k, mutual), 1)


def lag_parts(g: Array, lags: tuple[int, ...]) -> dict[int, list[Array]]:
    """By lag, of growth in rows of entities: the standardised rows (lag 0), or those of later and of earlier times; too few times: no lag."""
    score = lambda part: standardised(part.T).T
    n = g.shape[1]
    return {lag: [score(g)] if lag == 0 else [score(g[:, lag:]), score(g[:, :-lag])] for lag in lags if n >= 3 and (lag == 0 or lag < n - 2)}


def correlation_rows(g: Array, shrunk: dict[int, tuple[float, float]]) -> dict[int, list[Array]]:
    """``lag_parts`` scaled so that products of rows are the shrunk correlations; ``shrunk`` has by lag the intensity and the mean variance."""
    out = {}
    for lag, parts in lag_parts(g, tuple(shrunk)).items():
        d, mu = shrunk[lag]
        out[lag] = [z * math.sqrt((1 - d) / z.shape[1]) / np.sqrt(np.maximum((1 - d) * (z**2).sum(1) / z.shape[1] + d * mu, 1e-300))[:, None] for z in parts]
    return out


def strongest_comovement(ids: Array, rows: dict[int, list[Array]], others: Array, columns: dict[int, list[Array]], k: int, height: int = 256, width: int = 8192) -> tuple[Array, Array, Array]:
    """Of each of ``ids`` the k ``others`` (ascending) of the largest correlation over lags and orders, if positive; ties to the smaller one.

    Correlations exist for ``height`` x ``width`` pairs at a time.
    """
    out = []
    cuts = [0, *range(min(1024, len(others)), len(others), width), len(others)]
    for s in range(0, len(ids), height):
        own = ids[s : s + height]
        kept = np.zeros(0, int), np.zeros(0, int), np.zeros(0)  # row, place of the other, correlation
        least = np.full(len(own), 1e-12)
        for a, b in zip(cuts, cuts[1:], strict=False):
            best = None
            for lag, parts in rows.items():
                for left, right in ((0, 0),) if lag == 0 else ((0, 1), (1, 0)):
                    corr = parts[left][s : s + height] @ columns[lag][right][a:b].T
                    best = corr if best is None else np.maximum(best, corr, out=best)
            if best is None:
                continue
            at = np.searchsorted(others[a:b], own)
            same = np.flatnonzero((at < b - a) & (others[a:b][np.minimum(at, b - a - 1)] == own))
            best[same, at[same]] = -1
            if a == 0 and b > k:
                least = np.maximum(least, np.partition(best, b - k, axis=1)[:, b - k])
                row, place = np.nonzero(best >= least[:, None])
            else:
                row, place = np.nonzero(best >= least[:, None] if a == 0 else best > least[:, None])
            if not len(row):
                continue
            row, place, corr = (np.concatenate(v) for v in zip(kept, (row, place + a, best[row, place]), strict=True))
            order = np.lexsort((place, -corr, row))
            row, place, corr = row[order], place[order], corr[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = row[rank < k], place[rank < k], corr[rank < k]
            full = rank == k - 1
            least[row[full]] = np.maximum(least[row[full]], corr[full])
        out.append((own[kept[0]], others[kept[1]], kept[2]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (ids[:0], others[:0], np.zeros(0))


def _local_kernel(w: Links, k: int) -> tuple[Array, Array, Array]:
    """Each node itself and its k strongest (columns, weights that sum to 1, how many): the rows of a sparse matrix."""
    row = np.repeat(w._some, np.diff(np.append(w._starts, len(w._column))))
    order = np.lexsort((w._column, -w._weight, row))
    row, column, weight = row[order], w._column[order], w._weight[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    near = (rank < k) & (weight > 0)
    columns, weights = np.zeros((w.n, k + 1), int), np.zeros((w.n, k + 1))  # no neighbour: weight 0 of any
    columns[row[near], rank[near] + 1], weights[row[near], rank[near] + 1] = column[near], weight[near]
    columns[:, 0], weights[:, 0] = np.arange(w.n), 1
    return columns, weights / weights.sum(1, keepdims=True), (weights > 0).sum(1)


#: Columns of a dense matrix that a step of the fusion works on at a time; rows of a block of half a matrix, a multiple of it.
STRIP, BLOCK = 64, 256
#: Bytes of matrices that the fusion of a component holds in memory (the others lie in scratch files), and of its products.
ROOM, PRODUCT = 850_000_000, 60_000_000


def _strips(n: int, run: Callable[[slice], None], threads: int, height: int = STRIP, first: int = 0) -> None:
    parts = [slice(s, min(s + height, n)) for s in range(first, n, height)]
    if threads > 1 and len(parts) > 1:
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(run, parts))
    else:
        for part in parts:
            run(part)


class Half:
    """A symmetric matrix by blocks of rows, each from its diagonal on: half the room of a whole one; in a scratch file if asked."""

    def __init__(self, n: int, file: bool = False):
        self.n, self.starts = n, range(0, n, BLOCK)
        ends = np.cumsum([min(BLOCK, n - s) * (n - s) for s in self.starts])
        if file:
            with tempfile.TemporaryFile() as f:  # has no name, and goes with the array
                flat = np.memmap(f, float, "w+", shape=(int(ends[-1]),))
        else:
            flat = np.zeros(ends[-1])
        self.blocks = [flat[e - min(BLOCK, n - s) * (n - s) : e].reshape(-1, n - s) for s, e in zip(self.starts, ends, strict=True)]

    @classmethod
    def of(cls, w: Links, file: bool = False) -> Half:
        out = cls(w.n, file)
        for s, block in zip(out.starts, out.blocks, strict=True):
            i, j, v = (x[np.searchsorted(w.i, s) : np.searchsorted(w.i, s + BLOCK)] for x in (w.i, w.j, w.w))
            block[i - s, j - s] = v
            inside = j < s + BLOCK
            block[j[inside] - s, i[inside] - s] = v[inside]
        return out

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> Array:
        return self.columns(slice(i, i + 1))[:, 0]

    def columns(self, part: slice) -> Array:
        """Some columns of one block's, whole."""
        out, last = np.empty((self.n, part.stop - part.start)), part.start // BLOCK
        for s, block in zip(self.starts[: last + 1], self.blocks, strict=False):
            out[s : s + BLOCK] = block[:, part.start - s : part.stop - s]
        s = self.starts[last]
        out[s + BLOCK :] = self.blocks[last][part.start - s : part.stop - s, BLOCK:].T
        return out

    def scale(self, alpha: float) -> tuple[Array, Array]:
        """Of the kernel (``scaled``) what it takes: a factor by row, and the diagonal."""
        rows = np.zeros(self.n)
        for s, block in zip(self.starts, self.blocks, strict=True):
            np.fill_diagonal(block, 0)
            rows[s : s + BLOCK] += block.sum(1)
            rows[s + BLOCK :] += block[:, BLOCK:].sum(0)
        return np.divide((1 - alpha) / 2, rows, out=np.zeros_like(rows), where=rows > 0), np.where(rows > 0, alpha, 1.0)


def _kernels(full: list[Half], alpha: float, threads: int, mix: Callable[[list[Array]], None]) -> None:
    """Of symmetric matrices the kernels (rows that add up to 1 - alpha and alpha on the diagonal; the mean of each and its transpose), then ``mix`` of their blocks; in place."""
    factors = [w.scale(alpha) for w in full]

    def scaled(part: slice) -> None:
        at = part.start // BLOCK
        rows = slice(part.start - at * BLOCK, part.stop - at * BLOCK)
        for w, (c, d) in zip(full, factors, strict=True):
            some = w.blocks[at][rows]
            some *= c[part, None] + c[at * BLOCK :]
            some[np.arange(len(some)), np.arange(rows.start, rows.stop)] = d[part]
        mix([w.blocks[at][rows] for w in full])

    _strips(full[0].n, scaled, threads)


def _product(local: tuple[Array, Array, Array], rows: slice) -> Callable[[Array], Array]:
    """Block -> some rows of the sparse matrix times the block; rows of many entries come first, so that none is multiplied by nothing."""
    columns, weights, count = (v[rows] for v in local)
    order = np.argsort(-count, kind="stable")
    back = np.argsort(order)
    upto = [int((count > r).sum()) for r in range(columns.shape[1])]
    steps = [(np.ascontiguousarray(columns[order[:u], r]), weights[order[:u], r, None]) for r, u in enumerate(upto) if u]

    def run(block: Array) -> Array:
        out, step = np.empty((len(order), block.shape[1])), np.empty((len(order), block.shape[1]))
        for r, (column, weight) in enumerate(steps):
            some = step[: len(column)] if r else out
            np.take(block, column, axis=0, out=some, mode="clip")
            np.multiply(some, weight, out=some)
            if r:
                out[: len(column)] += some
        return np.take(out, back, axis=0, out=step, mode="clip")

    return run


def _spread(local: tuple[Array, Array, Array], p: Half, out: Half, threads: int) -> None:
    """S p S' into another matrix, S being sparse: of some rows S p first, then all that is right of their diagonal."""
    n = p.n
    height = max(1, PRODUCT // (8 * n * BLOCK)) * BLOCK
    for first in range(0, n, height):
        own = slice(first, min(first + height, n))
        some, turned = _product(local, own), np.empty((n, own.stop - first))

        def left(part: slice, some: Callable = some, turned: Array = turned) -> None:
            turned[part] = some(p.columns(part)).T

        _strips(n, left, threads)
        for s in range(first, own.stop, BLOCK):
            rest = _product(local, slice(s, n))

            def right(part: slice, rest: Callable = rest, turned: Array = turned, s: int = s, first: int = first) -> None:
                out.blocks[s // BLOCK][part.start - s : part.stop - s] = rest(np.ascontiguousarray(turned[:, part.start - first : part.stop - first])).T

            _strips(min(s + BLOCK, n), right, threads, first=s)


def _sparsified(f: Half, k: int, mutual: bool, tree: bool) -> tuple[Array, Array, Array]:
    """Links (i < j, w) of the k strongest of each node, with the edges of a maximum spanning forest; f loses its asymmetry and its diagonal."""
    found, n = [], len(f)
    for s, block in zip(f.starts, f.blocks, strict=True):
        block[:, :BLOCK] = (block[:, :BLOCK] + block[:, :BLOCK].T) / 2
        np.fill_diagonal(block, 0)
    for s in range(0, n, STRIP):
        part = np.ascontiguousarray(f.columns(slice(s, min(s + STRIP, n))).T)
        least = np.partition(part, n - k, axis=1)[:, n - k] if k < n else np.zeros(len(part))
        row, place = np.nonzero((part >= least[:, None]) & (part > 0))
        order = np.lexsort((place, -part[row, place], row))
        row, place = row[order], place[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        found.append(np.stack([row[rank < k] + s, place[rank < k], part[row, place][rank < k]]))
    row, place, w = np.concatenate(found, 1) if found else np.zeros((3, 0))
    pairs, at, count = np.unique((np.minimum(row, place) * n + np.maximum(row, place)).astype(int), return_index=True, return_counts=True)
    w = w[at]
    if mutual:
        pairs, w = pairs[count == 2], w[count == 2]
    if tree:
        a, b, d = _maximum_spanning_tree(f)
        pairs, at = np.unique(np.concatenate([pairs, np.minimum(a, b) * n + np.maximum(a, b)]), return_index=True)
        w = np.concatenate([w, d])[at]
    i, j = np.divmod(pairs, max(n, 1))
    return i, j, w


def fused_links(layers: list[Links], k: int = 10, rounds: int = 10, alpha: float = 0.5, mutual: bool = True, tree: bool = True, threads: int = 1, small: int = 512) -> Links:
    """Similarity network fusion: each layer's kernel spreads over the others' mean through its own local kernel.

    Nothing passes between components of all layers together, so each has dense matrices of its own, components of up to ``small`` nodes in common ones:
    half a matrix for each layer and one more, of which those beyond ``ROOM`` bytes lie in scratch files of the task.
    """
    n = layers[0].n
    some = [w for w in layers if w.w.any()]
    whole = Links(n, *(np.concatenate([getattr(w, c) for w in some] or [np.zeros(0, int)]) for c in "ijw"))
    part = parts_of(n, whole.i, whole.j)
    sizes = np.bincount(part)
    upto, bins, last = 0, [], -1
    for c in np.argsort(-sizes, kind="stable"):
        if sizes[c] == 1:
            break
        if last < 0 or upto + sizes[c] > small:
            last, upto = last + 1, 0
        bins.append((c, last))
        upto += sizes[c]
    of = np.full(len(sizes), -1)
    for c, b in bins:
        of[c] = b
    out = []
    for b in range(last + 1):
        own = np.flatnonzero(of[part] == b)
        i, j, w = _fused_part([w.among(own) for w in some], k, rounds, alpha, mutual, tree, threads)
        out.append((own[i], own[j], w))
    i, j, w = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return Links(n, i, j, w / w.max() if len(w) else w)


def _fused_part(layers: list[Links], k: int, rounds: int, alpha: float, mutual: bool, tree: bool, threads: int) -> tuple[Array, Array, Array]:
    n, m = layers[0].n, len(layers)
    file = [4 * n * (n + BLOCK) * (v + 1) > ROOM for v in range(m + 1)]
    full = [Half.of(w, f) for w, f in zip(layers, file, strict=False)]
    if m > 1:
        local = [_local_kernel(w, min(k, n - 1)) for w in layers]

        def others(parts: list[Array]) -> None:
            if m > 2:  # else the mean of the others is the other
                total = sum(parts[1:], parts[0])
                for p in parts:
                    p -= total
                    p /= 1 - m

        def mean(parts: list[Array]) -> None:
            for p in parts[1:]:
                parts[0] += p
            parts[0] /= m

        spare = Half(n, file[-1])
        for _ in range(rounds):
            _kernels(full, alpha, threads, others)
            if m == 2:
                full.reverse()
            for v, s in enumerate(local):
                _spread(s, full[v], spare, threads)
                full[v], spare = spare, full[v]
        del spare
        _kernels(full, alpha, threads, mean)
        del full[1:]
    return _sparsified(full[0], k, mutual, tree)


def fused(layers: list[Array | Links], k: int = 10, rounds: int = 10, alpha: float = 0.5, mutual: bool = True, tree: bool = True) -> Array:
    """``fused_links`` as a matrix."""
    return fused_links([Links.of(w) for w in layers], k, rounds, alpha, mutual, tree).dense()


def parts_of(n: int, i: Array, j: Array) -> Array:
    """The component of each of n nodes, numbered from 0 by their smallest nodes."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return relabelled(label)
        label = new


def _parts(a: Array) -> int:
    return len(np.unique(parts_of(len(a), *np.nonzero(a > 0))))


def laplacian_spectrum(a: Array) -> Array:
    """Eigenvalues of the normalised Laplacian, ascending."""
    d = a.sum(1)
    s = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    lap = np.diag((d > 0).astype(float)) - s[:, None] * a * s
    return np.clip(np.linalg.eigvalsh((lap + lap.T) / 2), 0, 2)


def modularity_matrix(a: Array) -> Array:
    d = a.sum(1)
    total = d.sum()
    return a - np.outer(d, d) / total if total > 0 else a.copy()


def rewired(i: Array, j: Array, w: Array, rng: np.random.Generator, swaps: int = 10) -> tuple[Array, Array, Array]:
    """A graph of the same degrees: ``swaps`` double-edge swaps for each edge, then weights in random order."""
    ends = [(int(a), int(b)) for a, b in zip(i, j, strict=True)]
    known = {tuple(sorted(e)) for e in ends}
    m = len(ends)
    for _ in range(swaps * m if m > 1 else 0):
        x, y = rng.integers(0, m, 2)
        (a, b), (c, d) = ends[x], ends[y]
        if rng.random() < 0.5:
            c, d = d, c
        if len({a, b, c, d}) < 4:
            continue
        new = (tuple(sorted((a, d))), tuple(sorted((c, b))))
        if new[0] in known or new[1] in known:
            continue
        known -= {tuple(sorted(ends[x])), tuple(sorted(ends[y]))}
        known |= set(new)
        ends[x], ends[y] = (a, d), (c, b)
    pairs = np.array([sorted(e) for e in ends], int).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], rng.permutation(w)


# ---------------------------------------------------------------------------------------------- clustering


def relabelled(labels: Array) -> Array:
    return np.unique(labels, return_inverse=True)[1]


def _seeds(norms: Array, product: Callable[[int], Array], k: int, rng: np.random.Generator) -> list[int]:
    """Rows to begin with, spread out; ``product`` gives the products of all rows with one."""
    n = len(norms)
    to = lambda c: np.maximum(norms + norms[c] - 2 * product(c), 0)
    chosen = [int(rng.integers(n))]
    d = to(chosen[0])
    for _ in range(1, k):
        total = d.sum()
        trials = rng.choice(n, size=min(n, 2 + int(math.log(k + 1))), p=d / total if total > 0 else None)
        options = [np.minimum(d, to(t)) for t in trials]
        best = int(np.argmin([o.sum() for o in options]))
        chosen.append(int(trials[best]))
        d = options[best]
    return chosen


def _least(d: Array) -> Array:
    """Of each column the row of its least entry, the first on ties."""
    best, label = d[0].copy(), np.zeros(d.shape[1], int)
    for c in range(1, len(d)):
        np.copyto(label, c, where=d[c] < best)
        np.minimum(best, d[c], out=best)
    return label


def _gaps(d: Array, label: Array) -> Array:
    """How much farther than the centre of its label each column's next centre is; takes the entries of the labels out of d."""
    at = np.arange(len(label))
    own = np.sqrt(d[label, at])
    d[label, at] = np.inf
    return np.sqrt(d.min(0)) - own


def _approach(step: Array) -> Array:
    """By centre, how much nearer another one may have come to its points when all moved by these steps."""
    order = np.argsort(step)
    other = np.full(len(step), step[order[-1]])
    other[order[-1]] = step[order[-2]] if len(step) > 1 else 0
    return step + other


def _lloyd(x: Array, norms: Array, centres: Array, rounds: int) -> tuple[Array, Array]:
    """Labels and centres when no point changes any more. A point is compared with the centres again when they have moved by as much as the next one was farther."""
    k = len(centres)
    slack = 1e-7 * math.sqrt(norms.max(initial=0))  # of distances, beyond the rounding of their squares

    def distances(rows: Array | slice) -> Array:
        d = (-2 * centres) @ x[rows].T
        d += norms[rows]
        d += (centres**2).sum(1)[:, None]
        return np.maximum(d, 0, out=d)

    d = distances(slice(None))
    label, moved = _least(d), np.zeros(k)
    until = _gaps(d, label) - slack  # what the centre of its label may have moved before a point is looked at
    sizes, sums = np.bincount(label, minlength=k), np.stack([np.bincount(label, c, k) for c in x.T], 1)
    for _ in range(rounds - 1):
        new = sums / np.maximum(sizes, 1)[:, None]
        if not sizes.all():
            new[sizes == 0] = x[int(distances(slice(None)).min(0).argmax())]
        moved += _approach(np.sqrt(((new - centres) ** 2).sum(1)))
        centres = new
        some = np.flatnonzero(until <= moved[label])
        d = distances(some)
        found = _least(d)
        until[some] = _gaps(d, found) + moved[found] - slack
        changed = found != label[some]
        if not changed.any():
            break
        old, now, rows = label[some[changed]], found[changed], x[some[changed]]
        sizes += np.bincount(now, minlength=k) - np.bincount(old, minlength=k)
        sums += np.stack([np.bincount(now, c, k) - np.bincount(old, c, k) for c in rows.T], 1)
        label[some] = found
    return label, centres


def kmeans(x: Array, k: int, rng: np.random.Generator, n_init: int = 10, rounds: int = 300) -> Array:
    """Labels of the least inertia over ``n_init`` starts with spread-out seeds."""
    best, labels, norms = np.inf, np.zeros(len(x), int), (x**2).sum(1)
    for _ in range(n_init):
        now, centres = _lloyd(x, norms, x[_seeds(norms, lambda c: x @ x[c], k, rng)], rounds)
        inertia = ((x - centres[now]) ** 2).sum()
        if inertia < best:
            best, labels = inertia, now
    return relabelled(labels)


def ward(x: Array, k: int) -> Array:
    """Ward's agglomeration cut at k clusters."""
    return ward_cuts(x, [k])[0]


def ward_cuts(x: Array, ks: Sequence[int]) -> list[Array]:
    """One agglomeration cut at each k, by chains of nearest neighbours; clusters that are gone are left out as soon as they are half of all."""
    n = len(x)
    centre, size, names = x.astype(float).T.copy(), np.ones(n), np.arange(n)  # a row for each dimension
    alive, gone = np.ones(n, bool), 0
    merges, chain = [], []
    for _ in range(n - 1):
        if gone > 64 and 2 * gone > len(names):
            place = np.cumsum(alive) - 1
            chain = [int(place[c]) for c in chain]
            centre, size, names = centre[:, alive].copy(), size[alive], names[alive]
            alive, gone = np.ones(len(names), bool), 0
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            a = chain[-1]
            cost = np.zeros(len(names))
            for row in centre:
                step = row - row[a]
                cost += np.square(step, out=step)
            cost *= size
            cost *= size[a]
            cost /= size + size[a]
            cost[~alive] = np.inf
            cost[a] = np.inf
            b = int(cost.argmin())
            if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        merges.append((float(cost[b]), int(names[a]), int(names[b])))
        centre[:, a] = (size[a] * centre[:, a] + size[b] * centre[:, b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        gone += 1
    merges.sort(key=lambda m: m[0])

    def cut(k: int) -> Array:
        parent = list(range(n))

        def root(v: int) -> int:
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for _, a, b in merges[: max(0, n - k)]:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return relabelled(np.array([root(v) for v in range(n)]))

    return [cut(k) for k in ks]


def spectral(a: Array | Links, k: int) -> Array:
    """Clusters from the first k eigenvectors of the normalised Laplacian, assigned by pivoted QR."""
    return spectral_cuts(a, [k])[0]


def spectral_cuts(a: Array | Links, ks: Sequence[int]) -> list[Array]:
    """``spectral`` for each k, from eigenvectors that are taken once; the graph stays its links."""
    a = Links.of(a)
    n, most = len(a), max(ks)
    part = parts_of(n, a.i[a.w > 0], a.j[a.w > 0])
    sizes = np.bincount(part)
    apart = 1e-6 if len(sizes) > 1 else 0.0  # parts without links between them: a weak link between any two nodes
    d = np.sqrt(np.maximum(a.degrees() + apart * (n - 1), 1e-300))

    def times(m: Array) -> Array:
        m = m / d[:, None]
        return (a @ m + apart * (m.sum(0) - m)) / d[:, None]

    # what only tells parts apart is nearly equal among many: it begins solved
    own, length = np.bincount(part, a.degrees()), np.sqrt(np.bincount(part, d**2))
    tell = (own - apart * sizes) / length**2
    few = np.argsort(tell, kind="stable")[-1024:]  # the others together tell themselves apart from these
    rest = np.setdiff1d(np.arange(len(sizes)), few)
    one = np.sqrt(apart) * sizes / length
    size = np.linalg.norm(one[rest])
    among = np.diag(np.append(tell[few], (tell[rest] * one[rest] ** 2).sum() / size**2 if size > 0 else 0)) + np.outer(np.append(one[few], size), np.append(one[few], size))
    turn = np.linalg.eigh(among if len(rest) else among[:-1, :-1])[1][:, -4 * most :]
    whole = np.zeros((len(sizes), turn.shape[1]))
    whole[few] = turn[: len(few)]
    if len(rest):
        whole[rest] = one[rest, None] / max(size, 1e-300) * turn[-1]
    vectors = leading(times, n, most, (d / length[part])[:, None] * whole[part])
    return [_assigned(vectors[:, -k:]) for k in ks]


def _assigned(v: Array) -> Array:
    """Clusters of the rows of k eigenvectors: the k rows that span most are chosen one by one."""
    rest, pivots = v.T.copy(), []
    for _ in range(v.shape[1]):
        p = int((rest**2).sum(0).argmax())
        pivots.append(p)
        q = rest[:, p] / max(np.linalg.norm(rest[:, p]), 1e-300)
        rest = rest - np.outer(q, q @ rest)
    u, _, w = np.linalg.svd(v[pivots].T)
    return relabelled(np.abs(v @ (u @ w)).argmax(1))


def leading(times: Callable[[Array], Array], n: int, k: int, first: Array | None = None, small: int = 512, tol: float = 1e-9, rounds: int = 2000) -> Array:
    """Eigenvectors of the k largest eigenvalues, ascending, of a symmetric matrix of norm about 1 that is known by its products.

    A basis, of the columns of ``first`` and some at random, grows by the residuals of the largest Ritz pairs and is cut back to the best of them when it is wide; where that does not come to an end in
    ``rounds``, and up to ``small`` rows, the matrix is made.
    """
    if n > small:
        width = k + 4
        wide = 16 * width
        rng = np.random.default_rng(0)
        basis, image, h = np.zeros((n, wide)), np.zeros((n, wide)), np.zeros((wide, wide))
        new, m = np.linalg.qr(np.hstack([np.zeros((n, 0)) if first is None else first[:, -4 * width :], rng.standard_normal((n, width))]))[0], 0
        for _ in range(rounds):
            to = slice(m, m + new.shape[1])
            basis[:, to], image[:, to] = new, times(new)
            m = to.stop
            h[:m, to] = basis[:, :m].T @ image[:, to]
            h[to, :m] = h[:m, to].T
            values, turn = np.linalg.eigh((h[:m, :m] + h[:m, :m].T) / 2)
            best = turn[:, -width:]
            found = basis[:, :m] @ best
            rest = image[:, :m] @ best - found * values[-width:]
            far = np.linalg.norm(rest, axis=0)
            if (far[-k:] <= tol).all():
                return found[:, -k:]
            rest = rest[:, far > tol] / far[far > tol]
            if m + rest.shape[1] > wide:
                keep = turn[:, -4 * width :]
                m = keep.shape[1]
                basis[:, :m], image[:, :m] = basis[:, : len(keep)] @ keep, image[:, : len(keep)] @ keep
                h[:m, :m] = np.diag(values[-m:])
            for _ in range(2):  # twice is enough
                rest -= basis[:, :m] @ (basis[:, :m].T @ rest)
                rest, r = np.linalg.qr(rest)
            new = rest - basis[:, :m] @ (basis[:, :m].T @ rest)
    return np.linalg.eigh(times(np.eye(n)))[1][:, -k:]


Graph = list[dict[int, float]]


def adjacency(n: int, i: Array, j: Array, w: Array) -> Graph:
    out: Graph = [{} for _ in range(n)]
    for a, b, x in zip(i.tolist(), j.tolist(), w.tolist(), strict=True):
        out[a][b] = out[a].get(b, 0.0) + x
        out[b][a] = out[b].get(a, 0.0) + x
    return out


#: Of each node its strength in the slices that it has a part in, as pairs (slice, strength).
Null = list[list[tuple[int, float]]]


def leiden(graph: Graph, gamma: float, rng: np.random.Generator, rounds: int = 10, null: Null | None = None) -> Array:
    """Communities of high modularity at resolution gamma: local moves, refinement within communities, aggregation, again.

    ``null`` gives for several slices the strength of each node in its slices; by default there is one slice.
    """
    n = len(graph)
    if null is None:
        null = [[(0, x)] if x else [] for x in (sum(g.values()) for g in graph)]
    totals = [0.0] * (1 + max((t for own in null for t, _ in own), default=0))
    for own in null:
        for t, x in own:
            totals[t] += x
    totals = [max(t, 1e-300) for t in totals]
    member = np.arange(n)
    nodes = graph
    start: list[int] | None = None
    for _ in range(rounds):
        label = _move(nodes, null, totals, gamma, rng, start)
        count = label.max() + 1 if len(label) else 0
        if count == len(nodes):
            break
        found = _refine(nodes, null, totals, gamma, rng, label)
        parts, fine = int(found.max()) + 1, found.tolist()
        small: Graph = [{} for _ in range(parts)]
        for a, links in enumerate(nodes):
            into = small[fine[a]]
            for b, x in links.items():
                fb = fine[b]
                into[fb] = into.get(fb, 0.0) + x
        merged: list[dict[int, float]] = [{} for _ in range(parts)]
        for a, own in enumerate(null):
            into = merged[fine[a]]
            for t, x in own:
                into[t] = into.get(t, 0.0) + x
        null = [sorted(own.items()) for own in merged]
        first = np.zeros(parts, int)
        first[found] = label
        start = first.tolist()
        if parts == len(nodes):
            return relabelled(label[member])
        member = found[member]
        nodes = small
    final = _move(nodes, null, totals, gamma, rng, start)
    return relabelled(final[member])


def _sums(null: Null, label: list[int], width: int) -> list[dict[int, float]]:
    """Of each community its strength by slice."""
    sums: list[dict[int, float]] = [{} for _ in range(width)]
    for own, c in zip(null, label, strict=True):
        into = sums[c]
        for t, x in own:
            into[t] = into.get(t, 0.0) + x
    return sums


def _move(nodes: Graph, null: Null, totals: list[float], gamma: float, rng: np.random.Generator, start: list[int] | None) -> Array:
    n = len(nodes)
    label = list(range(n)) if start is None else start.copy()
    sums = _sums(null, label, max(n, max(label, default=-1) + 1))
    queue = rng.permutation(n).tolist()
    waiting = [True] * n
    for v in queue:  # grows on the way
        waiting[v] = False
        links = nodes[v]
        own = label[v]
        toward: dict[int, float] = {}
        for u, x in links.items():
            if u != v:
                c = label[u]
                toward[c] = toward.get(c, 0.0) + x
        if not toward:
            continue
        slices = null[v]
        from_ = sums[own]
        for t, x in slices:
            from_[t] -= x
        best, gain = own, toward.get(own, 0.0) - _cost(slices, from_, totals, gamma)
        for c in sorted(toward):
            g = toward[c] - _cost(slices, sums[c], totals, gamma)
            if g > gain + 1e-12:
                best, gain = c, g
        into = sums[best]
        for t, x in slices:
            into[t] = into.get(t, 0.0) + x
        if best != own:
            label[v] = best
            for u in links:
                if not waiting[u] and label[u] != best:
                    waiting[u] = True
                    queue.append(u)
    return relabelled(np.array(label, int))


def _cost(slices: list[tuple[int, float]], sums: dict[int, float], totals: list[float], gamma: float) -> float:
    """What the null takes from joining a community of these sums."""
    if len(slices) == 1:
        t, x = slices[0]
        return gamma * (x * sums[t] / totals[t]) if t in sums else 0.0
    out = 0.0
    for t, x in slices:
        if t in sums:
            out += x * sums[t] / totals[t]
    return gamma * out


def _refine(nodes: Graph, null: Null, totals: list[float], gamma: float, rng: np.random.Generator, label: Array) -> Array:
    n = len(nodes)
    coarse, fine = label.tolist(), list(range(n))
    sums = [dict(own) for own in null]
    size = [1] * n
    for v in rng.permutation(n).tolist():
        if size[fine[v]] > 1:
            continue
        toward: dict[int, float] = {}
        own = coarse[v]
        for u, x in nodes[v].items():
            if u != v and coarse[u] == own:
                c = fine[u]
                toward[c] = toward.get(c, 0.0) + x
        best, gain, slices = -1, 1e-12, null[v]
        for c in sorted(toward):
            g = toward[c] - _cost(slices, sums[c], totals, gamma)
            if g > gain:
                best, gain = c, g
        if best >= 0:
            into, from_ = sums[best], sums[fine[v]]
            for t, x in slices:
                into[t] = into.get(t, 0.0) + x
                from_[t] -= x
            size[best] += 1
            size[fine[v]] -= 1
            fine[v] = best
    return relabelled(np.array(fine, int))


def resolution_for(k: int, probe: Callable[[float], Array], count: Callable[[Array], int], low: float = 0.05, high: float = 5.0, calls: int = 30) -> Array:
    """The partition of the probe that has k communities, by bisection of the logarithm of the resolution; else the nearest.

    Parts without links between them stay apart at any resolution: with more than k of them the search ends at a low one.
    """
    best: tuple[int, Array] | None = None

    def look(gamma: float) -> int:
        nonlocal best
        labels = probe(gamma)
        found = count(labels)
        if best is None or abs(found - k) < best[0]:
            best = abs(found - k), labels
        return found

    a, b = low, high
    used = 0
    while used < calls and look(a) > k:
        if a < 1e-4:
            return best[1]
        a, used = a / 10, used + 1
    while used < calls and best[0] and look(b) < k:
        b, used = b * 10, used + 1
    while used < calls and best[0]:
        middle = math.sqrt(a * b)
        found = look(middle)
        a, b = (middle, b) if found < k else (a, middle)
        used += 1
    return best[1]


def absorb_small(labels: Array, a: Array | Links, min_size: int) -> Array:
    """Communities below min_size join the large one they share most weight with, or the largest."""
    ids, sizes = np.unique(labels, return_counts=True)
    large = ids[sizes >= min_size]
    if not len(large):
        return labels
    out, links = labels.copy(), Links.of(a)
    both = np.concatenate([labels[links.i], labels[links.j]]), np.concatenate([labels[links.j], labels[links.i]]), np.concatenate([links.w, links.w])
    for c in ids[sizes < min_size]:
        own = both[0] == c
        weight = [both[2][own & (both[1] == g)].sum() for g in large]
        out[labels == c] = large[int(np.argmax(weight))] if max(weight) > 0 else large[int(np.argmax([sizes[ids == g][0] for g in large]))]
    return out


def leiden_k(a: Array | Links, k: int, rng: np.random.Generator, min_size: int = 1) -> Array:
    """k communities of at least min_size nodes."""
    return leiden_cuts(a, [k], rng, min_size)[0]


def leiden_cuts(a: Array | Links, ks: Sequence[int], rng: np.random.Generator, min_size: int = 1) -> list[Array]:
    """``leiden_k`` for each k, whose searches share what they find at a resolution.

    Parts without links between them never join, and at a low resolution each is one community: with k parts or more these are the nearest to k that there is.
    """
    a = Links.of(a)
    graph, seed = None, int(rng.integers(1 << 31))
    seen: dict[float, Array] = {}
    large = lambda labels: int((np.unique(labels, return_counts=True)[1] >= min_size).sum())
    parts = parts_of(len(a), a.i[a.w > 0], a.j[a.w > 0])

    def probe(gamma: float) -> Array:
        nonlocal graph
        if gamma not in seen:
            graph = graph or adjacency(len(a), a.i, a.j, a.w)
            seen[gamma] = leiden(graph, gamma, np.random.default_rng(seed))
        return seen[gamma]

    apart = [min_size <= 1 and len(a) and parts.max() + 1 >= k for k in ks]
    return [relabelled(absorb_small(parts if whole else resolution_for(k, probe, large), a, min_size)) for k, whole in zip(ks, apart, strict=True)]


def temporal_leiden(slices: list[Array | Links], k: int, rng: np.random.Generator, omega: float = 0.25, min_size: int = 1) -> Array:
    """Labels (period x node) of one multislice graph: a node is linked to itself in the next slice with weight omega.

    Parts without links between them never join (``leiden_cuts``): with k of them in a slice or more, by the median, these are the nearest to k that there is.
    """
    slices = [Links.of(a) for a in slices]
    t, n = len(slices), len(slices[0])
    i, j, w = [], [], []
    for s, a in enumerate(slices):
        i.append(a.i + s * n)
        j.append(a.j + s * n)
        w.append(a.w)
    for s in range(t - 1):
        i.append(np.arange(n) + s * n)
        j.append(np.arange(n) + (s + 1) * n)
        w.append(np.full(n, omega))
    i, j, w = (np.concatenate(v) for v in (i, j, w))
    seed = int(rng.integers(1 << 31))

    def count(labels: Array) -> int:
        per = [(np.unique(part, return_counts=True)[1] >= min_size).sum() for part in labels.reshape(t, n)]
        return int(round(float(np.median(per))))

    found = parts_of(t * n, i[w > 0], j[w > 0])
    if min_size > 1 or count(found) < k:
        graph = adjacency(t * n, i, j, w)
        null = [[(s, x)] if x else [] for s, a in enumerate(slices) for x in a.degrees().tolist()]
        found = resolution_for(k, lambda g: leiden(graph, g, np.random.default_rng(seed), null=null), count, calls=16)
    found = found.reshape(t, n)
    return relabelled(np.stack([absorb_small(row, a, min_size) for row, a in zip(found, slices, strict=True)]).ravel()).reshape(t, n)


@dataclass
class Joint:
    """Result of joint clustering of features and network rows."""

    labels: Array
    objective: float
    history: list[float] = field(default_factory=list)
    n_iter: int = 0
    centres: tuple[Array, Array] | None = None


class _Joined:
    """Rows of features and of the modularity matrix side by side, scaled; the matrix is its links less a product of degrees, and rows are made on demand."""

    def __init__(self, y: Array, links: Links):
        self.y, self.links, self.rows, self.xi, self.scaled = y, links, np.ones(len(y)), 1.0, False
        self.d = links.degrees()
        self.total = self.d.sum()

    def _less(self, m: Array) -> Array:
        """The modularity matrix times m."""
        out = self.links @ m
        return out - (np.outer(self.d, self.d @ m / self.total) if m.ndim > 1 else self.d * (self.d @ m / self.total)) if self.total > 0 else out

    def squares(self) -> Array:
        """Squared lengths of the matrix's rows, without the scale."""
        out = Links(self.links.n, self.links.i, self.links.j, self.links.w**2).degrees()
        if self.total > 0:
            out = out - 2 * self.d * (self.links @ self.d) / self.total + self.d**2 * (self.d @ self.d) / self.total**2
        return np.maximum(out, 0) * self.rows**2

    def __len__(self) -> int:
        return len(self.y)

    def __matmul__(self, m: Array) -> Array:
        split = self.y.shape[1]
        scale = math.sqrt(self.xi) * self.rows
        return self.y @ m[:split] + (scale if m.ndim == 1 else scale[:, None]) * self._less(m[split:])

    def sums(self, one: Array) -> Array:
        """The sums of rows by the columns of ``one``."""
        return np.hstack([one.T @ self.y, math.sqrt(self.xi) * self._less(self.rows[:, None] * one).T])

    def __getitem__(self, at: int | list[int]) -> Array:
        one = np.zeros((len(self), 1 if isinstance(at, int | np.integer) else len(at)))
        one[at, np.arange(one.shape[1])] = 1
        return self.sums(one)[0] if isinstance(at, int | np.integer) else self.sums(one)

    def prepared(self) -> None:
        """Before ``products`` and ``Centres``: what does not change any more."""
        self.twice = self.links.paths()
        self.e = self.links @ self.d
        self.per = 1 / self.total if self.total > 0 else 0.0
        self.flat = np.stack([*self.y.T, self.rows * self.e, self.rows * self.d, np.ones(len(self))])

    def spread(self, nodes: Array, to: Array, k: int, sign: float = 1.0) -> Array:
        """k x nodes: the links' matrix, twice, times the matrix whose entry (node, its ``to``) is the node's scale."""
        n = len(self)
        if self.twice is None:
            one = np.zeros((n, k))
            one[nodes, to] = sign * self.rows[nodes]
            return (self.links @ (self.links @ one)).T
        begin, column, value = self.twice
        count = begin[nodes + 1] - begin[nodes]
        at = ranges(begin[nodes], count)
        cells = np.bincount(np.repeat(to * n, count) + column[at], value[at] * np.repeat(sign * self.rows[nodes], count), k * n)
        return cells.reshape(k, n)

    def add(self, raw: Array, nodes: Array, to: Array, sign: Array) -> None:
        """``spread`` of few nodes, added in place."""
        begin, column, value = self.twice
        count = begin[nodes + 1] - begin[nodes]
        at = ranges(begin[nodes], count)
        np.add.at(raw.reshape(-1), np.repeat(to * len(self), count) + column[at], value[at] * np.repeat(sign * self.rows[nodes], count))

    def products(self, c: int) -> Array:
        """The products of all rows with one of them."""
        both = self.spread(np.array([c]), np.array([0]), 1)[0]
        d, e, per = self.d[c] * self.rows[c], self.e[c] * self.rows[c], self.per
        both = both - self.e * (d * per) - self.d * (e * per - (self.d @ self.d) * d * per**2)
        return self.y @ self.y[c] + self.xi * self.rows * both


class _Centres:
    """Centres of joined rows: of the features as they are, of the matrix as a factor by the sum of some rows, known by its products with all rows alone."""

    def __init__(self, z: _Joined, nodes: Array, label: Array, k: int):
        self.z, self.k = z, k
        self.raw = z.spread(nodes, label, k)  # of the links alone
        self.table = np.stack([np.bincount(label, c[nodes], k) for c in z.flat], 1)  # sums of features, of what the degrees take, and numbers
        e, d = self.table[:, -3], self.table[:, -2]
        own = np.bincount(label, self.raw[label, nodes] * z.rows[nodes], k)
        self.square = np.maximum(own - 2 * d * z.per * e + (z.d @ z.d) * (d * z.per) ** 2, 0)  # of the sum of the matrix's rows
        self._means()

    def _means(self) -> None:
        self.sizes = self.table[:, -1]
        self.y, self.factor = self.table[:, :-3] / self.sizes[:, None], 1 / self.sizes

    def _taken(self) -> tuple[Array, Array]:
        """What the degrees take from the products: factors of d and of e."""
        z, e, d = self.z, self.table[:, -3], self.table[:, -2]
        return e * z.per - (z.d @ z.d) * d * z.per**2, d * z.per

    def _at(self, nodes: Array, label: Array) -> Array:
        """The products of some rows with the sums of the labels given for them."""
        of_d, of_e = self._taken()
        return self.raw[label, nodes] * self.z.rows[nodes] - of_d[label] * self.z.flat[-2, nodes] - of_e[label] * self.z.flat[-3, nodes]

    def moved(self, changed: Array, old: Array, new: Array, label: Array) -> tuple[Array, Array]:
        """Some rows leave their ``old`` labels for ``new`` ones (``label`` has all). What the sums of the matrix's rows have in common with their change, and the change's square."""
        nodes, to, sign = np.concatenate([changed, changed]), np.concatenate([new, old]), np.repeat([1.0, -1.0], len(changed))
        before = self._at(nodes, to)
        if self.z.twice is None or 3 * len(changed) > len(label):
            self.raw = self.z.spread(np.arange(len(label)), label, self.k)
        else:
            self.z.add(self.raw, nodes, to, sign)
        self.table = self.table + np.stack([np.bincount(to, sign * c[nodes], self.k) for c in self.z.flat], 1)
        common = np.bincount(to, sign * before, self.k)
        change = np.bincount(to, sign * (self._at(nodes, to) - before), self.k)
        self.square = np.maximum(self.square + 2 * common + change, 0)
        self._means()
        return common, change

    def lengths(self) -> Array:
        return (self.y**2).sum(1) + self.z.xi * self.factor**2 * self.square

    def within(self) -> Array:
        """The product of each centre and the sum of its rows."""
        return (self.table[:, :-3] * self.y).sum(1) + self.z.xi * self.factor * self.square

    def distances(self, norms: Array, rows: Array | slice = slice(None)) -> Array:
        """k x rows: squared distances."""
        z, share = self.z, 2 * self.z.xi * self.factor
        of_d, of_e = self._taken()
        d = np.column_stack([-2 * self.y, share * of_e, share * of_d, self.lengths()]) @ z.flat[:, rows]
        part = self.raw[:, rows] * share[:, None]
        if z.scaled:
            part *= z.rows[rows]
        d -= part
        d += norms[rows]
        return np.maximum(d, 0, out=d)


def joint_kmeans(y: Array, a: Array | Links, k: int, rng: np.random.Generator, rho: float = 1.0, xi: float = 1.0, metric: str = "euclidean", balanced: bool = False, n_init: int = 10, rounds: int = 100, tol: float = 1e-6) -> Joint:
    """Clusters that fit features Y and modularity rows P at once: least rho |Y - S C|^2 + xi |P - S L|^2.

    Balanced: xi is scaled by |Y|^2 / |P|^2. Cosine: rows and centres have length 1. An empty cluster takes the
    farthest point. The best of n_init starts; its history of the objective falls. P is never made, nor are its centres: a round costs nodes times k, and
    the paths of two links from the nodes that changed.
    """
    z = _Joined(y, Links.of(a))
    if metric == "cosine":
        z.y = y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        z.rows, z.scaled = 1 / np.maximum(np.sqrt(z.squares()), 1e-12), True
    if balanced:
        xi = xi * (y**2).sum() / max(z.squares().sum(), 1e-300)
    z.y, z.xi = math.sqrt(rho) * y, xi
    z.prepared()
    best: tuple[float, list[float], Array, Array, Array] | None = None
    norms, n = (z.y**2).sum(1) + xi * z.squares(), len(z)
    slack = 1e-7 * math.sqrt(norms.max(initial=0))
    for _ in range(n_init):
        seeds = np.array(_seeds(norms, z.products, k, rng))
        centres = _Centres(z, seeds, np.arange(k), k)
        labels, history = None, []
        moved, until = np.zeros(k), np.full(n, -np.inf)  # as of k-means
        for _ in range(rounds):
            some = np.arange(n) if labels is None else np.flatnonzero(until <= moved[labels])
            d = centres.distances(norms, some)
            found = _least(d)
            until[some] = _gaps(d, found) + moved[found] - slack
            new = np.zeros(n, int) if labels is None else labels.copy()
            new[some] = found
            if not np.bincount(new, minlength=k).all():
                d = centres.distances(norms)
                for c in range(k):
                    if not (new == c).any():
                        far = int(d[new, np.arange(n)].argmax())
                        new[far] = c
                        d[:, far], until[far] = 0, -np.inf
            changed = np.arange(n) if labels is None else np.flatnonzero(new != labels)
            was = centres.y, centres.factor, centres.square
            if labels is None:
                centres = _Centres(z, changed, new, k)
            elif len(changed):
                common, change = centres.moved(changed, labels[changed], new[changed], new)
            if metric == "cosine" and len(changed):
                length, across = np.linalg.norm(centres.y, axis=1, keepdims=True), np.sqrt(xi * centres.square) * centres.factor
                centres.y = np.where(length > 1e-12, centres.y / np.maximum(length, 1e-12) * math.sqrt(rho), centres.y)
                centres.factor = np.where(across > 1e-12, centres.factor / np.maximum(across, 1e-12) * math.sqrt(xi), centres.factor)
            if labels is None:
                until[:] = -np.inf  # the seeds were no means: how far they moved is not known
            elif len(changed):
                off = centres.factor - was[1]
                moved += _approach(np.sqrt(np.maximum(((centres.y - was[0]) ** 2).sum(1) + xi * (centres.factor**2 * change + 2 * centres.factor * off * common + off**2 * was[2]), 0)))
            history.append(float(max(norms.sum() - 2 * centres.within().sum() + (centres.sizes * centres.lengths()).sum(), 0)))
            same = labels is not None and not len(changed)
            labels = new
            if same or len(history) > 1 and history[-2] - history[-1] <= tol * max(history[-2], 1e-300):
                break
        if best is None or history[-1] < best[0]:
            best = history[-1], history, labels, centres.y, centres.factor
    objective, history, labels, own, factor = best
    one = np.zeros((n, k))
    one[np.arange(n), labels] = z.rows
    return Joint(relabelled(labels), objective, history, len(history), (own / math.sqrt(rho), factor[:, None] * z._less(one).T))


#: Functions of points, graph, k and a generator. Those of LINKS take the graph as ``Links``, the others as a matrix.
METHODS: dict[str, Callable[[Array, Array, int, np.random.Generator], Array]] = {
    "kmeans": lambda x, a, k, rng: kmeans(x, k, rng),
    "ward": lambda x, a, k, rng: ward(x, k),
    "spectral": lambda x, a, k, rng: spectral(a, k),
    "leiden": lambda x, a, k, rng: leiden_k(a, k, rng),
    "kefrin": lambda x, a, k, rng: joint_kmeans(x, a, k, rng).labels,
    "kefrin_balanced": lambda x, a, k, rng: joint_kmeans(x, a, k, rng, balanced=True).labels,
}


LINKS = {METHODS[m] for m in ("kmeans", "ward", "spectral", "leiden", "kefrin", "kefrin_balanced")}
#: Functions of points, graph and several k, for methods that draw nothing and find the clusters of all k from one and the same work.
CUTS = {METHODS["ward"]: lambda x, a, ks: ward_cuts(x, ks), METHODS["spectral"]: lambda x, a, ks: spectral_cuts(a, ks)}
#: The same for methods that draw: they take a generator for all k.
DRAWN = {METHODS["leiden"]: lambda x, a, ks, rng: leiden_cuts(a, ks, rng)}


def silhouettes(x: Array, partitions: Sequence[Array], height: int = 1024, width: int = 2048) -> Array:
    """Mean silhouette of each partition of the same points, exact, Euclidean; 0 for a cluster of one.

    ``height`` x ``width`` distances exist at a time, taken once for all partitions; a partition's last cluster has what the others leave.
    """
    n = len(x)
    x = x - x.mean(0)
    norms = (x**2).sum(1)
    left, right = np.column_stack([x, norms, np.ones(n)]), np.column_stack([-2 * x, np.ones(n), norms])  # rows whose products are squared distances
    kinds = [np.unique(p, return_inverse=True, return_counts=True)[1:] for p in partitions]
    one = np.column_stack([np.ones(n, bool), *(which[:, None] == np.arange(len(sizes) - 1) for which, sizes in kinds)])
    out = np.zeros(len(kinds))
    for s in range(0, n, height):
        row = np.arange(min(height, n - s))
        total = np.zeros((len(row), one.shape[1]))
        for t in range(0, n, width):
            d = left[s : s + height] @ right[t : t + width].T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            same = np.arange(max(s, t), min(s + height, t + width, n))
            d[same - s, same - t] = 0
            total += d @ one[t : t + width].astype(float)
        at = 1
        for p, (which, sizes) in enumerate(kinds):
            first = total[:, at : at + len(sizes) - 1]
            at += len(sizes) - 1
            to = np.column_stack([first, total[:, 0] - first.sum(1)])
            part = which[s : s + height]
            own = sizes[part]
            a = to[row, part] / np.maximum(own - 1, 1)
            other = to / sizes
            other[row, part] = np.inf
            b = other.min(1)
            top = np.maximum(a, b)
            out[p] += np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0).sum()
    return out / n


def silhouette(x: Array, labels: Array) -> float:
    """``silhouettes`` of one partition."""
    return float(silhouettes(x, [labels])[0])


def feature_metrics(x: Array, labels: Array) -> dict[str, float | None]:
    """``feature_panel`` of one partition."""
    return feature_panel(x, [labels])[0]


def feature_panel(x: Array, partitions: Sequence[Array]) -> list[dict[str, float | None]]:
    """SW, CH, CH_n, DBI and S_Dbw of each partition of the same points; None unless it has more than one cluster and fewer than points."""
    proper = [1 < len(np.unique(p)) < len(x) for p in partitions]
    sw = iter(silhouettes(x, [p for p, whole in zip(partitions, proper, strict=True) if whole]) if any(proper) else ())
    return [_feature_metrics(x, p, float(next(sw))) if whole else dict.fromkeys(("SW", "CH", "CH_n", "DBI", "S_Dbw")) for p, whole in zip(partitions, proper, strict=True)]


def _feature_metrics(x: Array, labels: Array, sw: float) -> dict[str, float | None]:
    ids, which, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    k, n = len(ids), len(x)
    centres = np.stack([x[which == c].mean(0) for c in range(k)])
    off = x - centres[which]
    far = np.sqrt((off**2).sum(1))
    inside = (off**2).sum()
    between = (sizes[:, None] * (centres - x.mean(0)) ** 2).sum()
    ch = (between / (k - 1)) / (inside / (n - k)) if inside > 0 else None
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1))
    spread = np.array([far[which == c].mean() for c in range(k)])
    np.fill_diagonal(apart, np.inf)
    dbi = float(((spread[:, None] + spread) / np.where(apart > 0, apart, np.nan)).max(1).mean())
    lengths = np.array([np.linalg.norm(x[which == c].var(0)) for c in range(k)])
    radius = math.sqrt(lengths.sum()) / k
    within = lambda c, u: int((np.sqrt(((x[which == c] - u) ** 2).sum(1)) <= radius).sum())
    dense = 0.0
    for a in range(k):
        for b in range(a):
            middle, at_a, at_b = (within(a, u) + within(b, u) for u in ((centres[a] + centres[b]) / 2, centres[a], centres[b]))
            dense += middle / max(at_a, at_b) if max(at_a, at_b) else 0.0
    scatter = float(lengths.mean() / np.linalg.norm(x.var(0)))
    out = {"SW": sw, "CH": ch, "CH_n": None if ch is None else ch / n, "DBI": dbi, "S_Dbw": scatter + 2 * dense / (k * (k - 1))}
    return {m: None if v is None or not math.isfinite(v) else float(v) for m, v in out.items()}


def graph_metrics(i: Array, j: Array, w: Array, labels: Array) -> dict[str, float]:
    """AVI, AVU, ANUI and Q of one partition; i and j are places in ``labels``."""
    ids, which = np.unique(labels, return_inverse=True)
    k = len(ids)
    s = np.bincount(which[i] * k + which[j], w, k * k).reshape(k, k)
    s = s + s.T
    inner, row = np.diag(s), s.sum(1)
    out = row - inner
    m2 = row.sum()
    safe = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
    avi = float(safe(inner, row).mean())
    low = out[:, None] + out - s
    pairs = safe(s, low)
    avu = float((pairs.sum() - np.trace(pairs)) / k) if k > 1 else 0.0
    q = float((inner / m2 - (row / m2) ** 2).sum()) if m2 > 0 else 0.0
    return {"AVI": avi, "AVU": avu, "ANUI": 1 / (avu + 1 / avi) if avi > 0 else 0.0, "Q": q}


def adjusted_rand(a: Array, b: Array) -> float:
    """Agreement of two partitions, corrected for chance."""
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    n = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(n, (x, y), 1)
    two = lambda v: (v * (v - 1) / 2).sum()
    both, rows, cols, all_pairs = two(n), two(n.sum(1)), two(n.sum(0)), len(x) * (len(x) - 1) / 2
    expected = rows * cols / all_pairs if all_pairs else 0
    most = (rows + cols) / 2
    return 1.0 if most == expected else float((both - expected) / (most - expected))
