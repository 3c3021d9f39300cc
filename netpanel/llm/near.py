"""Near duplicates by SimHash with a similarity that is checked: groups of texts whose shingle sets are alike.

A 64-bit SimHash of a whole text tells small edits, but at a Jaccard similarity of 0.8 of word shingles it differs
in 5 to 14 bits, beyond the reach of any covering code that still divides the fingerprints. So a text
has, besides the SimHash of all its shingles (linked through the anchors of ``simhash.links``, up to 3 bits),
SAMPLES more, each of the SAMPLE shingles with the smallest values under a hash of its own. Two texts
agree on one of those with about similarity^SAMPLE chance, so at 0.8 a pair misses all of them with a chance
of (1 - 0.8^3)^16 < 0.00002. All of this only proposes pairs: a pair counts if the Jaccard similarity of
its whole shingle sets, found exactly, is at least the one asked for.

Texts meet in buckets: those with a sample's fingerprint in common, and those whose whole fingerprints the anchors' links connect (a link
stands for all texts of its fingerprints, and for all that the chain of links reaches). In a bucket of up to SMALL texts all are paired. In a larger one each is first paired with two:
the text of the smallest doc_id, and the most central one, whose buckets have the most members in all; the text
that others are copies of shares fingerprints with all of them, while two copies share fewer. Then all pairs of the
bucket that these links leave in different groups are compared too, in blocks: texts outside the bucket's largest group
meet one another and that group. Texts whose numbers of shingles differ too much for the similarity asked for do not meet.
Equal texts are one before that. Verified pairs are the links of the groups.

Nulls, empties, repeats: a null text is an empty one, and empty texts are equal texts. Texts with fewer words
than a shingle have their whole sequence as one. Words are lower-cased in A-Z, as for the fingerprints. A null
doc_id counts as larger than all others. Texts are told apart by 128 bits: where different texts share the 64-bit hash that
stands for a text (some do among 10^10 texts), all but one of them get another. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpanel.llm import components, shared, simhash

SAMPLES, SAMPLE = 16, 3
#: Whole-text fingerprints link up to so many bits.
BITS = 3
#: Buckets of up to so many texts have all their pairs compared.
SMALL = 8
#: Rows of a leader's members beyond which they are dealt to several tasks.
LEADER_ROWS = 200
#: Texts, and their shingles, of a block that large buckets are compared in, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 500_000
LAST = (1 << 63) - 1

_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1) for k in range(1, SAMPLES + 1)]
_PLUS = [np.uint64(0xD1B54A32D192ED03 * (k + 1) & (1 << 64) - 1) for k in range(SAMPLES)]


def sample_prints(shingles: np.ndarray) -> list[int]:
    """A SimHash of each consistent sample of the distinct shingle hashes, marked by the sample's number."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            order = (shingles ^ _PLUS[k]) * _ODD[k]
            order ^= order >> np.uint64(32)
            if len(shingles) > SAMPLE:
                chosen = shingles[np.argpartition(order, SAMPLE - 1)[:SAMPLE]]
            else:
                chosen = shingles
            a, b, c = (chosen[min(i, len(chosen) - 1)] for i in range(3))
            vote = a & b | a & c | b & c  # the bits set in over half of three
            out.append(int((vote ^ _PLUS[k]) * _ODD[k]))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """_id, _node (the text's hash), text, and _row: all columns as one, whose names meet no inner ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), _hash(text).alias("_node"), text.alias("text"), F.struct(*docs.columns).alias("_row"))


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _told_apart(docs: DataFrame) -> DataFrame:
    """``_rows``, with a node of its own for every text: of those that share a hash, the smallest md5 keeps it."""
    rows = _rows(docs)
    md5 = F.md5("text")
    shared_by = rows.groupBy("_node").agg(F.min(md5).alias("least"), F.max(md5).alias("most")).filter("least != most").select("_node", "least").collect()
    if not shared_by:  # of n texts about n^2 / 2^65 hashes are shared: a handful at any size
        return rows
    keeps = F.create_map(*[F.lit(v) for r in shared_by for v in (r["_node"], r["least"])])
    return rows.withColumn("_node", F.when(md5 != keeps[F.col("_node")], F.xxhash64(F.lit("again"), md5)).otherwise(F.col("_node")))


def groups(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root): the texts (_id, _node, text) that are linked to others, and the smallest node of their group."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            whole: list[tuple[int, int, int, int]] = []
            samples: list[tuple[int, int, int, int]] = []
            for i, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node in seen:  # a batch finds the fingerprints of equal texts once
                    whole.append((i, node, None, None))
                    continue
                seen.add(node)
                hashes = simhash.shingle_hashes(text, words)
                own = np.unique(hashes)
                whole.append((i, node, simhash.signed(simhash.majority(hashes)), len(own)))
                if len(hashes):
                    samples += [(i, node, simhash.signed(p), None) for p in sample_prints(own)]
            for kind, found in ((0, whole), (1, samples)):
                columns = zip(*found, strict=True) if found else ((), (), (), ())
                arrays = [pa.array(c, pa.int64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int32()), *arrays], names=["kind", "_id", "_node", "print", "shingles"])

    shared.bound_batches(texts)
    rows = texts.select("_id", "_node", "text")
    found = shared.written(rows.mapInArrow(prints, "kind int, _id long, _node long, print long, shingles long"), "near-prints")
    total = found.filter("kind = 0").count()
    nodes = shared.written(found.filter("kind = 0").groupBy("_node").agg(F.min("_id").alias("_id"), F.max("print").alias("print"), F.max("shingles").alias("shingles")), "near-nodes", rows=total)

    # buckets of equal samples, and of linked whole fingerprints, that have several texts
    whole = nodes.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    near = shared.written(components.components(simhash.links(whole.select("print"), BITS)), "near-linked", rows=total)
    linked = shared.written(near.join(whole, F.col("node") == F.col("print")).select("print", "root", "n"), "near-prints-of", rows=total)
    placed = shared.lookup(nodes.select("_node", "print", "_id"), linked, "print", "n", total)
    samples = found.filter("kind = 1").groupBy("_node", F.col("print").alias("key")).agg(F.min("_id").alias("_id"))
    keys = shared.written(samples.unionByName(placed.select("_node", F.coalesce("root", "print").alias("key"), "_id")), "near-keys", rows=17 * total)
    sizes = shared.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("size", F.col("n")), "near-sizes", rows=4 * total)
    hit = shared.written(shared.lookup(keys, sizes, "key", "n", keys.count()).filter("size is not null"), "near-members", rows=8 * total)
    central = hit.groupBy("_node").agg(F.sum("size").alias("score"))
    members = shared.written(hit.join(central, "_node"), "near-scored", rows=8 * total)
    leaders = members.filter(F.col("size") > SMALL).groupBy("key").agg(F.min(F.struct("_id", "_node")).alias("first"), F.max(F.struct(F.col("score"), (-F.col("_id")).alias("i"), F.col("_node"))).alias("central"), F.count(F.lit(1)).alias("n"))
    leaders = shared.written(leaders.select("key", F.array("first._node", "central._node").alias("leaders"), "n"), "near-leaders-of", rows=total)
    large = shared.lookup(members.filter(F.col("size") > SMALL), leaders, "key", "n", members.count())
    stars = large.select(F.explode("leaders").alias("leader"), F.col("_node").alias("member")).filter("leader != member")
    few = members.filter(F.col("size") <= SMALL).select("key", "_id", "_node")
    others = few.select("key", F.col("_id").alias("_id2"), F.col("_node").alias("member"))
    every = few.join(others, "key").filter("_id < _id2 or (_id = _id2 and _node < member)").select(F.col("_node").alias("leader"), "member")
    stars = stars.unionByName(every)
    pairs = shared.written(stars.distinct(), "near-pairs", rows=4 * total)
    shared.drop(found, near, linked, keys, sizes, hit, leaders)
    verified, many = _verified(texts, nodes, pairs, words, similarity)
    verified = shared.written(verified.select(F.col("leader").alias("a"), F.col("member").alias("b")), "near-verified")
    shared.drop(pairs, many)
    first = shared.written(components.components(verified), "near-first", rows=total)
    rest, scratch = _rest(texts, nodes, members.filter(F.col("size") > SMALL).select("key", "_node"), first, words, similarity)
    out = components.components(verified.unionByName(rest))
    shared.drop(nodes, members, verified, first, *scratch)
    return out


def _rest(rows: DataFrame, nodes: DataFrame, members: DataFrame, first: DataFrame, words: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that connect what all similar pairs within buckets (key, _node) connect and ``first`` (node, root) does not.

    Of each bucket the texts outside its largest group (strays) are dealt to blocks, and each block meets the bucket's
    other blocks whose texts are about as long. Also returns tables to drop when the links have been read.
    """
    base = max(1 / similarity, 1.25) * 1.001  # similar texts are at most a class apart, however logarithms are rounded
    groups = members.join(first.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    groups = groups.join(nodes.select("_node", "shingles"), "_node")
    groups = groups.withColumn("band", F.floor(F.log(F.greatest("shingles", F.lit(1))) / math.log(base)).cast("int"))
    groups = shared.written(groups, "near-large", rows=4 * nodes.count())
    largest = groups.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    largest = shared.written(largest.filter("n > most.n").select("key", F.col("most.root").alias("most"), "n"), "near-largest", rows=nodes.count())
    if not largest.count():
        return first.select(F.col("node").alias("a"), F.col("root").alias("b")).limit(0), [groups, largest]
    open_ = shared.lookup(groups, largest, "key", "n", groups.count()).filter("most is not null").withColumn("stray", F.col("root") != F.col("most"))
    open_ = shared.written(open_.select("key", "_node", "root", "band", "stray", "shingles"), "near-open", rows=groups.count())
    place = ["key", "band", "stray"]
    dealt = open_.groupBy(*place).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("shingles") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    dealt = dealt.withColumn("at", F.xxhash64(*place))
    dealt = shared.written(dealt, "near-dealt", rows=open_.count())
    block = dealt.select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own, other = (block.select("key", F.struct("band", "block").alias(f"{s}_place"), F.col("stray").alias(f"{s}_stray")) for s in ("own", "other"))
    meet = own.filter("own_stray").join(other, "key").filter("abs(own_place.band - other_place.band) <= 1 and (not other_stray or other_place >= own_place)")
    meet = meet.withColumn("itself", F.col("other_stray") & (F.col("own_place") == F.col("other_place")))
    # a mixed number may meet another one's: that costs comparisons, never a link
    meet = shared.written(meet.withColumn("task", F.xxhash64("key", "own_place", "other_place", "other_stray")), "near-meet", rows=dealt.count())
    side = lambda s, role: meet.select(F.xxhash64("key", f"{s}_place.band", f"{s}_stray", f"{s}_place.block").alias("at"), F.struct("task", F.lit(role).alias("role"), "itself").alias("to"))
    tasks = side("own", 0).unionByName(side("other", 1).filter("not to.itself")).groupBy("at").agg(F.collect_list("to").alias("to"))
    placed = shared.lookup(open_.withColumn("at", F.xxhash64(*place)), dealt.select("at", "blocks", "n"), "at", "n", open_.count())
    placed = placed.withColumn("block", F.pmod(F.xxhash64("_node", "key"), "blocks").cast("int")).withColumn("at", F.xxhash64(*place, "block"))
    need = placed.join(tasks, "at").select("_node", "root", F.explode("to").alias("to")).select("_node", "root", "to.*")
    need = need.join(nodes.select("_node", "_id"), "_node")
    texts = need.join(rows.select("_id", "_node", "text"), ["_id", "_node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block()

        def made(found: list[tuple[int, int]]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        for batch in batches:
            out = []
            for node, root, task, role, itself, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != now:
                    out += block.inner(similarity)
                    now, block = task, _Block()
                shingles = np.unique(simhash.shingle_hashes(text, words))
                if role == 0:
                    block.add(node, root, shingles, itself)
                else:
                    out += block.links(node, root, shingles, similarity)
            yield made(out)
        yield made(block.inner(similarity))

    met = texts.select("_node", "root", "task", "role", "itself", "text").repartition("task").sortWithinPartitions("task", "role")
    return met.mapInArrow(compare, "a long, b long"), [groups, largest, open_, dealt, meet]


class _Block:
    """Texts whose shingle sets are compared with others at once."""

    def __init__(self) -> None:
        self.nodes, self.roots, self.sets, self.itself, self.words = [], [], [], False, None

    def add(self, node: int, root: int, shingles: np.ndarray, itself: bool) -> None:
        self.nodes.append(node)
        self.roots.append(root)
        self.sets.append(shingles)
        self.itself = itself

    def _index(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.words, self.at = np.unique(np.concatenate([np.empty(0, np.uint64), *self.sets]), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.roots = np.array(self.roots, np.int64)

    def links(self, node: int, root: int, shingles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
        """A link to one text of each other group that has a similar one; those groups are the root's from then on."""
        if self.words is None:
            self._index()
        mark = np.zeros(len(self.words), np.int32)
        mark[np.searchsorted(self.words, shingles[np.isin(shingles, self.words, assume_unique=True)])] = 1
        sums = np.concatenate([[0], np.cumsum(mark[self.at])])
        both = sums[self.ends] - sums[self.ends - self.sizes]
        hit = np.flatnonzero((both >= similarity * (self.sizes + len(shingles) - both)) & (self.roots != root))
        if not len(hit):
            return []
        others, first = np.unique(self.roots[hit], return_index=True)
        self.roots[np.isin(self.roots, others)] = root
        return [(node, self.nodes[i]) for i in hit[first]]

    def inner(self, similarity: float) -> list[tuple[int, int]]:
        """The links within a block that meets itself."""
        if not self.itself:
            return []
        if self.words is None:
            self._index()
        return [p for i, s in enumerate(self.sets) for p in self.links(self.nodes[i], int(self.roots[i]), s, similarity)]


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (leader, member) whose shingle sets are at least so similar.

    A leader's text and its members' meet in sorted order, the leader's first; a leader with many members is
    copied to as many tasks as they need. Also returns a table to drop when the pairs have been read.
    """
    counts = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    many = counts.filter(F.col("n") > LEADER_ROWS).select("leader", "n", F.ceil(F.col("n") / LEADER_ROWS).cast("int").alias("salts"))
    total = pairs.count()
    many = shared.written(many, "near-leaders", rows=total)
    salted = shared.lookup(pairs, many, "leader", "n", total)
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int"))
    leads = counts.join(many.select("leader", "salts"), "leader", "left")
    leads = leads.select("leader", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    need = leads.select(F.col("leader").alias("_node"), "leader", "salt", F.lit(0).alias("role"))
    need = need.unionByName(salted.select(F.col("member").alias("_node"), "leader", "salt", F.lit(1).alias("role")))
    # the row of the smallest doc_id gives a node's text; the other rows of equal texts need not match
    need = need.join(nodes.select("_node", "_id"), "_node")
    texts = need.join(rows.select("_id", "_node", "text"), ["_id", "_node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for node, leader, salt, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shingles = np.unique(simhash.shingle_hashes(text, words))
                if role == 0:
                    lead, own = (leader, salt), shingles
                    continue
                if lead != (leader, salt):
                    raise RuntimeError("a leader's text is missing")
                small, large = sorted((len(own), len(shingles)))
                if small < similarity * large:
                    continue
                both = len(np.intersect1d(own, shingles, assume_unique=True))
                if both >= similarity * (small + large - both):
                    out.append((leader, node))
            columns = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leader", "member"])

    met = texts.select("_node", "leader", "salt", "role", "text").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role")
    return met.mapInArrow(compare, "leader long, member long"), many


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of equal or near-equal texts the row with the smallest doc_id; all columns of ``docs``."""
    texts = _told_apart(docs)
    rows = texts.drop("text")
    nodes = rows.groupBy("_node").agg(F.min("_id").alias("_id"))
    roots = shared.written(groups(texts, words, similarity), "near-roots", rows=docs.count())
    rooted = nodes.join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    keepers = rooted.groupBy("root").agg(F.min(F.struct("_id", "_node")).alias("k")).select("k._id", "k._node")
    return rows.join(keepers, ["_id", "_node"]).dropDuplicates(["_id", "_node"]).select("_row.*")
