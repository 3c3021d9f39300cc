"""Near duplicates, repeated passages, mixing, neighbours, archives, quality: against brute force on small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netpanel.llm import ann, components, mixing, near, quality, shared, simhash, substrings, warc
from tests.llm.fixtures import documents, empty


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return [] if not words else [b" ".join(words)] if len(words) < n else [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


def simhash_of(text, n=3):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [False, True])
def test_simhash_groups(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_HOMES", 1)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {t: simhash_of(t) for _, t in rows}
    keys = sorted({p for p in prints.values()})
    root = roots(keys, [(a, b) for a in keys for b in keys if a < b and bin(a ^ b).count("1") <= 2])
    lowest = {}
    for d, t in rows:
        if d is not None:
            lowest[root[prints[t]]] = min(lowest.get(root[prints[t]], d), d)
    want = sorted((d is None, d or 0, f"{prints[t]:016x}", lowest.get(root[prints[t]], -1)) for d, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.grouped(docs).collect())
    assert got == want
    assert simhash.grouped(empty(spark)).count() == 0


@pytest.mark.parametrize("small,hot", [(24, 2000), (1, 2000), (24, 1)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, small, hot):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "HOT_HOMES", hot)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)] + [0]
    prints = set(base)
    for b in base:
        for _ in range(25):
            prints.add(b ^ sum(1 << r.randrange(64) for _ in range(r.randint(1, 4))) & (1 << 64) - 1)
    table = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long")
    found = [(x.a, x.b) for x in simhash.links(table, 2).collect()]
    signed = sorted(simhash.signed(p) for p in prints)
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    assert roots(signed, found) == want


def test_every_near_pattern_shares_an_anchor():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 300).astype(np.uint64)
    flips = [np.uint64(1) << np.uint64(b) for b in range(64)]
    for _ in range(20):
        y = x ^ flips[r.integers(64)] ^ flips[r.integers(64)]
        own = {h: a for h, _, a, home in simhash.anchors(x, 0) if home}
        met = np.zeros(len(x), bool)
        for half, rows, anchor, _ in simhash.anchors(y, 1):
            met[rows[anchor == own[half][rows]]] = True
        assert met.all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: r for n, r in roots({n for ab in links for n in ab}, links).items() if n != r}
    assert got == want


@pytest.mark.parametrize("share", [1e-3, 1e-9])
def test_lookup_survives_hot_keys(spark, monkeypatch, share):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_SHARE", share)
    for kind in ("long", "string"):
        left = spark.createDataFrame([(None if k % 11 == 0 else 1 if k % 3 else k, k) for k in range(200)], "k long, v long").withColumn("k", F.col("k").cast(kind))
        right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
        want = {r.v: r.top for r in left.join(right, "k", "left").collect()}
        got = shared.lookup(left, right, "k", "n", 200)
        assert got.columns == ["k", "v", "top"] and {r.v: r.top for r in got.collect()} == want


def test_near_duplicates_keep_the_first_of_each_group(spark):
    docs = documents(spark, seed=2, n=90)
    rows = [(r.doc_id if r.doc_id is not None else near.LAST, r.text or "") for r in docs.collect()]
    sets = {t: set(shingles(t, 5)) for _, t in rows}
    keys = sorted(sets)
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])  # noqa: E731; texts without words are alike
    root = roots(keys, [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if alike(a, b)])
    first = {}
    for d, t in sorted(rows):
        first.setdefault(root[t], d)
    got = near.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(near.LAST if r.doc_id is None else r.doc_id for r in got.collect()) == sorted(first.values())
    assert near.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("small, block", [(1, 1000), (2, 3)])
def test_near_copies_meet_in_large_buckets(spark, monkeypatch, small, block):
    """A family that shares boilerplate, with near copies in it that are like no leader: as brute force links them."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK_ROWS", block)
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common = word(804)
    texts = []
    for k in range(24):
        own = word(125)
        texts.append(common + own)
        if k % 2:
            texts.append(common + own[:30] + word(95))
    texts = [" ".join(t) for t in texts]
    rows = list(enumerate(texts))
    sets = [set(shingles(t, 5)) for t in texts]
    like = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(like) == 12
    group = roots(range(len(texts)), like)
    want = sorted({min(j for j in group if group[j] == group[i]) for i in group})
    got = near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want


def removed(rows, length):
    """By brute force: (words, removed, kept) of (id, text) in order."""
    seen, out = set(), {}
    for key, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            window = tuple(words[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot,length", [(2000, 20), (1, 20), (2000, 9)])
def test_repeated_passages(spark, monkeypatch, hot, length):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = documents(spark)
    rows = sorted({(substrings.LAST if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()}, key=lambda x: x[0])
    want = removed(rows, length)
    got = substrings.deduplicated(docs, length, keep_text=True).collect()
    assert len(got) == docs.count()
    for r in got:
        n, m, kept = want[substrings.LAST if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, m, hashlib.sha256(kept).hexdigest())
        assert r.kept.encode() == kept if m else r.kept == (dict(rows)[substrings.LAST if r.doc_id is None else r.doc_id] or "")
    assert sum(m for _, m, _ in want.values()) > 100
    assert substrings.deduplicated(empty(spark), length).count() == 0


def test_windows_through_the_index():
    r = random.Random(7)
    for _ in range(30):
        stretches = [[r.choice((b"a", b"b", b"cc")) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 8))]
        seen, want = set(), []
        for s in stretches:
            flags = []
            for k in range(max(0, len(s) - 5 + 1)):
                w = tuple(s[k : k + 5])
                flags.append(w in seen)
                seen.add(w)
            want.append(flags)
        assert [a.tolist() for a in substrings.repeated(stretches, 5)] == want


def schedule(parts):
    """One round of earliest deadlines first among released blocks, step by step."""
    total, done, out = sum(parts), [0] * len(parts), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // a), i) for i, a in enumerate(parts) if done[i] < a and done[i] * total // a <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


def mixed_by_hand(rows, parts, block):
    order = {}
    for d, t, s in rows:
        order.setdefault(s, []).append((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), d or 0, d, max(1, len(t or ""))))
    keys = sorted(order, key=lambda s: "-" if s is None else "+" + s)
    blocks, ends = {}, {}
    for s in keys:
        at = 0
        for _, _, d, n in sorted(order[s]):
            blocks.setdefault(d, []).append((s, at // block))
            at += n
        ends[s] = -(-((at - 1) // block + 1) // parts.get(s, 1))
    out, base = {}, 0
    for r in range(max(ends.values())):
        active = [s for s in keys if ends[s] > r]
        own = [parts.get(s, 1) for s in active]
        count = dict.fromkeys(active, 0)
        for t, i in enumerate(schedule(own)):
            s = active[i]
            out[s, r * parts.get(s, 1) + count[s]] = base + t
            count[s] += 1
        base += sum(own)
    return blocks, out


def test_mixing_against_a_simulation(spark):
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    parts = {"hot": 4, "s0": 2}
    got = mixing.interleave(docs, parts, block_chars=100)
    assert got.columns == [c for c in docs.columns if c != "slot"] + ["block", "round", "slot", "rank"]
    blocks, slots = mixed_by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()], parts, 100)
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.source, r.block) in blocks[r.doc_id] and slots[r.source, r.block] == r.slot, r.doc_id
    assert mixing.interleave(empty(spark)).count() == 0
    assert mixing.in_order(got, 2).count() == docs.count()


def test_shares_stay_within_a_block():
    for parts in ([4, 2, 3, 2, 1, 1, 1], [1, 1, 1], [7, 3], [16, 1, 1, 1, 1, 1]):
        done = [0] * len(parts)
        for t, i in enumerate(schedule(parts), 1):
            done[i] += 1
            assert all(abs(n - t * a / sum(parts)) < 1 for n, a in zip(done, parts, strict=True))


def test_mixing_rejects_bad_weights(spark):
    with pytest.raises(ValueError):
        mixing.interleave(empty(spark), {"a": 0})


def vectors_table(spark, n=700, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 16)) + 3 * r.normal(size=(8, 16))[r.integers(0, 8, n)]
    rows = [(k, [float(v) for v in row], 1) for k, row in enumerate(x.astype("float32"))]
    rows[5] = (5, rows[105][1], 1)
    rows += [(n, None, 0), (n + 100, [0.0] * 16, 0), (n + 1, [float("nan")] * 16, 0), (n + 2, [1.0] * 3, 0), (None, [1.0] * 16, 0), (n + 3, [1.0, None] * 8, 0), (n + 4, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    table = vectors_table(spark)
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.collect() if r.vec_id is not None and r.vec_id < 700}
    got = {}
    for r in ann.search(table, 10, 25).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {k for k in rows if k % 25 == 0}
    hits = 0
    for q, found in got.items():
        true = sorted((np.sqrt(((rows[q] - v) ** 2).sum()), k) for k, v in rows.items() if k != q)
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(abs(s - np.sqrt(((rows[q] - rows[k]) ** 2).sum())) < 1e-12 for k, s in found)
        hits += len({k for _, k in true[:10]} & {k for k, _ in found})
    assert hits >= 0.9 * 10 * len(got)


def test_neighbours_far_from_the_origin_and_repeated(spark):
    """Large norms with small differences, rows that share an id (equal or not), and ties."""
    r = np.random.default_rng(5)
    x = 1e6 + r.integers(0, 3, size=(300, 4)) * 1e-3
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)]
    rows += [rows[100], rows[100], rows[7], (7, [1e6 + 0.5] * 4), (200, rows[3][1])]
    vectors = {}
    for k, v in rows:
        vectors.setdefault(k, []).append(np.array(v))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for f in ann.search(table, 10, 100, parts=1).orderBy("query_id", "rank").collect():
        got.setdefault(f.query_id, []).append((f.vec_id, f.score))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        true = sorted((min(np.sqrt(((a - b) ** 2).sum()) for a in vectors[q] for b in vs), k) for k, vs in vectors.items() if k != q)[:10]
        assert [(k, s) for s, k in true] == found


def test_neighbours_of_few_or_no_vectors(spark):
    few = vectors_table(spark).filter("vec_id in (100, 3, 4, 5)")
    assert sorted((r.query_id, r.rank) for r in ann.search(few).collect()) == [(100, 1), (100, 2), (100, 3)]
    assert ann.search(few.limit(0)).count() == 0
    assert ann.search(vectors_table(spark).filter("vec_id >= 700")).count() >= 0


def test_archives(spark):
    pages = [(k, f"http://a/{k} x", None if k % 9 == 0 else "" if k % 10 == 0 else "hot page" if k % 3 == 0 else f"<p>{k % 7} é") for k in range(80)] + [(None, None, "alone"), (None, "u", "hot page"), (33, "again", "other")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(table, shared.scratch(spark, "t"))
    got = warc.read_archives(index, keep_html=True).collect()
    assert len(got) == len(pages) and index.count() == len(pages)
    top = {}
    for k, _, h in pages:
        if k is not None:
            top[h or ""] = max(top.get(h or "", -1), k)
    left = sorted((k is None, k or 0, (h or "").encode()) for k, _, h in pages)
    for r in got:
        same = [h for k, _, h in pages if k == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest]
        assert same, r
        data = (same[0] or "").encode()
        left.remove((r.page_id is None, r.page_id or 0, data))
        assert r.payload_bytes == len(data)
        original = r.page_id is None or top[same[0] or ""] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if original else ("revisit", top[same[0] or ""]))
        assert r.html == (same[0] or "" if original else None)
    assert not left
    chosen = warc.read_archives(index.filter("page_id in (5, 70)")).collect()
    assert sorted(r.page_id for r in chosen) == [5, 70]
    assert warc.read_archives(warc.write_archives(table.limit(0), shared.scratch(spark, "t"))).count() == 0


def test_quality(spark, sf_dir):
    docs, labels = shared.table(spark, "/root/testdata/sf0.01", "documents"), shared.table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, labels)
    rows = quality.scored(docs.withColumn("score", F.lit("clash")), model).join(labels, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    again = quality.train(docs, labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert [t.tolist() for t in again.tables] == [t.tolist() for t in model.tables]  # held-out labels change nothing


def test_quality_without_labels_and_of_odd_texts(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    scores = {r.score for r in quality.scored(docs, quality.train(docs, none)).collect()}
    assert scores == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(0, 200)] + [(None, 0), (4, None)], "doc_id long, quality int")
    scores = [r.score for r in quality.scored(docs, quality.train(docs, one)).collect()]
    assert len(scores) == docs.count() and all(0.5 < s < 1 for s in scores)
    assert quality.scored(empty(spark), quality.train(empty(spark), one)).count() == 0


def test_interaction_is_learned():
    r = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :4] = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def family(seed, variants):
    """Variants of one text, each with a copy of its own."""
    r = random.Random(seed)
    base, texts = [f"w{r.randrange(10**6)}" for _ in range(300)], []
    for _ in range(variants):
        a = list(base)
        for k in r.sample(range(300), 4):
            a[k] = f"x{r.randrange(10**6)}"
        b = list(a)
        for k in r.sample(range(300), 3):
            b[k] = f"y{r.randrange(10**6)}"
        texts += [" ".join(a), " ".join(b)]
    return texts


def test_near_duplicates_of_a_template_family(spark):
    texts = family(1, 150)
    sets = [set(shingles(t, 5)) for t in texts]
    like = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = roots(range(len(texts)), like)
    got = near.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(group.values()))


def test_different_texts_with_one_hash(spark, monkeypatch):
    monkeypatch.setattr(near, "_hash", lambda text: F.length(text).cast("long") % 2)
    texts = [" ".join(f"{k}w{n}" for n in range(30 + k % 2)) for k in range(10)] + ["", None]
    got = near.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(11))


def plain_tree(g, h, n):
    """The best cut of any leaf, found anew each time from the rows themselves."""
    value = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + quality.SHRINK)
    leaves = [(0, len(g))]
    while len(leaves) < quality.LEAVES:
        cuts = [(value(a, m) + value(m, b) - value(a, b), a, m, b) for a, b in leaves for m in range(a + 1, b) if min(sum(n[a:m]), sum(n[m:b])) >= quality.LEAST_ROWS]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, a, m, b = max(cuts)
        leaves.remove((a, b))
        leaves += [(a, m), (m, b)]
    return [next(sum(g[a:b]) / (sum(h[a:b]) + quality.SHRINK) for a, b in leaves if a <= i < b) for i in range(len(g))]


def plain_quadrants(g, h, n):
    best = (-1.0, None)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            fine = [p for p in parts if n[p].sum() >= quality.LEAST_ROWS]
            gain = sum(g[p].sum() ** 2 / (h[p].sum() + quality.SHRINK) for p in fine)
            if gain > best[0]:
                out = np.zeros_like(g)
                for p in fine:
                    out[p] = g[p].sum() / (h[p].sum() + quality.SHRINK)
                best = (gain, out)
    return best


def test_cuts_against_exhaustive_search():
    r = np.random.default_rng(9)
    for bins in (2, 5, 17):
        for _ in range(20):
            n = r.integers(0, 4 * quality.LEAST_ROWS, bins)
            g, h = r.normal(size=bins) * n, r.random(bins) * n + 0.1
            assert np.allclose(quality._tree(g, h, n), plain_tree(g.tolist(), h.tolist(), n.tolist()))
            n = r.integers(0, 2 * quality.LEAST_ROWS, (bins, bins + 1)).astype(float)
            g, h = r.normal(size=n.shape) * n, r.random(n.shape) * n + 0.1
            gain, out = quality._quadrants(g, h, n)
            want, cells = plain_quadrants(g, h, n)
            assert np.isclose(gain, want) and np.allclose(out, cells)


def test_scores_are_sums_of_table_entries():
    """Vectorised bins against a look-up row by row."""
    r = np.random.default_rng(1)
    x = r.normal(size=(600, len(quality.FEATURES)))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[sum(e <= row[i] for e in model.pair_edges[i]), sum(e <= row[j] for e in model.pair_edges[j])]
        assert np.isclose(score, 1 / (1 + np.exp(-total)))


def test_training_takes_one_row_of_each_document(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3 * k + 1, k % 2) for k in range(60)], "doc_id long, quality int")
    twice = docs.unionByName(docs).repartition(5)
    a, b = quality.train(docs, labels), quality.train(twice, labels)
    assert [t.tolist() for t in a.tables] == [t.tolist() for t in b.tables] and a.intercept == b.intercept


def test_mixing_of_many_rows_without_an_id(spark, monkeypatch):
    """They lie in many buckets, in the order of their texts' hashes, between the ids whose md5 is smaller and larger."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = [(None, f"text {k}", "hot") for k in range(150)] + [(k, f"with id {k}", "hot") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.interleave(docs, block_chars=40).withColumn("h", F.xxhash64("text")).orderBy("slot", "rank").collect()
    md5 = lambda d: hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
    want = sorted(got, key=lambda r: (md5(r.doc_id), r.doc_id or 0, r.h))
    assert len(got) == 300 and [r.text for r in got] == [r.text for r in want]


@pytest.mark.parametrize("entries", [0, 1 << 16])
def test_mixing_of_many_sources(spark, monkeypatch, entries):
    """Thousands of sources, hot ones among them, in the order that a simulation gives; places dealt to several tasks."""
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(mixing, "PLACE_ROWS", 20)
    rows = [(k, "x" * (k % 13), "hot" if k % 3 == 0 else "warm" if k % 7 == 0 else f"site{k % 701}") for k in range(4000)]
    parts = {"hot": 40, "warm": 9, "site1": 4}
    got = mixing.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), parts, block_chars=10).collect()
    blocks, slots = mixed_by_hand(rows, parts, 10)
    assert len(got) == len(rows)
    assert all((r.source, r.block) in blocks[r.doc_id] and slots[r.source, r.block] == r.slot for r in got)


def test_mixing_of_sources_beyond_thousands(spark):
    """Every source's first block lies in the first round."""
    docs = spark.range(30_000).selectExpr("id doc_id", "'text' text", "concat('host', id % 10000) source")
    got = mixing.interleave(docs, block_chars=65536).agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).first()
    assert (got.n, got.slots, got.last) == (30_000, 10_000, 9_999)
