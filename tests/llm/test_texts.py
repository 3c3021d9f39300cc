"""Fingerprints, records, packing, pieces: against brute force and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netpanel.llm import fingerprints, packing, records, shared, tokens, wordpieces
from tests.llm.fixtures import documents, empty, texts

WORDS = tokens.vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


ODD = ["", "A  b\tc d É İ ΣΑΣ á <|startoftext|>x<|endoftext|> ﬁ µm ªº ß 'S don'T x'S1,2 ½ " + "y" * 200, "\x1cfoo\x85bar z", "THERE'S!! ther*** a,%%% e.g.,", "Ärger, ÖL?! 日本語。 ok", "a\r\nb\x0bc\x0cd"]


def test_ids_equal_the_library(library):
    enc = tokens.Encoder(WORDS)
    assert enc.by_chunk and enc.model is not None
    cases = [t or "" for t in texts()] + ODD
    for text, raw in zip(cases, enc.encode(cases), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_with_a_tiny_cache(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 7)
    enc = tokens.Encoder(WORDS)
    for text in ODD:
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_that_joins_across_space_encodes_whole_texts():
    enc = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    assert not enc.by_chunk
    assert np.frombuffer(enc.encode(["two  words here"])[0], enc.dtype).tolist() == lib.encode("two  words here", add_special_tokens=False).ids


def expected_ids(library, rows):
    return [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]


def test_records_round_trip(spark, library):
    docs = documents(spark)
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    manifest = records.write_records(docs, shared.scratch(spark, "t"), WORDS, 1)
    found = sorted(records.scan_records(manifest).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, ids) in zip(found, expected_ids(library, rows), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_of_an_empty_table(spark):
    assert records.scan_records(records.write_records(empty(spark), shared.scratch(spark, "t"), WORDS, 1)).count() == 0


def test_shuffled_reads_and_damage(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    rows = [(k, np.arange(k, dtype="<u2").tobytes()) for k in range(50)]
    records.write_shard(local, f"{tmp_path}/s", "a", iter(rows), 2)
    got = dict(records.read_records(local, f"{tmp_path}/s", np.array([40, 3, 17, 3])))
    assert sorted(got) == [3, 17, 40] and all(v.tolist() == list(range(k)) for k, v in got.items())
    data = bytearray((tmp_path / "s.rec").read_bytes())
    data[-6] ^= 1
    (tmp_path / "s.rec").write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(records.read_records(local, f"{tmp_path}/s"))


def test_packing_places_each_id_once(spark, library):
    docs = documents(spark)
    pieces = packing.pack_documents(docs, WORDS, 1).toPandas()
    ids = {}
    for d, i in expected_ids(library, [(r.doc_id, r.text) for r in docs.collect()]):
        ids.setdefault(d if d is not None else -1, []).append(i)
    seen = 0
    for d, group in pieces.fillna(-1).groupby("doc_id"):
        seen += group["length"].sum()
        assert group["length"].sum() == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            at = 0
            for p in group.sort_values("start").itertuples():
                assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[d][0][at : at + p.length], "<u4").tobytes())
                at += p.length
    assert seen == sum(len(i) for many in ids.values() for i in many)
    for _, group in pieces.groupby("sequence_id"):
        at = 0
        for p in group.sort_values("offset").itertuples():
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack_documents(empty(spark), WORDS, 1).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_packing_keeps_all_limits(cut):
    r = random.Random(3)
    limits = packing.Limits(max_tokens=64, max_segments=5, max_loss=40, window=12, cut=cut)
    items = [(n := r.randint(1, 64 if cut else 60), r.randint(0, min(n, 40))) for _ in range(400)]
    packer = packing.Packer(limits)
    done = [s for k, (n, loss) in enumerate(items) for s in packer.add(k, n, loss)] + list(packer.flush())
    covered = {k: [] for k in range(len(items))}
    for pieces in done:
        assert len(pieces) <= 5 and sum(p.length for p in pieces) <= 64
        lost = 0
        for p in pieces:
            n, loss = items[p.item]
            lost += max(0, p.start + p.length - max(p.start, n - loss))
            covered[p.item].append((p.start, p.length))
        assert lost <= 40
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
    for k, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == items[k][0]
    if not cut:
        assert all(len(parts) == 1 for parts in covered.values())


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_bit_parallel_subsequences():
    r = random.Random(2)
    pairs = [("".join(r.choice("AB+/z") for _ in range(r.randint(1, 64))), "".join(r.choice("AB+/z") for _ in range(r.randint(1, 64)))) for _ in range(200)]
    found = fingerprints._common([a for a, _ in pairs], [b for _, b in pairs])
    assert found.tolist() == [common_subsequence(a, b) for a, b in pairs]


def test_fingerprints_tell_copies(spark):
    docs = documents(spark)
    rows = sorted([(r.doc_id, r.text or "", r.text is not None) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[2], x[1]))
    found = {}
    for r in fingerprints.with_next(docs).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for k, (doc_id, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        match = [r for r in found[doc_id] if r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()]
        assert match, doc_id
        r = match[0]
        assert r.n_chars == len(text) and r.fingerprint == fingerprints.fingerprint(text) and r.edited_fingerprint == fingerprints.fingerprint(new)
        assert r.near_edited == fingerprints.likeness([(r.fingerprint, r.edited_fingerprint)])[0] and 0 <= r.near_next <= 1
    assert fingerprints.with_next(empty(spark)).count() == 0


def test_fingerprint_of_one_row_and_equal_texts(spark):
    one = documents(spark).filter("doc_id = 61").limit(1)
    r = fingerprints.with_next(one).first()
    assert r.near_next == 1.0
    assert fingerprints.fingerprint("abc" * 900) == fingerprints.fingerprint("abc" * 900)
    assert fingerprints.likeness([("1:::", "1:::"), ("1:::", fingerprints.fingerprint("text"))]).tolist() == [1.0, 0.0]


def test_half_of_a_text_is_nearer_than_another_text():
    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(r.randint(8, 800)))
    near, far = [], []
    for _ in range(150):
        a, b = text(), text()
        new = fingerprints.edited(a, b)
        own = fingerprints.fingerprint(a)
        near.append((own, fingerprints.fingerprint(new)))
        far.append((own, fingerprints.fingerprint(b)))
    assert (fingerprints.likeness(near) > 0.2).mean() > 0.97 and fingerprints.likeness(far).mean() < 0.02


def greedy(pieces, word):
    known, n, at = set(pieces) | {bytes([b]) for b in range(256)}, 0, 0
    while at < len(word):
        end = len(word)
        while word[at:end] not in known:
            end -= 1
        at, n = end, n + 1
    return n


def test_automaton_counts_as_greedy_matching_does():
    r = random.Random(1)
    for _ in range(150):
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 25))]
        automaton = wordpieces.Automaton(pieces)
        for _ in range(40):
            word = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 15)))
            assert automaton.count(word) == greedy(pieces, word)


def test_token_counts_of_a_table(spark):
    path = tokens.vocabulary("piece_bpe_32k.model")
    pieces, mark = wordpieces.sentence_pieces(path)
    docs = documents(spark).filter("doc_id != 31 or doc_id is null")  # brute force is slow on the longest text
    want = sorted((r.doc_id or -1, len(w := (r.text or "").encode().split()), sum(greedy(pieces, mark.encode() + x) for x in w if len(x) < 100) + sum(wordpieces.Counter(path).count(x.decode())[1] for x in w if len(x) >= 100)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_words, r.n_tokens) for r in wordpieces.token_counts(docs, path).collect()) == want
    assert wordpieces.token_counts(empty(spark), path).count() == 0


def plain_fingerprint(text):
    """Byte by byte, with Python's integers."""
    data, top, mix, base = text.encode(), 1 << 64, 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D
    if not data:
        return "1:::"
    levels = []
    for i in range(len(data)):
        h = int.from_bytes((bytes(8) + data[: i + 1])[-8:], "little") * mix % top
        h = (h ^ h >> 29) * mix % top >> 32
        level = 0
        while h >> level & 1:
            level += 1
        levels.append(level)
    k = 0
    if len(data) > 64:
        k = max(j for j in range(34) if sum(v >= j for v in levels) + 1 >= 32)
    signatures = []
    for size in (k, k + 1, k + 2):
        pieces, begin = [], 0
        for i, v in enumerate(levels):
            if v >= size:
                pieces.append(data[begin : i + 1])
                begin = i + 1
        if begin < len(data):
            pieces.append(data[begin:])
        letters = []
        for piece in pieces:
            s = sum((b + 1) * pow(base, i, top) for i, b in enumerate(piece)) % top
            letters.append(((s ^ s >> 31) * mix % top) >> 58)
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        out = "".join(alphabet[c] for i, c in enumerate(letters) if i < 3 or letters[i - 3 : i] != [c] * 3)
        if len(out) > 64:
            out = out[:63] + alphabet[hashlib.md5(out[63:].encode()).digest()[0] & 63]
        signatures.append(out)
    return f"{1 << k}:" + ":".join(signatures)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, *s), (y, *t) = a.split(":"), b.split(":")
    best = 0.0
    for i, p in enumerate(s):
        for j, q in enumerate(t):
            if int(x) << i == int(y) << j and p and q:
                n = min(5, max(1, min(len(p), len(q)) // 2))
                if any(p[u : u + n] == q[v : v + n] for u in range(len(p) - n + 1) for v in range(len(q) - n + 1)):
                    best = max(best, 2 * common_subsequence(p, q) / (len(p) + len(q)))
    return best


def test_fingerprints_byte_by_byte():
    r = random.Random(11)
    cases = [(t or "")[:6000] for t in texts()] + ["a" * 300, "ab" * 200, "x", "é", "".join(r.choice("abc \n") for _ in range(63)), "".join(r.choice("abc \n") for _ in range(65))]
    cases += ["".join(chr(r.randrange(32, 0x250)) for _ in range(r.randint(1, 900))) for _ in range(60)]
    assert [fingerprints.fingerprint(t) for t in cases] == [plain_fingerprint(t) for t in cases]
    prints = [plain_fingerprint(t) for t in cases]
    edited = [plain_fingerprint(t[: len(t) // 2] + u[: len(t) // 2]) for t, u in zip(cases, cases[1:] + cases[:1], strict=True)]
    pairs = list(zip(prints, edited, strict=True)) + list(zip(prints, prints[1:], strict=False))
    assert np.allclose(fingerprints.likeness(pairs), [plain_likeness(a, b) for a, b in pairs], rtol=0, atol=1e-15)


def test_fingerprints_of_nulls_alone_and_of_one_row(spark):
    alone = documents(spark).filter("doc_id = 61").limit(1).withColumn("text", F.lit(None).cast("string"))
    r = fingerprints.with_next(alone).first()
    assert (r.n_chars, r.fingerprint, r.near_edited, r.near_next) == (0, "1:::", 1.0, 1.0)
    nulls = spark.createDataFrame([(k, None) for k in range(5)], "doc_id long, text string")
    assert {(x.fingerprint, x.near_next) for x in fingerprints.with_next(nulls).collect()} == {("1:::", 1.0)}
