"""The pipeline's stages one after the other, on a small table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from netpanel.llm import queries, shared
from tests.llm.fixtures import documents


def test_stages_keep_their_contracts(spark):
    sf = "/root/testdata/sf0.001"
    docs = shared.table(spark, sf, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.written(stage(spark, docs, sf), f"test-{name}")
        assert out.dtypes == docs.dtypes, name
        seen.append(out.count())
        docs = out
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[3] == seen[4] and seen[-1] > 0.5 * seen[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()


def test_stages_of_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = shared.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if "text" not in out.columns else out


def test_registered():
    assert [q.split("_")[0] for q in queries.queries() if q != "pipeline"] == [f"op{n}" for n in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]


def odd_documents(spark):
    """Documents with nulls, ties, repeated rows, long texts and columns that are named like results."""
    names = ("score", "predicted", "kept", "n_words", "n_removed", "kept_sha256", "block", "round", "slot", "rank", "row", "whole", "file")
    docs = documents(spark, seed=6, n=50).select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])


def test_stages_of_odd_documents(spark, monkeypatch):
    """Rows keep all their columns, and each stage keeps the rows that its docstring names."""
    monkeypatch.setattr(corpus_pipeline.quality, "THRESHOLD", 0.0)
    sf, docs = "/root/testdata/sf0.001", odd_documents(spark)
    rows = lambda df: sorted(map(repr, (r.asDict() for r in df.collect())))
    stages = dict(corpus_pipeline.STAGES)
    scored = stages["quality"](spark, docs, sf)
    assert scored.dtypes == docs.dtypes and set(rows(scored)) <= set(rows(docs))
    once = stages["near_duplicates"](spark, docs, sf)
    assert once.dtypes == docs.dtypes and set(rows(once)) <= set(rows(docs)) and once.count() == len(set(rows(once)))
    assert once.filter("coalesce(trim(text), '') = ''").count() >= 1
    left = stages["repeated_passages"](spark, docs, sf)
    assert left.dtypes == docs.dtypes
    whole = {r.doc_id: r for r in docs.collect()}
    for r in left.collect():
        before = whole[r.doc_id].asDict()
        words = (before["text"] or "").split()
        same = r.text == (before["text"] or "")
        assert same or len((r.text or "").split()) < len(words) and r.n_chars == len(r.text)
        assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in before.items() if k not in ("text", "n_chars")}
    mixed = shared.written(stages["mixing"](spark, docs, sf), "test-mixed")
    assert mixed.dtypes == docs.dtypes and rows(mixed) == rows(docs)
    pieces = stages["packing"](spark, mixed, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}


def test_sequences_follow_the_mixture(spark):
    """Whatever tasks read which files: sequences in the order of their ids have the documents in the order of slots, but for the open examples."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k} "), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6))) for k in range(60)]).alias("text"), F.concat(F.lit("src"), F.pmod(F.xxhash64("id"), F.lit(4))).alias("source"))
    mixed = corpus_pipeline.mixing.interleave(docs, queries.PARTS, block_chars=4000)
    place = {r.doc_id: (r.slot, r["rank"]) for r in mixed.collect()}
    names = sorted(place, key=place.get)
    nth = {d: n for n, d in enumerate(names)}
    files = shared.written(corpus_pipeline.mixing.in_order(mixed, 7).select(*docs.columns), "test-order")
    found = corpus_pipeline.packing_stage(spark, files, "").groupBy("doc_id").agg(F.min("sequence_id").alias("s")).orderBy("s").collect()
    assert len(found) == 3000 and files.rdd.getNumPartitions() < 7
    late = [abs(nth[r.doc_id] - k) for k, r in enumerate(found)]
    sequences = corpus_pipeline.packing_stage(spark, files, "").agg(F.count_distinct("sequence_id")).first()[0]
    assert max(late) <= 64 * 3000 / sequences and np.mean(late) < 100  # none waits for more than ``window`` sequences; random places: 1000 on average
    # the share of a source among the first n documents of the sequences is its target's, within a block and the open examples
    parts, total = {"src0": 4, "src1": 2, "src2": 3, "src3": 2}, 11
    source = {r.doc_id: r.source for r in docs.collect()}
    chars = {r.doc_id: r.n for r in docs.select("doc_id", F.length("text").alias("n")).collect()}
    upto, all_chars = dict.fromkeys(parts, 0), 0
    for r in found[:1200]:  # while all sources last
        upto[source[r.doc_id]] += chars[r.doc_id]
        all_chars += chars[r.doc_id]
        assert all(abs(upto[s] - all_chars * a / total) < 2 * 4000 + 70 * 900 for s, a in parts.items())
