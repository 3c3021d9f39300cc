"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpanel.llm import ann, fingerprints, mixing, packing, quality, records, shared, simhash, substrings, tokens, warc, wordpieces

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: The vocabulary whose pieces are counted.
PIECES = "piece_bpe_32k.model"
#: Target weights as parts; other sources have 1 part.
PARTS = {"src0": 4, "src1": 2, "src2": 3, "src3": 2}
BLOCK_CHARS = 65536


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likenesses."""
    return fingerprints.with_next(shared.table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; the model has not seen the held-out documents."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, shared.table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model)
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as framed records and read back from the files."""
    docs = shared.table(spark, sf_dir, "documents")
    manifest = records.write_records(docs, shared.scratch(spark, "records"), tokens.vocabulary(VOCABULARY), END_ID)
    return records.scan_records(manifest)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    index = warc.write_archives(shared.table(spark, sf_dir, "pages"), shared.scratch(spark, "warc"))
    return warc.read_archives(index).drop("url")


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of at most 2048 tokens."""
    docs = shared.table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokens.vocabulary(VOCABULARY), END_ID, packing.Limits(max_tokens=2048))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that also start earlier."""
    return substrings.deduplicated(shared.table(spark, sf_dir, "documents"), length=20)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and greedy longest-match word pieces."""
    return wordpieces.token_counts(shared.table(spark, sf_dir, "documents"), tokens.vocabulary(PIECES))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and slot in the interleaving of all sources at their target weights."""
    return mixing.interleave(shared.table(spark, sf_dir, "documents"), PARTS, block_chars=BLOCK_CHARS, keep=["doc_id", "source"])


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every vector whose id is divisible by 100."""
    return ann.search(shared.table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the component of documents that links of up to 2 bits reach."""
    return simhash.grouped(shared.table(spark, sf_dir, "documents"), words=3, bits=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_quality": op2_quality,
        "op3_binary_records": op3_binary_records,
        "op4_warc": op4_warc,
        "op5_vector_packing": op5_vector_packing,
        "op6_substrings": op6_substrings,
        "op7_token_counts": op7_token_counts,
        "op8_source_mixing": op8_source_mixing,
        "op9_neighbours": op9_neighbours,
        "op10_simhash": op10_simhash,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from netpanel.llm import oracles

    return oracles.oracle_sql()
