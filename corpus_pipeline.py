"""The training-data pipeline: quality, near duplicates, repeated passages, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, as they were: columns of ``docs``
may have any names, also those that an operator gives its results.

In every stage a null text counts as an empty one, rows that repeat are rows of their own unless the stage says otherwise, texts may
be of any length, and an empty table gives an empty one. What each does with ties, nulls and repeats stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpanel.llm import mixing, near, packing, quality, queries, shared, substrings, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; an empty or null text is scored like any other, and equal texts alike."""
    model = quality.train(docs, shared.table(spark, sf_dir, "labels"))
    return quality.scored(docs.select("text", F.struct(*docs.columns).alias("row")), model).filter("predicted = 1").select("row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id (null: largest), of each group of equal or near-equal texts; empty and null texts are equal.

    Of rows with that doc_id and text one stays.
    """
    return near.deduplicated(docs, words=5, similarity=0.8)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 20 or more words that start earlier too; a document that loses all its words goes.

    A text that loses words is its kept words, joined by spaces, and n_chars is its length; others stay as they are, empty and null ones too.
    Documents come in the order of doc_id, a null one last; rows that repeat doc_id and text are one document there, each with its result.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = substrings.deduplicated(docs.select("doc_id", "text", F.struct(*others).alias("row")), length=20, keep_text=True)
    kept = kept.filter("n_removed < n_words or n_removed = 0")
    shorter = F.col("n_removed") > 0
    own = {c: F.col("row")[c] for c in others} | {"text": F.col("kept")}
    if "n_chars" in others:
        own["n_chars"] = F.when(shorter, F.length("kept")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c].alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots: file by file, row by row, sources come at their target weights.

    The number in a file's name and a row's place in the file tell the order, which the next stage follows. A null source is a source of its own.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("whole"))
    mixed = mixing.interleave(rows, queries.PARTS, block_chars=queries.BLOCK_CHARS, keep=["whole"])
    return mixing.in_order(mixed).select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, which follow the order of the documents' files and rows.

    An empty or null text is its end id. ``docs`` that is no table of numbered files is packed in the order that it is read.
    """
    return packing.pack_documents(docs, tokens.vocabulary(queries.VOCABULARY), queries.END_ID, packing.Limits(max_tokens=2048, oldest_first=True), ordered=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeated_passages", passages_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier, nor what follows from it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on; each stage's rows lie in the shared folder before the next one reads them."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
