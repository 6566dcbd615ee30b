"""A corpus pipeline in five stages: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last return whole rows of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language_id, mixing, ngram_join, packing, workspace

#: No SQL can express a trained language model or a tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def _stage(f):
    """What the stage before left in the shared folder has been read into its written result, and goes."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workspace.release(spark, "pipeline")
        with workspace.tagged("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; the others go. Learned from the rows that are not held out.

    Null and empty texts, and texts without a letter, go. Repeated rows go or stay together. Very long texts are read
    whole. An empty table stays empty. Further columns may have any name.
    """
    return language_id.keep_accepted(spark, docs, language_id.train(spark, docs))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, up to white space, the one with the least doc_id.

    A null text counts as empty; a null doc_id stays only if no other row has its text. Of repeated rows one stays. Very
    long texts are hashed whole. An empty table stays empty. Further columns may have any name and type.
    """
    return exact_dedup.drop_duplicates(spark, docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by 5-word Jaccard similarity of 0.8 or more, the one with the least doc_id.

    Null and empty texts are no copies and stay; a null doc_id stays only if its class has no other. Rows alike in
    doc_id and text are one document. Very long texts are compared whole. An empty table stays empty. Further columns
    may have any name and type.
    """
    return ngram_join.keep_one(spark, docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order in which the sources' shares follow their target weights; the next stage packs in it.

    Rows without a source are a source of their own. Null, empty and very long texts, and repeated rows, take a place
    each. An empty table stays empty. Further columns may have any name and type.
    """
    return mixing.mix(spark, docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens, packed in windows of the mix's order.

    A null text is the end id alone, as an empty one; a null doc_id is carried. Very long texts give many pieces.
    Repeated rows are packed each. An empty table gives no rows. Further columns are not read.
    """
    import public_tokenizers

    return packing.pack_in_order(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = workspace.fresh_dir(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
