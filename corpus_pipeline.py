"""The corpus pipeline: classify, remove near-duplicates, mix, encode.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read back as the next stage's ``docs``; all but the last
return the columns of ``docs``, whatever else these are.

Defined results: null or blank text goes in the first stage (all stay if fewer
than two grades are rated, and then go in the third, as they have no tokens); of
rows that share a ``doc_id`` one stays, in the second stage; a null ``doc_id``
is an id like others to the first, third and last stage and is no copy of
anything to the second; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import bpe, minhash, mixing, quality
from quillstone.llm.common import Scratch, table
from quillstone.llm.queries import BYTE_TOKENIZER, MIX_WEIGHTS, mix_levels, tokenizer_path

#: Share of the remaining tokens that the mixture takes; each document once at most.
MIX_FRACTION = 0.9


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps."""
    return quality.keep_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return minhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token budget of each source, without repeated epochs."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, fraction=MIX_FRACTION, max_epochs=1).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)`` of each document, the digest of the text decoded from the ids."""
    return bpe.encode_documents(docs, tokenizer_path(BYTE_TOKENIZER))


STAGES = [("quality", classify), ("near_duplicates", near_duplicates), ("mixture", mixture), ("bpe", encode)]

#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
