"""A training corpus from raw documents: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from docloom.llm.common import drop, materialise, release, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, those without any letter go; a missing ``lang`` becomes the predicted one."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.keep_determined(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (shingles of five words, similarity of 0.8 or more), the smallest doc_id stays."""
    return near_dedup.keep_representatives(docs, shingle=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The curriculum's documents in training order, one row for each time a document is taken."""
    return mixing.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mixture, and the digest of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("BPE", tokens)]

#: SQL cannot express sketches, kernels or merges; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it.

    Tables that a stage has written go with its end, and its input too; the last stage's input stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, mark = docs, written(spark)
        docs = materialise(stage(spark, before, sf_dir), "stage-" + name.replace(" ", "-"))
        release(spark, mark, but=docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
