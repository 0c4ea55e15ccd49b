"""The corpus pipeline: documents to packed training sequences, one stage after another.

Toxic documents go; of equal texts the one with the largest doc_id stays; of
each group of near-duplicates the one with the least; sources, languages and
topics are sampled to their target weights, in the tokens of the packer; what remains
is packed.  SQL cannot express the first stage, so there is no SQL for the rows:
tests hold the stages against plain versions.

Defined cases: a null text is an empty one, a null source or language the
empty one.  Very long texts are read whole, window by window.  Equal texts meet in
the second stage, so later ones see none; rows that repeat both doc_id and text
stay together until then.  An empty table gives an empty result.  All stages but
the last pass on the columns of documents, whatever else they are called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, exact_dedup, mixing, ngram_join, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, common.load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def sample_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, count=packing.lengths)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", sample_to_weights),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = common.load(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
