"""Documents to packed training sequences, in stages that each keep whole rows of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wirecorpus.llm import langid, line_crf, packing, superminhash
from wirecorpus.llm.common import table
from wirecorpus.session import checkpoint_base

SEQUENCE = 4096


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labeller keep."""
    return line_crf.keep_rows(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some confidence, by a model of their own labels."""
    return langid.keep_rows(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8."""
    return superminhash.one_of_each(docs, words=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=SEQUENCE)
    return packing.pack(pieces, SEQUENCE)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

# labelling, training, signatures and packing are not expressible as one statement
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what one leaves is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_base(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        out = f"{base}/{number}"
        made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
    return docs
