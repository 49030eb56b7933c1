"""A training-data pipeline over documents: five stages, each one operator of leadflow.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and is the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadflow.llm import bpe, decontamination, similar, suffix_automaton, toxicity
from leadflow.llm.common import table
from leadflow.plans.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more for toxicity go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more) the document with the smallest doc_id stays."""
    return similar.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a repeated window of 35 words covers go; documents stay, with what is left."""
    return suffix_automaton.rewrite(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside a benchmark window of 10 words go; a document that is mostly benchmark goes whole."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10, mode="spans")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the text that they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_passages),
    ("bpe", encode_tokens),
]

#: SQL can express neither the trained classifier nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage but the last keeps is written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
