"""One thin query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadflow.llm import bpe, chat, decontamination, html_text, line_rules, media, merkle, prefix_trie, quality, simhash, suffix_array, suffix_automaton, toxicity
from leadflow.llm.common import table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digests(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotation_rows(table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, seed=42, distance=3)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_automaton.digests(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"), block=100, shares=6)


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.rule_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_rows(table(spark, sf_dir, "documents"), every=7)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_suffix_array, op2_chat, op3_bpe, op4_quality, op5_simhash, op6_substring, op7_html, op8_toxicity, op9_webp, op10_decontamination, op11_prefix_trie, op12_line_rules, op13_merkle)} | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    found = {
        "op1_suffix_array": suffix_array.DIGESTS_SQL, "op6_substring": suffix_automaton.DIGESTS_SQL, "op2_chat": chat.ROTATION_SQL, "op10_decontamination": decontamination.REPORT_SQL,
        "op11_prefix_trie": prefix_trie.NODES_SQL, "op13_merkle": merkle.MANIFEST_SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
