"""The registered queries of the operators (name -> function of session and folder) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, language_id, mixing, near_dedup, packing, periodic_runs, prefix_trie, quality_classifier, quality_rules, suffix_dedup, topk_join, url_filter
from .common import read

#: Vocabulary file of the BPE query.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Tokenizer file of the packing query.
TOKENIZER = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.unionByName(extra))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(read(spark, sf_dir, "documents"), k=3, percent=85)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), bpe.load(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join.search(read(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_chat_formatting, op3_mixing, op4_language_id, op5_minhash_dedup, op6_suffix_dedup, op7_byte_bpe, op8_quality_rules,
        op9_topk_search, op10_url_filter, op11_packing, op12_prefix_trie, op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {"op2_chat_formatting": chat_format.ORACLE, "op9_topk_search": topk_join.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
