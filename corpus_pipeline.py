"""A corpus pipeline: quality, near-duplicates, repeated passages, mixture, tokens. Part of the subpackage llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, mixing, near_dedup, quality_classifier, suffix_dedup
from quillspark.llm.common import few, read, written
from quillspark.llm.queries import RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores as good."""
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    scored = quality_classifier.scored(docs.select(F.struct(*docs.columns).alias("document")), model)
    return scored.filter(F.col("score") >= quality_classifier.THRESHOLD).select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity of 0.8 or more. Rows without an id stay."""
    gone = written(near_dedup.find(docs).filter("not kept").select("doc_id").distinct())
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one has; those with nothing left go."""
    rest = suffix_dedup.remove(docs, whole_characters=True)
    cut = F.col("n_removed") > 0
    rest = rest.withColumn("rest", F.when(cut, F.decode("kept", "UTF-8"))).filter(~cut | (F.length("rest") > 0))
    changed = {"text": F.when(cut, F.col("rest")).otherwise(F.col("document.text")), "n_chars": F.when(cut, F.length("rest").cast("long")).otherwise(F.col("document")["n_chars"])}
    return rest.select(*(changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics."""
    return mixing.kept_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, as digests and counts."""
    return bpe.round_trip(docs, bpe.load(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("encoded", encoded)]

#: SQL expresses neither the trees nor the sketches; tests/llm/test_pipeline.py compares run() with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
