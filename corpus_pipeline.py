"""A training corpus in five stages over ``documents``; counted as part of ``vacantia.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import exact_dedup, mixing, ngram_join, quality
from vacantia.llm import queries as q
from vacantia.llm._util import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of its input, does not reject."""
    model = q.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    return exact_dedup.drop_exact_copies(docs, keep="max")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return ngram_join.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by rates of at most one, so that their tokens meet the target weights without repeats."""
    rates = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), q.domain(), q.KEPT_TARGETS, most=1.0)
    return docs.join(rates.where("copies > 0").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to."""
    return q.token_digests(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The classifier, mixing and tokenizer stages cannot be stated in SQL. Tests hold the dedup and tokenizer stages
#: against brute force in place, the classifier and mixing as operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
