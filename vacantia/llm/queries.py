"""Queries over the driver's tables: one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import avi, chat, exact_dedup, kd_shard, langid, lattice, mixing, ngram_join, pieces, quality

#: Labelled rows that the quality classifier is fitted on, and documents per language for the language models.
QUALITY_ROWS, LANG_ROWS = 4000, 1000
#: Target weights of the domains of ``labels`` and the budget in units of the tokens there are.
TARGETS = {"clean": 0.95, "toxic": 0.04, "junk": 0.01}
BUDGET = 1.1
#: Target weights of the pipeline, which only drops documents.
KEPT_TARGETS = {"clean": 0.97, "toxic": 0.03}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.MilModel:
    return quality.fit(*quality.sample_labelled(docs, labels, remainder(5) != 0, "doc_id", "text", "quality", QUALITY_ROWS))


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_model(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "n_passages", "max_attention")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_read(spark, sf_dir, "documents"), links=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="max")


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shard.kd_shards(_read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(avi.store_text(_read(spark, sf_dir, "documents")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.format_chats(chat.fold_events(chat.as_events(turns.unionByName(extra))), with_text=False)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_read(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    def digest(ids: list[int], begins: np.ndarray, ends: np.ndarray, decoded: str) -> tuple:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(ids), sha(" ".join(map(str, ids))), sha(decoded), int(ends[-1]) if len(ends) else 0

    return pieces.round_trips(docs, piece_model(), digest, "n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")


def domain() -> Column:
    """The domain that a row of ``labels`` stands for."""
    return F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), domain(), TARGETS, BUDGET)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    texts, langs = langid.sample_labelled(docs, remainder(3) != 1, "doc_id", "text", "lang", LANG_ROWS)
    found = langid.identify(docs, langid.fit(texts, langs))
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice.score_texts(_read(spark, sf_dir, "documents"), piece_model(), remainder(10) != 0)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_mil, op2_ngram_jaccard_join, op3_exact_dedup, op4_kd_sharding, op5_avi_mjpeg, op6_chat_formatting, op7_sentencepiece, op8_soft_mixing, op9_language_id, op10_lattice_score, pipeline]
    return {f.__name__: f for f in own}
