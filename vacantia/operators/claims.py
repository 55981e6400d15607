"""Work claims, record checks, label views and lookups in documents of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.rules import has_any

# Which labels of the taxonomy are technical.
TECH_TYPES = ("onet_hot_tech", "onet_in_demand", "tier1_critical", "tier0_critical")
TECH_WORDS_ES = ("programación", "software", "base de datos", "cloud", "desarrollo", "web", "api", "aplicación", "sistema informático", "tecnología de la información", "seguridad informática", "machine learning", "inteligencia artificial", "devops")
TECH_WORDS_EN = ("programming", "software", "database", "machine learning", "artificial intelligence")

CLUSTERS = "clusters array<struct<cluster_id: int, size: bigint, auto_label: string, top_skills: array<string>, mean_frequency: double, all_skills: array<string>>>"


def technical(kind: Column, label_es: Column, label_en: Column) -> Column:
    """Labels of a technical type, and labels of knowledge that hold a technical word."""
    words = has_any(F.lower(F.coalesce(label_es, F.lit(""))), TECH_WORDS_ES) | has_any(F.lower(F.coalesce(label_en, F.lit(""))), TECH_WORDS_EN)
    return F.coalesce(kind.isin(*TECH_TYPES) | ((kind == "knowledge") & words), F.lit(False))


def has_fields(*fields: Column) -> Column:
    """Every field is there and not empty."""
    out = F.lit(True)
    for f in fields:
        out = out & f.isNotNull() & (f != "")
    return out


def one_of(value: Column, known: tuple[str, ...]) -> Column:
    """The value is supported; null is not."""
    return F.coalesce(value.isin(*known), F.lit(False))


def claim(pending: DataFrame, workers: int, n: int, order: str = "scraped_at", key: str = "job_id", number: Column | None = None) -> DataFrame:
    """The next ``n`` rows of each of ``workers`` in order, ties by key, with ``worker``; no row has two workers.

    A row's worker is the hash of its key (or ``number``) modulo the workers. Ranks above ``n`` are cut before the
    shuffle, so a task holds ``n`` rows of each partition of the input.
    """
    at = F.pmod(F.xxhash64(key) if number is None else number, F.lit(workers)).cast("int")
    rank = F.row_number().over(Window.partitionBy("worker").orderBy(order, key))
    return pending.withColumn("worker", at).withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def claimed(jobs: DataFrame, batch: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs after a claim: those of the batch are in processing and have one more attempt."""
    mine = batch.select(key, F.lit(True).alias("_mine"))
    out = jobs.join(mine, key, "left")
    return out.withColumns({"extraction_status": F.when(F.col("_mine"), "processing").otherwise(F.col("extraction_status")), "extraction_attempts": F.col("extraction_attempts") + F.when(F.col("_mine"), 1).otherwise(0)}).select(*jobs.columns)


def labels_in(skills: DataFrame, labels: DataFrame, language: str, key: str = "skill_uri") -> DataFrame:
    """``key``, ``all_labels`` (distinct, sorted, joined by blanks; null without one) and ``label_count`` of every skill.

    The language is part of the join's condition, so skills without labels in it stay.
    """
    own = labels.where(F.col("language_code") == language).select(key, "label").distinct()
    joined = skills.select(key).join(own, key, "left").groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("_l"))
    return joined.select(key, F.when(F.size("_l") > 0, F.array_join("_l", " ")).alias("all_labels"), F.size("_l").cast("long").alias("label_count"))


def cluster_detail(documents: DataFrame, cluster_id: int, json: str = "json") -> DataFrame:
    """One cluster of documents of the form {clusters: [...]}; absent parts take their defaults. No such id: no rows."""
    rows = documents.select(F.explode(F.from_json(F.col(json), CLUSTERS)["clusters"]).alias("c")).select("c.*").where(F.col("cluster_id") == cluster_id)
    none = F.array().cast("array<string>")
    return rows.select("cluster_id", "size", F.coalesce("auto_label", F.lit("")).alias("label"), F.coalesce("top_skills", none).alias("top_skills"), F.coalesce("mean_frequency", F.lit(0.0)).alias("mean_frequency"), F.coalesce("all_skills", none).alias("all_skills"))
