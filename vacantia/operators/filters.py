"""Predicates of the query surface: parameters that are None don't restrict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The extraction methods that make up pipeline A.
PIPELINE_A = ("ner", "regex")


def _all(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def jobs(df: DataFrame, country: str | None = None, portal: str | None = None, search: str | None = None, year: int | None = None) -> DataFrame:
    """Country compares in upper case, portal in lower; ``search`` is a pattern over title, location and company."""
    found = None
    if search:
        found = F.lit(False)
        for c in ("title", "location", "company"):
            found = found | F.col(c).ilike(f"%{search}%")
    return _all(
        df,
        F.col("country") == country.upper() if country else None,
        F.col("portal") == portal.lower() if portal else None,
        found,
        F.year("posted_date") == year if year else None,
    )


def skills(df: DataFrame, skill_type: str | None = None, method: str | None = None, mapped: str | None = None, query: str | None = None) -> DataFrame:
    """``method='pipeline_a'`` stands for both of its methods; unknown types and mapping states don't restrict."""
    by_method = None
    if method == "pipeline_a":
        by_method = F.col("extraction_method").isin(*PIPELINE_A)
    elif method:
        by_method = F.col("extraction_method") == method
    uri = F.col("esco_uri")
    return _all(
        df,
        F.col("skill_type") == skill_type if skill_type in ("hard", "soft") else None,
        by_method,
        (uri.isNotNull() & (uri != "")) if mapped == "mapped" else (uri.isNull() | (uri == "")) if mapped == "unmapped" else None,
        F.col("skill_text").ilike(f"%{query}%") if query else None,
    )


def with_status(df: DataFrame, status: str | None, cleaned: DataFrame | None = None, gold: DataFrame | None = None) -> DataFrame:
    """Jobs that are cleaned or annotated; ``raw`` and None keep all. A semi join, so no id list is collected."""
    if status == "cleaned":
        return df.join(cleaned.select("job_id"), "job_id", "left_semi")
    if status == "golden":
        return df.join(gold.select("job_id").distinct(), "job_id", "left_semi")
    return df


def of_jobs(skills_df: DataFrame, jobs_df: DataFrame, country: str | None) -> DataFrame:
    """Skills of a country's jobs; without a country the join is left out."""
    return skills_df if not country else skills_df.join(jobs(jobs_df, country=country).select("job_id"), "job_id", "left_semi")


def unified(df: DataFrame, source: str) -> DataFrame:
    """The three skill sources in one shape: job_id, skill_text, skill_type, esco_uri, extraction_method, confidence_score."""
    if source == "manual":
        return df.select("job_id", "skill_text", "skill_type", F.lit(None).cast("string").alias("esco_uri"), F.lit("manual").alias("extraction_method"), F.lit(1.0).alias("confidence_score"))
    if source == "pipeline_b":
        return df.select("job_id", F.col("normalized_skill").alias("skill_text"), "skill_type", F.col("esco_concept_uri").alias("esco_uri"), F.lit("pipeline_b").alias("extraction_method"), F.col("llm_confidence").alias("confidence_score"))
    return df.select("job_id", "skill_text", "skill_type", "esco_uri", "extraction_method", "confidence_score")
