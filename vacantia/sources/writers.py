"""Writers: idempotent inserts, upserts, replacement by key, status updates, documents and summaries.

Targets are folders of Parquet. A changed target is written beside the old one and swapped, so a failed
write leaves the old rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.text import content_hash


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _swap(df: DataFrame, path: str) -> None:
    spark, new = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, old = _fs(spark, path)
    aside = _fs(spark, f"{new}-old")[1]
    fs.rename(old, aside)  # a crash between the two leaves the old rows beside the path
    fs.rename(_fs(spark, new)[1], old)
    fs.delete(aside, True)


def insert_new(rows: DataFrame, path: str, key: str = "content_hash") -> int:
    """Append rows whose key is new, one row per key; returns how many. A null key never conflicts."""
    spark = rows.sparkSession
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*rows.columns)
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def insert_jobs(rows: DataFrame, path: str) -> int:
    """Job rows with their content hash, those already there left out."""
    return insert_new(rows.withColumn("content_hash", content_hash("title", "description", "requirements")), path)


def merged(old: DataFrame, new: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """Upsert as a plan: new rows win; with ``only`` just these columns of rows that both have."""
    if only is None:
        return old.join(new.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new)
    n = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    pick = lambda c: F.when(F.col("_new") & F.lit(c in only), F.col(f"_{c}")).when(F.col("_old").isNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    both = old.withColumn("_old", F.lit(True)).join(n, keys, "full")
    return both.select(*keys, *[pick(c) for c in old.columns if c not in keys])


def upsert(new: DataFrame, path: str, keys: list[str], only: list[str] | None = None) -> None:
    spark = new.sparkSession
    if not exists(spark, path):
        new.write.parquet(path)
        return
    _swap(merged(spark.read.parquet(path), new, keys, only), path)


def replace_by_key(new: DataFrame, path: str, key: str) -> None:
    """Rows of the keys in ``new`` are replaced as a whole; running it again changes nothing."""
    spark = new.sparkSession
    if not exists(spark, path):
        new.write.parquet(path)
        return
    old = spark.read.parquet(path)
    _swap(old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new), path)


def reload(rows: DataFrame, path: str) -> None:
    """Truncate and load."""
    if exists(rows.sparkSession, path):
        _swap(rows, path)
    else:
        rows.write.parquet(path)


def fan_out(rows: DataFrame, mapping: DataFrame, key: str = "skill_text", columns: tuple[str, ...] = ("esco_uri",)) -> DataFrame:
    """Columns set from a mapping by text; rows without one keep theirs."""
    m = mapping.select(F.lower(F.trim(key)).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates(["_k"])
    joined = rows.withColumn("_k", F.lower(F.trim(key))).join(m, "_k", "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}).select(*rows.columns)


def with_status(jobs: DataFrame, updates: DataFrame, stage: str, now: Column, key: str = "job_id") -> DataFrame:
    """Jobs after status updates of a stage: completed sets the time, failed adds an attempt and the error."""
    u = updates.select(key, F.col("status").alias("_s"), F.col("error").alias("_e"))
    s, n = F.col("_s"), f"{stage}_attempts"
    out = jobs.join(u, key, "left").withColumns(
        {
            f"{stage}_status": F.coalesce(s, F.col(f"{stage}_status")),
            f"{stage}_completed_at": F.when(s == "completed", now).otherwise(F.col(f"{stage}_completed_at")),
            n: F.when(s == "failed", F.coalesce(F.col(n), F.lit(0)) + 1).otherwise(F.col(n)),
            f"{stage}_error": F.when(s == "failed", F.col("_e")).when(s == "completed", F.lit(None)).otherwise(F.col(f"{stage}_error")),
        }
    )
    return out.select(*jobs.columns)


def reasoning(rows: DataFrame) -> DataFrame:
    """``llm_reasoning`` from model, match method and confidence."""
    text = F.format_string("%s; %s; %.2f", F.coalesce("llm_model", F.lit("unknown")), F.coalesce("esco_match_method", F.lit("none")), F.coalesce("llm_confidence", F.lit(0.0)))
    return rows.withColumn("llm_reasoning", text)


def append_extractions(rows: DataFrame, path: str) -> None:
    """Extraction results with their context cut to 50 characters."""
    rows.withColumn("source_section", F.substring("source_section", 1, 50)).write.mode("append").parquet(path)


def append_result(spark: SparkSession, path: str, kind: str, parameters: DataFrame, results: DataFrame) -> None:
    """One analysis document: parameters and results (one row each) as JSON."""
    p, r = (df.select(F.to_json(F.struct("*")).alias(n), F.lit(1).alias("_k")) for df, n in ((parameters, "parameters"), (results, "results")))
    doc = p.join(r, "_k").select(F.sha2(F.concat_ws("|", F.lit(kind), "parameters", "results"), 256).alias("analysis_id"), F.lit(kind).alias("analysis_type"), "parameters", "results")
    doc.write.mode("append").parquet(path)


def json_and_csv(rows: DataFrame, folder: str, columns: list[str] | None = None) -> None:
    """The same rows as JSON lines and as a CSV of those of ``columns`` that exist."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    kept = [c for c in (columns or rows.columns) if c in rows.columns]
    rows.select(*kept).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
