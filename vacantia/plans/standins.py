"""The platform's relations as projections of the driver's star-schema tables.

Each relation is stated twice: as a DataFrame for the plans and as SQL (``CTES``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_jobs(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    jobs = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return jobs.select(
        F.col("o_orderkey").alias("job_id"),
        F.lower("o_orderpriority").alias("portal"),
        F.col("r_name").alias("country"),
        F.col("n_name").alias("location"),
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("title"),
        F.col("c_name").alias("company"),
        F.col("o_totalprice").alias("salary"),
        F.to_date("o_orderdate").alias("posted_date"),
        F.col("o_orderdate").alias("scraped_at"),
        F.sha2(F.concat_ws("|", "c_mktsegment", "n_name", "o_orderpriority"), 256).alias("content_hash"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending").alias("extraction_status"),
        F.when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("pending").alias("enhancement_status"),
        (F.col("o_orderstatus") == "F").alias("is_processed"),
        (F.col("o_orderkey") % 5 != 0).alias("is_usable"),
        (F.col("o_orderkey") % 17 == 0).alias("is_duplicate"),
        F.when(F.col("o_orderkey") % 17 == 0, F.expr("o_orderkey div 34")).alias("duplicate_of"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "es").when(F.col("c_mktsegment") == "FURNITURE", "en").otherwise("mixed").alias("language"),
    )


def cleaned_jobs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 3 <> 0")
    return o.select(F.col("o_orderkey").alias("job_id"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("combined_word_count"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("combined_char_count"))


def extracted_skills(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("job_id"),
        F.col("p_name").alias("skill_text"),
        F.when(F.col("l_returnflag") == "R", "soft").otherwise("hard").alias("skill_type"),
        F.when(F.col("l_linenumber") == 7, "tfidf").when(F.col("l_linestatus") == "O", "ner").otherwise("regex").alias("extraction_method"),
        (1 - F.col("l_discount")).alias("confidence_score"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("uri:"), F.lower("p_name"))).alias("esco_uri"),
    )


def enhanced_skills(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return l.where("l_linenumber % 2 = 0").join(p, l.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("job_id"),
        F.col("p_name").alias("normalized_skill"),
        F.when(F.col("l_returnflag") == "R", "soft").otherwise("hard").alias("skill_type"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("uri:"), F.lower("p_name"))).alias("esco_concept_uri"),
        (1 - F.col("l_tax")).alias("llm_confidence"),
        F.when(F.col("l_linestatus") == "O", "gemma").when(F.col("l_returnflag") == "A", "llama").otherwise("qwen").alias("llm_model"),
        F.col("l_quantity").alias("processing_time_seconds"),
        F.col("l_quantity").cast("long").alias("tokens_used"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, "exact").otherwise("fuzzy").alias("esco_match_method"),
        (F.col("l_suppkey") % 10 == 0).alias("is_duplicate"),
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    rows = l.where("l_orderkey % 10 = 0 and l_linenumber <= 4").join(p, l.l_partkey == p.p_partkey)
    return rows.select(F.col("l_orderkey").alias("job_id"), F.col("p_name").alias("skill_text"), F.when(F.col("l_returnflag") == "R", "soft").otherwise("hard").alias("skill_type")).distinct()


def esco_skills(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_type").alias("skill_type"), F.min("p_brand").alias("skill_group"), F.max("p_type").alias("skill_family"), F.min("p_partkey").alias("skill_id")).select(F.concat(F.lit("uri:"), F.lower("p_name")).alias("skill_uri"), F.col("p_name").alias("label"), "skill_type", "skill_group", "skill_family", "skill_id")


def esco_relations(spark: SparkSession, d: str) -> DataFrame:
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    a, b = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a")), p.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("b"))
    kind = F.when(F.col("l_returnflag") == "A", "broader").when(F.col("l_returnflag") == "N", "related").otherwise("essential")
    return l.where("l_linenumber = 1").join(a, "l_partkey").join(b, "l_suppkey").select(F.concat(F.lit("uri:"), F.lower("a")).alias("source_uri"), F.concat(F.lit("uri:"), F.lower("b")).alias("target_uri"), kind.alias("relation_type")).distinct()


CTES = {
    "raw_jobs": """SELECT o_orderkey AS job_id, lower(o_orderpriority) AS portal, r_name AS country, n_name AS location,
 c_mktsegment || ' ' || n_name AS title, c_name AS company, o_totalprice AS salary, CAST(o_orderdate AS DATE) AS posted_date, o_orderdate AS scraped_at,
 sha256(c_mktsegment || '|' || n_name || '|' || o_orderpriority) AS content_hash,
 CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS extraction_status,
 CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'pending' END AS enhancement_status,
 o_orderstatus = 'F' AS is_processed, o_orderkey % 5 <> 0 AS is_usable, o_orderkey % 17 = 0 AS is_duplicate,
 CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey // 34 END AS duplicate_of,
 CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'es' WHEN c_mktsegment = 'FURNITURE' THEN 'en' ELSE 'mixed' END AS language
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cleaned_jobs": """SELECT o_orderkey AS job_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS combined_word_count, CAST(floor(o_totalprice / 100) AS BIGINT) AS combined_char_count
 FROM orders WHERE o_orderkey % 3 <> 0""",
    "extracted_skills": """SELECT l_orderkey AS job_id, p_name AS skill_text, CASE WHEN l_returnflag = 'R' THEN 'soft' ELSE 'hard' END AS skill_type,
 CASE WHEN l_linenumber = 7 THEN 'tfidf' WHEN l_linestatus = 'O' THEN 'ner' ELSE 'regex' END AS extraction_method, 1 - l_discount AS confidence_score,
 CASE WHEN p_partkey % 3 <> 0 THEN 'uri:' || lower(p_name) END AS esco_uri FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "enhanced_skills": """SELECT l_orderkey AS job_id, p_name AS normalized_skill, CASE WHEN l_returnflag = 'R' THEN 'soft' ELSE 'hard' END AS skill_type,
 CASE WHEN p_partkey % 4 <> 0 THEN 'uri:' || lower(p_name) END AS esco_concept_uri, 1 - l_tax AS llm_confidence,
 CASE WHEN l_linestatus = 'O' THEN 'gemma' WHEN l_returnflag = 'A' THEN 'llama' ELSE 'qwen' END AS llm_model, l_quantity AS processing_time_seconds,
 CAST(l_quantity AS BIGINT) AS tokens_used, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'exact' ELSE 'fuzzy' END AS esco_match_method,
 l_suppkey % 10 = 0 AS is_duplicate FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0""",
    "gold": """SELECT DISTINCT l_orderkey AS job_id, p_name AS skill_text, CASE WHEN l_returnflag = 'R' THEN 'soft' ELSE 'hard' END AS skill_type
 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 10 = 0 AND l_linenumber <= 4""",
    "esco_skills": """SELECT 'uri:' || lower(p_name) AS skill_uri, p_name AS label, min(p_type) AS skill_type, min(p_brand) AS skill_group, max(p_type) AS skill_family, min(p_partkey) AS skill_id
 FROM part GROUP BY p_name""",
    "esco_relations": """SELECT DISTINCT 'uri:' || lower(a.p_name) AS source_uri, 'uri:' || lower(b.p_name) AS target_uri,
 CASE l_returnflag WHEN 'A' THEN 'broader' WHEN 'N' THEN 'related' ELSE 'essential' END AS relation_type
 FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON l_suppkey = b.p_partkey WHERE l_linenumber = 1""",
}


def with_ctes(sql: str) -> str:
    """``sql`` with the relations that it names stated as common table expressions."""
    import re

    used = [n for n in CTES if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
