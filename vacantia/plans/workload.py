"""The canned analytic workload: dataset, gold standard, pipelines, taxonomy and executive reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import aggregates as A
from vacantia.plans import standins as S
from vacantia.plans.registry import register


@register("""SELECT 'raw_jobs' AS relation, count(*) AS n FROM raw_jobs UNION ALL SELECT 'cleaned_jobs', count(*) FROM cleaned_jobs UNION ALL SELECT 'extracted_skills', count(*) FROM extracted_skills
UNION ALL SELECT 'enhanced_skills', count(*) FROM enhanced_skills UNION ALL SELECT 'gold', count(*) FROM gold""")
def q0_table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [getattr(S, n)(spark, d).agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n")) for n in ("raw_jobs", "cleaned_jobs", "extracted_skills", "enhanced_skills", "gold")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register("SELECT extraction_method, count(*) AS n FROM extracted_skills GROUP BY 1")
def q0_methods(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.extracted_skills(spark, d), "extraction_method")


@register("SELECT llm_model, count(*) AS n FROM enhanced_skills WHERE llm_model IS NOT NULL GROUP BY 1")
def q0_models(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.enhanced_skills(spark, d).where("llm_model is not null"), "llm_model")


@register("SELECT count(*) AS total, count(DISTINCT portal) AS portals, count(DISTINCT country) AS countries, min(scraped_at) AS first_scrape, max(scraped_at) AS last_scrape FROM raw_jobs")
def q1_dataset(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("portal").alias("portals"), F.countDistinct("country").alias("countries"), F.min("scraped_at").alias("first_scrape"), F.max("scraped_at").alias("last_scrape"))


def _share_sql(keys: str, where: str = "", over: str = "") -> str:
    return f"SELECT {keys}, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER ({over}), 2) AS percentage FROM raw_jobs {where} GROUP BY {keys}"


@register(_share_sql("portal"))
def q2_portal_share(spark: SparkSession, d: str) -> DataFrame:
    return A.share(A.counted(S.raw_jobs(spark, d), "portal"), "n")


@register(_share_sql("country", "WHERE country IS NOT NULL"))
def q3_country_share(spark: SparkSession, d: str) -> DataFrame:
    return A.share(A.counted(S.raw_jobs(spark, d).where("country is not null"), "country"), "n")


@register(_share_sql("country, portal", over="PARTITION BY country"))
def q3_portal_in_country(spark: SparkSession, d: str) -> DataFrame:
    return A.share(A.counted(S.raw_jobs(spark, d), "country", "portal"), "n", within=("country",))


@register("""SELECT job_id, title, count(*) FILTER (skill_type = 'hard') AS hard, count(*) FILTER (skill_type = 'soft') AS soft FROM gold JOIN raw_jobs USING (job_id) GROUP BY 1, 2, posted_date ORDER BY posted_date DESC, job_id LIMIT 20""")
def q4_annotated_jobs(spark: SparkSession, d: str) -> DataFrame:
    joined = S.gold(spark, d).join(S.raw_jobs(spark, d).select("job_id", "title", "posted_date"), "job_id")
    per = joined.groupBy("job_id", "title", "posted_date").agg(F.count_if(F.col("skill_type") == "hard").alias("hard"), F.count_if(F.col("skill_type") == "soft").alias("soft"))
    return per.orderBy(F.desc_nulls_last("posted_date"), "job_id").limit(20).drop("posted_date")


@register("""WITH p AS (SELECT job_id, count(*) AS n, count(*) FILTER (skill_type = 'hard') AS hard, count(*) FILTER (skill_type = 'soft') AS soft FROM gold GROUP BY 1)
SELECT count(*) AS jobs, CAST(sum(n) AS BIGINT) AS skills, round(avg(n), 2) AS mean_skills, round(avg(hard), 2) AS mean_hard, round(avg(soft), 2) AS mean_soft FROM p""")
def q5_gold_two_level(spark: SparkSession, d: str) -> DataFrame:
    per = S.gold(spark, d).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("skill_type") == "hard").alias("hard"), F.count_if(F.col("skill_type") == "soft").alias("soft"))
    mean = lambda c: F.round(F.avg(c), 2).alias(f"mean_{c}")
    return per.agg(F.count(F.lit(1)).alias("jobs"), F.sum("n").alias("skills"), F.round(F.avg("n"), 2).alias("mean_skills"), mean("hard"), mean("soft"))


def _gold_share_sql(kind: str) -> str:
    return f"SELECT skill_text, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM gold WHERE skill_type = '{kind}' GROUP BY 1 ORDER BY n DESC, skill_text LIMIT 20"


def _gold_share(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The share is over all rows, the limit comes after."""
    return A.top(A.share(A.counted(S.gold(spark, d).where(F.col("skill_type") == kind), "skill_text"), "n"), 20, "n", "skill_text")


@register(_gold_share_sql("hard"))
def q5_top_hard(spark: SparkSession, d: str) -> DataFrame:
    return _gold_share(spark, d, "hard")


@register(_gold_share_sql("soft"))
def q5_top_soft(spark: SparkSession, d: str) -> DataFrame:
    return _gold_share(spark, d, "soft")


@register("SELECT job_id, title, skill_text, confidence_score FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE extraction_method = 'ner' ORDER BY confidence_score DESC, job_id, skill_text LIMIT 50")
def q6_ner_rows(spark: SparkSession, d: str) -> DataFrame:
    found = S.extracted_skills(spark, d).where("extraction_method = 'ner'").join(S.raw_jobs(spark, d).select("job_id", "title"), "job_id")
    return A.top(found, 50, "confidence_score", "job_id", "skill_text").select("job_id", "title", "skill_text", "confidence_score")


def _by_method_sql(method: str) -> str:
    return f"SELECT skill_text, count(*) AS n, round(avg(confidence_score), 4) AS confidence FROM extracted_skills WHERE extraction_method = '{method}' GROUP BY 1 ORDER BY n DESC, skill_text LIMIT 20"


def _by_method(spark: SparkSession, d: str, method: str) -> DataFrame:
    own = S.extracted_skills(spark, d).where(F.col("extraction_method") == method)
    return A.top(A.counted(own, "skill_text", confidence=F.round(F.avg("confidence_score"), 4)), 20, "n", "skill_text")


@register(_by_method_sql("ner"))
def q7_top_ner(spark: SparkSession, d: str) -> DataFrame:
    return _by_method(spark, d, "ner")


@register(_by_method_sql("regex"))
def q7_top_regex(spark: SparkSession, d: str) -> DataFrame:
    return _by_method(spark, d, "regex")


@register(_by_method_sql("tfidf"))
def q7_top_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _by_method(spark, d, "tfidf")


@register("SELECT extraction_method, count(DISTINCT job_id) AS jobs, count(*) AS skills, round(avg(confidence_score), 3) AS confidence, count(DISTINCT skill_text) AS unique_skills FROM extracted_skills GROUP BY 1")
def q7_method_comparison(spark: SparkSession, d: str) -> DataFrame:
    return S.extracted_skills(spark, d).groupBy("extraction_method").agg(F.countDistinct("job_id").alias("jobs"), F.count(F.lit(1)).alias("skills"), F.round(F.avg("confidence_score"), 3).alias("confidence"), F.countDistinct("skill_text").alias("unique_skills"))


@register("SELECT job_id, title, normalized_skill, llm_model FROM enhanced_skills JOIN raw_jobs j USING (job_id) WHERE NOT enhanced_skills.is_duplicate ORDER BY llm_confidence DESC, job_id, normalized_skill, llm_model LIMIT 50")
def q8_llm_rows(spark: SparkSession, d: str) -> DataFrame:
    found = S.enhanced_skills(spark, d).where("not is_duplicate").join(S.raw_jobs(spark, d).select("job_id", "title"), "job_id")
    return A.top(found, 50, "llm_confidence", "job_id", "normalized_skill", "llm_model").select("job_id", "title", "normalized_skill", "llm_model")


@register("SELECT normalized_skill, count(*) AS n, round(avg(llm_confidence), 4) AS confidence FROM enhanced_skills WHERE NOT is_duplicate GROUP BY 1 ORDER BY n DESC, normalized_skill LIMIT 20")
def q9_top_llm(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.counted(S.enhanced_skills(spark, d).where("not is_duplicate"), "normalized_skill", confidence=F.round(F.avg("llm_confidence"), 4)), 20, "n", "normalized_skill")


@register("SELECT llm_model, count(DISTINCT job_id) AS jobs, count(*) AS skills, round(avg(llm_confidence), 4) AS confidence, round(avg(processing_time_seconds), 4) AS seconds, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM enhanced_skills GROUP BY 1")
def q9_model_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.enhanced_skills(spark, d).groupBy("llm_model").agg(F.countDistinct("job_id").alias("jobs"), F.count(F.lit(1)).alias("skills"), F.round(F.avg("llm_confidence"), 4).alias("confidence"), F.round(F.avg("processing_time_seconds"), 4).alias("seconds"), F.sum("tokens_used").alias("tokens"))


@register("SELECT job_id, skill_text, esco_uri, confidence_score FROM extracted_skills WHERE esco_uri IS NOT NULL ORDER BY confidence_score DESC, job_id, skill_text, esco_uri LIMIT 30")
def q10_matched(spark: SparkSession, d: str) -> DataFrame:
    return A.top(S.extracted_skills(spark, d).where("esco_uri is not null"), 30, "confidence_score", "job_id", "skill_text", "esco_uri").select("job_id", "skill_text", "esco_uri", "confidence_score")


@register("SELECT esco_match_method, count(*) AS n, count(DISTINCT normalized_skill) AS skills, round(avg(llm_confidence), 4) AS confidence FROM enhanced_skills WHERE esco_match_method IS NOT NULL GROUP BY 1")
def q10_match_methods(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.enhanced_skills(spark, d).where("esco_match_method is not null"), "esco_match_method", skills=F.countDistinct("normalized_skill"), confidence=F.round(F.avg("llm_confidence"), 4))


@register("SELECT skill_text, count(*) AS n FROM extracted_skills WHERE esco_uri IS NULL GROUP BY 1 ORDER BY n DESC, skill_text LIMIT 30")
def q11_emergent(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.counted(S.extracted_skills(spark, d).where("esco_uri is null"), "skill_text"), 30, "n", "skill_text")


@register("SELECT CASE WHEN esco_uri IS NOT NULL THEN 'matched' ELSE 'emergent' END AS state, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM extracted_skills GROUP BY 1")
def q11_matched_share(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("esco_uri").isNotNull(), "matched").otherwise("emergent").alias("state")
    return A.share(S.extracted_skills(spark, d).groupBy(state).agg(F.count(F.lit(1)).alias("n")), "n")


@register("SELECT job_id, title, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE extraction_method = 'ner' GROUP BY 1, 2 ORDER BY n DESC, job_id LIMIT 20")
def q12_most_ner(spark: SparkSession, d: str) -> DataFrame:
    per = A.counted(S.extracted_skills(spark, d).where("extraction_method = 'ner'"), "job_id")
    return A.top(per.join(S.raw_jobs(spark, d).select("job_id", "title"), "job_id"), 20, "n", "job_id")


@register("SELECT job_id, title, count(*) AS n FROM enhanced_skills JOIN raw_jobs USING (job_id) GROUP BY 1, 2 ORDER BY n DESC, job_id LIMIT 20")
def q13_most_llm(spark: SparkSession, d: str) -> DataFrame:
    return A.top(A.counted(S.enhanced_skills(spark, d), "job_id").join(S.raw_jobs(spark, d).select("job_id", "title"), "job_id"), 20, "n", "job_id")


@register("""SELECT g.job_id, count(DISTINCT g.skill_text) AS gold, count(DISTINCT e.skill_text) AS ner, count(DISTINCT h.normalized_skill) AS llm
FROM gold g LEFT JOIN extracted_skills e ON g.job_id = e.job_id AND e.extraction_method = 'ner' LEFT JOIN enhanced_skills h ON g.job_id = h.job_id GROUP BY 1""")
def q14_three_way(spark: SparkSession, d: str) -> DataFrame:
    """Each side is counted by itself first, so rows don't multiply."""
    gold = S.gold(spark, d).groupBy("job_id").agg(F.countDistinct("skill_text").alias("gold"))
    ner = S.extracted_skills(spark, d).where("extraction_method = 'ner'").groupBy("job_id").agg(F.countDistinct("skill_text").alias("ner"))
    llm = S.enhanced_skills(spark, d).groupBy("job_id").agg(F.countDistinct("normalized_skill").alias("llm"))
    return gold.join(ner, "job_id", "left").join(llm, "job_id", "left").na.fill(0, ["ner", "llm"])


@register("""WITH h AS (SELECT DISTINCT job_id, normalized_skill FROM enhanced_skills)
SELECT g.job_id, count(*) AS gold, count(h.normalized_skill) AS found, round(count(h.normalized_skill) * 100.0 / count(*), 2) AS recall_percent FROM gold g LEFT JOIN h ON g.job_id = h.job_id AND g.skill_text = h.normalized_skill GROUP BY 1""")
def q14_gold_overlap(spark: SparkSession, d: str) -> DataFrame:
    llm = S.enhanced_skills(spark, d).select("job_id", F.col("normalized_skill").alias("skill_text")).distinct().withColumn("hit", F.lit(1))
    joined = S.gold(spark, d).join(llm, ["job_id", "skill_text"], "left")
    return joined.groupBy("job_id").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"), F.round(F.count("hit") * 100.0 / F.count(F.lit(1)), 2).alias("recall_percent"))


@register(_share_sql("language"))
def q16_language_share(spark: SparkSession, d: str) -> DataFrame:
    return A.share(A.counted(S.raw_jobs(spark, d), "language"), "n")


@register("SELECT country, skill_text, count(*) AS frequency FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE extraction_method = 'ner' AND skill_type = 'hard' GROUP BY 1, 2 HAVING count(*) > 50 ORDER BY country, frequency DESC")
def q17_ner_by_country(spark: SparkSession, d: str) -> DataFrame:
    found = S.extracted_skills(spark, d).where("extraction_method = 'ner' and skill_type = 'hard'").join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id")
    return A.counted(found, "country", "skill_text", name="frequency").where("frequency > 50").orderBy("country", F.desc("frequency"))


@register("SELECT country, normalized_skill, count(*) AS frequency FROM enhanced_skills JOIN raw_jobs USING (job_id) WHERE skill_type = 'hard' GROUP BY 1, 2 HAVING count(*) > 10 ORDER BY country, frequency DESC")
def q17_llm_by_country(spark: SparkSession, d: str) -> DataFrame:
    found = S.enhanced_skills(spark, d).where("skill_type = 'hard'").join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id")
    return A.counted(found, "country", "normalized_skill", name="frequency").where("frequency > 10").orderBy("country", F.desc("frequency"))


@register("SELECT job_id, title FROM raw_jobs j WHERE NOT EXISTS (SELECT 1 FROM extracted_skills e WHERE e.job_id = j.job_id)")
def q18_jobs_without_skills(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).join(S.extracted_skills(spark, d).select("job_id"), "job_id", "left_anti").select("job_id", "title")


@register(_share_sql("extraction_status"))
def q18_status_share(spark: SparkSession, d: str) -> DataFrame:
    return A.share(A.counted(S.raw_jobs(spark, d), "extraction_status"), "n")


@register("SELECT job_id, portal, extraction_status FROM raw_jobs WHERE extraction_status = 'failed' ORDER BY scraped_at DESC, job_id LIMIT 20")
def q18_failed(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).where("extraction_status = 'failed'").orderBy(F.desc_nulls_last("scraped_at"), "job_id").limit(20).select("job_id", "portal", "extraction_status")


@register("SELECT count(*) AS duplicates, count(DISTINCT duplicate_of) AS originals FROM raw_jobs WHERE is_duplicate")
def q18_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).where("is_duplicate").agg(F.count(F.lit(1)).alias("duplicates"), F.countDistinct("duplicate_of").alias("originals"))


@register("SELECT esco_concept_uri, label, count(*) AS n, count(DISTINCT job_id) AS jobs FROM enhanced_skills JOIN esco_skills ON esco_concept_uri = skill_uri GROUP BY 1, 2 ORDER BY n DESC, esco_concept_uri LIMIT 20")
def q19_concepts(spark: SparkSession, d: str) -> DataFrame:
    joined = S.enhanced_skills(spark, d).join(S.esco_skills(spark, d).select(F.col("skill_uri").alias("esco_concept_uri"), "label"), "esco_concept_uri")
    return A.top(A.counted(joined, "esco_concept_uri", "label", jobs=F.countDistinct("job_id")), 20, "n", "esco_concept_uri")


def _rollup_sql(by: str) -> str:
    return f"SELECT e.{by}, count(*) AS n, count(DISTINCT normalized_skill) AS skills FROM enhanced_skills JOIN esco_skills e ON esco_concept_uri = skill_uri GROUP BY 1"


def _rollup(spark: SparkSession, d: str, by: str) -> DataFrame:
    joined = S.enhanced_skills(spark, d).drop("skill_type").join(S.esco_skills(spark, d).withColumnRenamed("skill_uri", "esco_concept_uri"), "esco_concept_uri")
    return A.counted(joined, by, skills=F.countDistinct("normalized_skill"))


@register(_rollup_sql("skill_family"))
def q19_by_family(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d, "skill_family")


@register(_rollup_sql("skill_type"))
def q19_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _rollup(spark, d, "skill_type")


@register("SELECT skill_text, count(DISTINCT country) AS countries, string_agg(DISTINCT country, ', ' ORDER BY country) AS country_list FROM extracted_skills JOIN raw_jobs USING (job_id) GROUP BY 1 HAVING count(DISTINCT country) > 1")
def q20_multi_country(spark: SparkSession, d: str) -> DataFrame:
    joined = S.extracted_skills(spark, d).join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id")
    return joined.groupBy("skill_text").agg(F.countDistinct("country").alias("countries"), F.array_join(F.sort_array(F.collect_set("country")), ", ").alias("country_list")).where("countries > 1")


@register("""WITH s AS (SELECT job_id, count(*) AS n FROM extracted_skills GROUP BY 1)
SELECT combined_word_count // 100 * 100 AS bucket, count(*) AS jobs, round(avg(coalesce(n, 0)), 3) AS mean_skills FROM cleaned_jobs LEFT JOIN s USING (job_id) GROUP BY 1""")
def q22_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    per = A.counted(S.extracted_skills(spark, d), "job_id")
    joined = S.cleaned_jobs(spark, d).join(per, "job_id", "left").na.fill(0, ["n"])
    return joined.groupBy(F.expr("combined_word_count div 100 * 100").alias("bucket")).agg(F.count(F.lit(1)).alias("jobs"), F.round(F.avg("n"), 3).alias("mean_skills"))


@register("""SELECT 'jobs' AS metric, count(*) AS value FROM raw_jobs UNION ALL SELECT 'usable jobs', count(*) FROM raw_jobs WHERE is_usable UNION ALL SELECT 'countries', count(DISTINCT country) FROM raw_jobs
UNION ALL SELECT 'skills', count(*) FROM extracted_skills UNION ALL SELECT 'unique skills', count(DISTINCT skill_text) FROM extracted_skills UNION ALL SELECT 'annotated jobs', count(DISTINCT job_id) FROM gold""")
def q23_executive_summary(spark: SparkSession, d: str) -> DataFrame:
    jobs = A.metric_rows(S.raw_jobs(spark, d), **{"jobs": F.count(F.lit(1)), "usable jobs": F.count_if("is_usable"), "countries": F.countDistinct("country")})
    skills = A.metric_rows(S.extracted_skills(spark, d), **{"skills": F.count(F.lit(1)), "unique skills": F.countDistinct("skill_text")})
    return jobs.union(skills).union(A.metric_rows(S.gold(spark, d), **{"annotated jobs": F.countDistinct("job_id")}))


# -- queues by semi and anti joins


@register("SELECT job_id FROM raw_jobs j LEFT JOIN cleaned_jobs c USING (job_id) WHERE c.job_id IS NULL AND is_usable")
def pending_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).where("is_usable").join(S.cleaned_jobs(spark, d).select("job_id"), "job_id", "left_anti").select("job_id")


@register("SELECT DISTINCT e.job_id FROM extracted_skills e JOIN raw_jobs j USING (job_id) WHERE j.enhancement_status = 'pending' AND e.job_id NOT IN (SELECT job_id FROM enhanced_skills)")
def pending_enhancement(spark: SparkSession, d: str) -> DataFrame:
    """Semi then anti: a job comes once however many skills it has."""
    jobs = S.raw_jobs(spark, d).where("enhancement_status = 'pending'").select("job_id")
    return jobs.join(S.extracted_skills(spark, d).select("job_id"), "job_id", "left_semi").join(S.enhanced_skills(spark, d).select("job_id"), "job_id", "left_anti")


@register("""SELECT DISTINCT lower(trim(skill_text)) AS skill FROM extracted_skills e WHERE NOT EXISTS (SELECT 1 FROM esco_skills k WHERE lower(trim(k.label)) = lower(trim(e.skill_text)) AND k.skill_id % 2 = 0)""")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Skills without a vector, compared on trimmed lower case."""
    known = S.esco_skills(spark, d).where("skill_id % 2 = 0").select(F.lower(F.trim("label")).alias("skill"))
    return S.extracted_skills(spark, d).select(F.lower(F.trim("skill_text")).alias("skill")).distinct().join(known, "skill", "left_anti")
