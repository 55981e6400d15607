"""Plans over stages of the platform: record checks, work claims, label views, the joined extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as T
from vacantia.operators import claims, extract, match
from vacantia.plans import standins as S
from vacantia.plans.fields import _FORM
from vacantia.plans.registry import register
from vacantia.plans.standins import table


def _like(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_CHECKED = "SELECT job_id, CASE job_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE title END AS title, company, portal, CASE WHEN job_id % 9 = 0 THEN NULL ELSE country END AS country FROM raw_jobs"


@register(f"""WITH j AS ({_CHECKED}) SELECT job_id, title IS NOT NULL AND title <> '' AND company <> '' AND portal <> '' AS complete,
 coalesce(country IN ('AMERICA', 'EUROPE'), false) AS country_ok, portal IN ('1-urgent', '2-high') AS portal_ok FROM j""")
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """Required fields, supported countries and portals of all jobs."""
    jobs = S.raw_jobs(spark, d).withColumns({"title": F.expr("CASE job_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE title END"), "country": F.expr("CASE WHEN job_id % 9 = 0 THEN NULL ELSE country END")})
    return jobs.select(
        "job_id",
        claims.has_fields(F.col("title"), F.col("company"), F.col("portal")).alias("complete"),
        claims.one_of(F.col("country"), ("AMERICA", "EUROPE")).alias("country_ok"),
        claims.one_of(F.col("portal"), ("1-urgent", "2-high")).alias("portal_ok"),
    )


_KINDS = "CASE skill_id % 5 WHEN 0 THEN 'onet_hot_tech' WHEN 1 THEN 'tier0_critical' WHEN 2 THEN 'skill' ELSE 'knowledge' END"
_ES = "CASE skill_id % 7 WHEN 0 THEN label || ' API' WHEN 1 THEN 'Desarrollo ' || label WHEN 2 THEN NULL ELSE label END"
_EN = "CASE skill_id % 3 WHEN 0 THEN label || ' Database' ELSE label END"


@register(f"""WITH t AS (SELECT skill_uri, {_KINDS} AS kind, lower(coalesce({_ES}, '')) AS es, lower({_EN}) AS en FROM esco_skills)
SELECT skill_uri, kind IN {claims.TECH_TYPES} OR (kind = 'knowledge' AND ({_like("es", claims.TECH_WORDS_ES)} OR {_like("en", claims.TECH_WORDS_EN)})) AS technical FROM t""")
def technical_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that an entity ruler takes up."""
    return S.esco_skills(spark, d).select("skill_uri", claims.technical(F.expr(_KINDS), F.expr(_ES), F.expr(_EN)).alias("technical"))


_PENDING = "SELECT j.job_id, j.portal, j.country, j.scraped_at, c.combined_word_count FROM raw_jobs j JOIN cleaned_jobs c USING (job_id) WHERE j.is_usable AND j.extraction_status = 'pending'"


def _batch(spark: SparkSession, d: str) -> DataFrame:
    jobs = S.raw_jobs(spark, d).where("is_usable and extraction_status = 'pending'")
    pending = jobs.join(S.cleaned_jobs(spark, d), "job_id").select("job_id", "portal", "country", "scraped_at", "combined_word_count")
    return claims.claim(pending, 4, 25, number=F.col("job_id"))


@register(f"WITH p AS ({_PENDING}), r AS (SELECT *, job_id % 4 AS w, row_number() OVER (PARTITION BY job_id % 4 ORDER BY scraped_at, job_id) AS n FROM p) SELECT CAST(w AS INT) AS worker, job_id, portal, country, combined_word_count FROM r WHERE n <= 25")
def claimed_batches(spark: SparkSession, d: str) -> DataFrame:
    """The next 25 jobs of each of four workers, with their cleaned sizes."""
    return _batch(spark, d).select("worker", "job_id", "portal", "country", "combined_word_count")


@register(f"""WITH p AS ({_PENDING}), r AS (SELECT job_id, row_number() OVER (PARTITION BY job_id % 4 ORDER BY scraped_at, job_id) AS n FROM p), b AS (SELECT job_id FROM r WHERE n <= 25)
SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM b) THEN 'processing' ELSE extraction_status END AS extraction_status, CASE WHEN job_id IN (SELECT job_id FROM b) THEN 1 ELSE 0 END AS extraction_attempts FROM raw_jobs""")
def jobs_after_claim(spark: SparkSession, d: str) -> DataFrame:
    jobs = S.raw_jobs(spark, d).select("job_id", "extraction_status", F.lit(0).alias("extraction_attempts"))
    return claims.claimed(jobs, _batch(spark, d))


_LABELS = "SELECT 'uri:' || lower(p_name) AS skill_uri, p_brand AS label, CASE p_partkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END AS language_code FROM part"


@register(f"WITH l AS ({_LABELS}) SELECT s.skill_uri, string_agg(DISTINCT l.label, ' ' ORDER BY l.label) AS all_labels, count(DISTINCT l.label) AS label_count FROM esco_skills s LEFT JOIN l ON s.skill_uri = l.skill_uri AND l.language_code = 'es' GROUP BY 1")
def spanish_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every skill with its labels in Spanish, if it has any."""
    labels = table(spark, d, "part").selectExpr("concat('uri:', lower(p_name)) AS skill_uri", "p_brand AS label", "CASE p_partkey % 3 WHEN 0 THEN 'es' WHEN 1 THEN 'en' END AS language_code")
    return claims.labels_in(S.esco_skills(spark, d), labels, "es")


@register("""SELECT CAST(c_nationkey AS INT) AS cluster_id, count(*) AS size, '' AS label, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS top_skills, 0.0::DOUBLE AS mean_frequency, 0 AS others
FROM customer WHERE c_nationkey = 7 GROUP BY 1""")
def cluster_document(spark: SparkSession, d: str) -> DataFrame:
    """One cluster looked up in JSON documents; parts that they lack take their defaults."""
    per = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_set("c_mktsegment")).alias("top_skills"))
    documents = per.select(F.to_json(F.struct(F.array(F.struct("cluster_id", "size", "top_skills")).alias("clusters"))).alias("json"))
    found = claims.cluster_detail(documents, 7)
    return found.select("cluster_id", "size", "label", F.array_join("top_skills", "|").alias("top_skills"), "mean_frequency", F.size("all_skills").alias("others"))


_NAMES = ("the", "and", "est", "von")


@register(rf"""WITH l AS (SELECT array_to_string(string_split({_FORM % 'text'}, ' ')[1:2], ' ') AS label, min(item_id) AS id FROM benchmark GROUP BY 1), d AS (SELECT doc_id, text, string_split({_FORM % 'text'}, ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS skill_text FROM d), e AS (SELECT doc_id, skill_text, 'ner' AS method, 0.6 AS confidence FROM g JOIN l ON skill_text = label WHERE len(string_split(label, ' ')) = 2),
r AS (SELECT doc_id, k AS skill_text, 'regex' AS method, 0.8 AS confidence FROM documents, (SELECT unnest({list(_NAMES)}) AS k) WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])' || k || '($|[^\p{{L}}\p{{M}}\p{{N}}_])')), u AS (SELECT * FROM r UNION ALL SELECT * FROM e)
SELECT doc_id, skill_text, method, CASE WHEN id % 2 = 0 THEN 'uri:' || id END AS skill_uri, round(0.7 * confidence + 0.3 * CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END, 4)::DOUBLE AS final_confidence FROM u LEFT JOIN l ON skill_text = label""")
def joined_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Patterns and entities of all documents, combined, mapped to a taxonomy and weighed."""
    docs = table(spark, d, "documents")
    first = F.array_join(F.slice(F.split(T.matching_form("text"), " "), 1, 2), " ")
    labels = table(spark, d, "benchmark").groupBy(first.alias("label")).agg(F.min("item_id").alias("skill_id"))
    regex = extract.regex_skills(docs, {"common": tuple(rf"\b{n}\b" for n in _NAMES)}, {}).withColumn("method", F.lit("regex"))
    ruler = extract.dictionary_matches(docs, labels, most=2).where("size = 2")
    ner = ruler.groupBy("doc_id", F.col("ngram").alias("skill_text")).agg(F.min("start").alias("start")).withColumns({"method": F.lit("ner"), "confidence": F.lit(0.6)})
    found = extract.combine(regex, ner)
    taxonomy = labels.where("skill_id % 2 = 0").select(F.concat(F.lit("uri:"), F.col("skill_id").cast("string")).alias("skill_uri"), "label")
    mapped = match.exact(found.select(F.col("skill_text").alias("skill")).distinct(), taxonomy).select(F.col("skill").alias("skill_text"), "skill_uri", F.col("confidence").alias("match_confidence"))
    return found.join(mapped, "skill_text", "left").select("doc_id", "skill_text", "method", "skill_uri", extract.final_confidence().alias("final_confidence"))
