"""Market analytics: the REST query surface, views and temporal reports as plans over the stand-in relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.operators import aggregates as A
from vacantia.operators import filters as P
from vacantia.plans import standins as S
from vacantia.plans.registry import register


# -- skills


@register("""WITH t AS (SELECT skill_text, skill_type, count(*) AS n FROM extracted_skills GROUP BY ALL ORDER BY n DESC, skill_text, skill_type LIMIT 20)
SELECT skill_text, skill_type, n, round(n * 100.0 / sum(n) OVER (), 2) AS percentage FROM t""")
def top_skills(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent skills; percentages are of the rows returned."""
    return A.share(A.top(A.counted(S.extracted_skills(spark, d), "skill_text", "skill_type"), 20, "n", "skill_text", "skill_type"), "n")


@register("""WITH t AS (SELECT skill_text, skill_type, esco_uri, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id)
 WHERE country = 'ASIA' AND extraction_method IN ('ner', 'regex') AND skill_type = 'hard' AND esco_uri IS NOT NULL AND esco_uri <> '' GROUP BY ALL
 ORDER BY n DESC, skill_text, esco_uri LIMIT 15)
SELECT *, round(n * 100.0 / sum(n) OVER (), 2) AS percentage FROM t""")
def top_skills_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Top mapped hard skills of pipeline A in one country."""
    found = P.skills(S.extracted_skills(spark, d), "hard", "pipeline_a", "mapped")
    found = P.of_jobs(found, S.raw_jobs(spark, d), "asia")
    return A.share(A.top(A.counted(found, "skill_text", "skill_type", "esco_uri"), 15, "n", "skill_text", "esco_uri"), "n")


@register("""WITH g AS (SELECT country, skill_text, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id) GROUP BY ALL)
SELECT country, skill_text, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, skill_text) AS r FROM g) WHERE r <= 5""")
def top_skills_by_country(spark: SparkSession, d: str) -> DataFrame:
    joined = S.extracted_skills(spark, d).select("job_id", "skill_text").join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id")
    return A.top_per_group(A.counted(joined, "country", "skill_text"), 5, ("country",), "n", "skill_text")


@register("""WITH g AS (SELECT skill_text, skill_type, count(*) AS n, count(DISTINCT job_id) AS jobs FROM extracted_skills WHERE skill_text ILIKE '%ring%' GROUP BY ALL)
SELECT skill_text, skill_type, n, jobs, (SELECT count(*) FROM g) AS total, CAST(ceil((SELECT count(*) FROM g) / 5.0) AS BIGINT) AS total_pages FROM g ORDER BY n DESC, skill_text, skill_type LIMIT 5 OFFSET 5""")
def search_skills_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of five, with the total and the number of pages."""
    found = P.skills(S.extracted_skills(spark, d), query="ring").groupBy("skill_text", "skill_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"))
    found = found.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy()))
    found = found.withColumn("total_pages", F.ceil(F.col("total") / 5.0))
    return found.orderBy(F.desc("n"), "skill_text", "skill_type").offset(5).limit(5)


@register("""SELECT skill_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE country = 'EUROPE' GROUP BY 1""")
def skills_by_type(spark: SparkSession, d: str) -> DataFrame:
    found = P.of_jobs(S.extracted_skills(spark, d), S.raw_jobs(spark, d), "europe")
    return A.share(A.counted(found.withColumn("skill_type", F.coalesce("skill_type", F.lit("unknown"))), "skill_type"), "n")


@register("""SELECT min(skill_text) AS skill_text, count(*) AS n, count(DISTINCT job_id) AS jobs, list_sort(list(DISTINCT extraction_method)) AS methods, round(avg(confidence_score), 4) AS confidence
FROM extracted_skills WHERE lower(skill_text) = lower('SMALL RING')""")
def skill_detail_summary(spark: SparkSession, d: str) -> DataFrame:
    own = S.extracted_skills(spark, d).where(F.lower("skill_text") == "small ring")
    return own.agg(F.min("skill_text").alias("skill_text"), F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"), F.sort_array(F.collect_set("extraction_method")).alias("methods"), F.round(F.avg("confidence_score"), 4).alias("confidence"))


@register("""SELECT skill_text, count(*) AS n FROM extracted_skills WHERE job_id IN (SELECT job_id FROM extracted_skills WHERE lower(skill_text) = 'small ring') AND lower(skill_text) <> 'small ring'
GROUP BY 1 ORDER BY n DESC, skill_text LIMIT 10""")
def skill_cooccurring(spark: SparkSession, d: str) -> DataFrame:
    """Skills most often seen in the jobs that hold one skill."""
    skills = S.extracted_skills(spark, d).select("job_id", "skill_text")
    with_it = skills.where(F.lower("skill_text") == "small ring").select("job_id")
    return A.top(A.counted(skills.where(F.lower("skill_text") != "small ring").join(with_it, "job_id", "left_semi"), "skill_text"), 10, "n", "skill_text")


@register("SELECT country, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE lower(skill_text) = 'small ring' GROUP BY 1")
def skill_country_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.extracted_skills(spark, d).where(F.lower("skill_text") == "small ring").join(S.raw_jobs(spark, d), "job_id"), "country")


@register("""WITH s AS (SELECT DISTINCT job_id, skill_text FROM extracted_skills)
SELECT a.skill_text AS skill_1, b.skill_text AS skill_2, count(*) AS n FROM s a JOIN s b ON a.job_id = b.job_id AND a.skill_text < b.skill_text GROUP BY 1, 2 HAVING count(*) >= 10""")
def skill_cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return A.cooccurring(S.extracted_skills(spark, d), least=10)


# -- stats


@register("""SELECT (SELECT count(*) FROM raw_jobs) AS total_jobs, (SELECT count(*) FROM cleaned_jobs) AS cleaned, (SELECT count(DISTINCT job_id) FROM gold) AS annotated,
 (SELECT count(*) FROM extracted_skills) AS skills, (SELECT count(DISTINCT skill_text) FROM extracted_skills) AS unique_skills,
 (SELECT list_sort(list(DISTINCT country)) FROM raw_jobs) AS countries, (SELECT list_sort(list(DISTINCT portal)) FROM raw_jobs) AS portals,
 (SELECT min(posted_date) FROM raw_jobs) AS first_date, (SELECT max(posted_date) FROM raw_jobs) AS last_date""")
def stats_overview(spark: SparkSession, d: str) -> DataFrame:
    jobs = S.raw_jobs(spark, d).agg(F.count(F.lit(1)).alias("total_jobs"), F.sort_array(F.collect_set("country")).alias("countries"), F.sort_array(F.collect_set("portal")).alias("portals"), F.min("posted_date").alias("first_date"), F.max("posted_date").alias("last_date"))
    cleaned = S.cleaned_jobs(spark, d).agg(F.count(F.lit(1)).alias("cleaned"))
    gold = S.gold(spark, d).agg(F.countDistinct("job_id").alias("annotated"))
    skills = S.extracted_skills(spark, d).agg(F.count(F.lit(1)).alias("skills"), F.countDistinct("skill_text").alias("unique_skills"))
    one = F.lit(1)
    out = jobs.withColumn("_k", one)
    for other in (cleaned, gold, skills):  # single rows
        out = out.join(other.withColumn("_k", one), "_k")
    return out.drop("_k")


@register("""SELECT count(*) AS skills, count(DISTINCT skill_text) AS unique_skills, count(DISTINCT job_id) AS jobs_with_skills, count(CASE WHEN skill_type = 'hard' THEN 1 END) AS hard, count(CASE WHEN skill_type = 'soft' THEN 1 END) AS soft
FROM extracted_skills WHERE extraction_method IN ('ner', 'regex') AND job_id IN (SELECT job_id FROM raw_jobs WHERE country = 'AFRICA') AND job_id IN (SELECT job_id FROM cleaned_jobs)""")
def stats_filtered(spark: SparkSession, d: str) -> DataFrame:
    jobs = P.with_status(P.jobs(S.raw_jobs(spark, d), country="africa"), "cleaned", S.cleaned_jobs(spark, d))
    found = P.skills(S.extracted_skills(spark, d), method="pipeline_a").join(jobs.select("job_id"), "job_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("skills"), F.countDistinct("skill_text").alias("unique_skills"), F.countDistinct("job_id").alias("jobs_with_skills"), F.count_if(F.col("skill_type") == "hard").alias("hard"), F.count_if(F.col("skill_type") == "soft").alias("soft"))


@register("""SELECT r_name AS country, count(DISTINCT job_id) AS jobs, count(skill_text) AS skills, count(DISTINCT skill_text) AS unique_skills
FROM region LEFT JOIN (SELECT j.country, e.job_id, e.skill_text FROM raw_jobs j JOIN extracted_skills e USING (job_id) WHERE e.extraction_method = 'ner') ON country = r_name GROUP BY 1""")
def stats_by_country(spark: SparkSession, d: str) -> DataFrame:
    """One row for each known country, zeros included."""
    joined = S.raw_jobs(spark, d).select("job_id", "country").join(P.skills(S.extracted_skills(spark, d), method="ner").select("job_id", "skill_text"), "job_id")
    per = joined.groupBy("country").agg(F.countDistinct("job_id").alias("jobs"), F.count("skill_text").alias("skills"), F.countDistinct("skill_text").alias("unique_skills"))
    known = S.table(spark, d, "region").select(F.col("r_name").alias("country"))
    return known.join(per, "country", "left").na.fill(0, ["jobs", "skills", "unique_skills"])


@register("SELECT country, portal, count(*) AS n FROM raw_jobs GROUP BY CUBE (country, portal)")
def jobs_cube(spark: SparkSession, d: str) -> DataFrame:
    """All combinations that dashboards ask for one by one."""
    return S.raw_jobs(spark, d).cube("country", "portal").agg(F.count(F.lit(1)).alias("n"))


# -- jobs


@register("""SELECT job_id, title, company, country, portal FROM raw_jobs WHERE (title ILIKE '%mach%' OR location ILIKE '%mach%' OR company ILIKE '%mach%') AND portal = '2-high'
ORDER BY scraped_at DESC, job_id LIMIT 20 OFFSET 20""")
def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    found = P.jobs(S.raw_jobs(spark, d), portal="2-HIGH", search="mach")
    return found.orderBy(F.desc_nulls_last("scraped_at"), "job_id").offset(20).limit(20).select("job_id", "title", "company", "country", "portal")


@register("""SELECT job_id, title, (SELECT list_sort(list(skill_text)) FROM gold g WHERE g.job_id = j.job_id) AS manual, (SELECT list_sort(list(skill_text || ':' || extraction_method)) FROM extracted_skills e WHERE e.job_id = j.job_id) AS extracted,
 (SELECT list_sort(list(normalized_skill)) FROM enhanced_skills h WHERE h.job_id = j.job_id) AS enhanced FROM raw_jobs j WHERE job_id = 50""")
def job_detail(spark: SparkSession, d: str) -> DataFrame:
    """A job with its three arrays of skills."""
    at = F.col("job_id") == 50
    job = S.raw_jobs(spark, d).where(at).select("job_id", "title")
    manual = S.gold(spark, d).where(at).groupBy("job_id").agg(F.sort_array(F.collect_list("skill_text")).alias("manual"))
    extracted = S.extracted_skills(spark, d).where(at).groupBy("job_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", "skill_text", "extraction_method"))).alias("extracted"))
    enhanced = S.enhanced_skills(spark, d).where(at).groupBy("job_id").agg(F.sort_array(F.collect_list("normalized_skill")).alias("enhanced"))
    return job.join(manual, "job_id", "left").join(extracted, "job_id", "left").join(enhanced, "job_id", "left")


@register("SELECT job_id, title, posted_date FROM raw_jobs WHERE country = 'AMERICA' ORDER BY scraped_at DESC, job_id LIMIT 10")
def jobs_by_country(spark: SparkSession, d: str) -> DataFrame:
    return P.jobs(S.raw_jobs(spark, d), country="america").orderBy(F.desc_nulls_last("scraped_at"), "job_id").limit(10).select("job_id", "title", "posted_date")


@register("SELECT job_id, portal FROM raw_jobs WHERE extraction_status = 'pending' AND NOT is_processed AND is_usable AND job_id IN (SELECT job_id FROM cleaned_jobs) ORDER BY scraped_at, job_id LIMIT 100")
def extraction_queue(spark: SparkSession, d: str) -> DataFrame:
    """Oldest first."""
    ready = S.raw_jobs(spark, d).where("extraction_status = 'pending' and not is_processed and is_usable").join(S.cleaned_jobs(spark, d).select("job_id"), "job_id", "left_semi")
    return ready.orderBy("scraped_at", "job_id").limit(100).select("job_id", "portal")


@register("SELECT job_id, scraped_at FROM raw_jobs WHERE country = 'ASIA' AND scraped_at >= TIMESTAMP '2001-06-01' ORDER BY scraped_at DESC, job_id LIMIT 25")
def scrape_session(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).where("country = 'ASIA' and scraped_at >= timestamp '2001-06-01'").orderBy(F.desc("scraped_at"), "job_id").limit(25).select("job_id", "scraped_at")


@register("SELECT job_id, scraped_at FROM raw_jobs WHERE scraped_at >= TIMESTAMP '2001-07-31' - INTERVAL 24 HOUR AND scraped_at < TIMESTAMP '2001-07-31'")
def last_day_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 hours before a stated moment."""
    now = F.lit("2001-07-31").cast("timestamp")
    return S.raw_jobs(spark, d).where((F.col("scraped_at") >= now - F.expr("interval 24 hours")) & (F.col("scraped_at") < now)).select("job_id", "scraped_at")


# -- temporal


@register("""WITH q AS (SELECT year(posted_date) || '-Q' || quarter(posted_date) AS quarter, skill_text, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE year(posted_date) = 1998 GROUP BY ALL)
SELECT quarter, skill_text, n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY n DESC, skill_text) AS r FROM q) WHERE r <= 5""")
def quarter_top_skills(spark: SparkSession, d: str) -> DataFrame:
    return A.top_per_group(_by_quarter(spark, d, 1998), 5, ("quarter",), "n", "skill_text")


def _by_quarter(spark: SparkSession, d: str, year: int | None = None) -> DataFrame:
    jobs = P.jobs(S.raw_jobs(spark, d), year=year).select("job_id", A.quarter("posted_date").alias("quarter"))
    return A.counted(S.extracted_skills(spark, d).select("job_id", "skill_text").join(jobs, "job_id"), "quarter", "skill_text")


@register("""WITH q AS (SELECT 'Q' || quarter(posted_date) AS quarter, skill_text, count(*) AS n FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE year(posted_date) = 1998 GROUP BY ALL),
k AS (SELECT DISTINCT skill_text FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY n DESC, skill_text) AS r FROM q) WHERE r <= 5),
t AS (SELECT skill_text, sum(n) AS total FROM q JOIN k USING (skill_text) GROUP BY 1 ORDER BY total DESC, skill_text LIMIT 20)
SELECT skill_text, CAST(coalesce(sum(n) FILTER (quarter = 'Q1'), 0) AS BIGINT) AS q1, CAST(coalesce(sum(n) FILTER (quarter = 'Q2'), 0) AS BIGINT) AS q2, CAST(coalesce(sum(n) FILTER (quarter = 'Q3'), 0) AS BIGINT) AS q3, CAST(coalesce(sum(n) FILTER (quarter = 'Q4'), 0) AS BIGINT) AS q4
FROM q JOIN t USING (skill_text) GROUP BY 1""")
def quarter_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Skills of any quarter's top five, the 20 largest in total, by quarter with zeros."""
    q = _by_quarter(spark, d, 1998).withColumn("quarter", F.lower(F.substring("quarter", 6, 2)))
    any_top = A.top_per_group(q, 5, ("quarter",), "n", "skill_text").select("skill_text").distinct()
    totals = q.join(any_top, "skill_text", "left_semi").groupBy("skill_text").agg(F.sum("n").alias("total"))
    kept = A.top(totals, 20, "total", "skill_text").select("skill_text")
    return q.join(kept, "skill_text", "left_semi").groupBy("skill_text").pivot("quarter", ["q1", "q2", "q3", "q4"]).agg(F.sum("n")).na.fill(0)


@register("""SELECT year(posted_date) || '-Q' || quarter(posted_date) AS quarter, count(*) AS n, count(DISTINCT job_id) AS jobs FROM extracted_skills JOIN raw_jobs USING (job_id) WHERE skill_text ILIKE '%gear%' AND country = 'ASIA' GROUP BY 1""")
def skill_trend(spark: SparkSession, d: str) -> DataFrame:
    jobs = P.jobs(S.raw_jobs(spark, d), country="asia").select("job_id", A.quarter("posted_date").alias("quarter"))
    return P.skills(S.extracted_skills(spark, d), query="gear").join(jobs, "job_id").groupBy("quarter").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"))


@register("""SELECT year(posted_date) || 'Q' || quarter(posted_date) AS quarter_str, CAST(coalesce(sum(1) FILTER (l = 0), 0) AS BIGINT) AS c0, CAST(coalesce(sum(1) FILTER (l = 1), 0) AS BIGINT) AS c1, CAST(coalesce(sum(1) FILTER (l = 2), 0) AS BIGINT) AS c2, CAST(coalesce(sum(1) FILTER (l = -1), 0) AS BIGINT) AS noise
FROM extracted_skills JOIN raw_jobs USING (job_id) JOIN (SELECT label AS skill_text, CASE WHEN skill_id % 4 = 3 THEN -1 ELSE skill_id % 4 END AS l FROM esco_skills) USING (skill_text) GROUP BY 1""")
def cluster_quarter_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Quarter by cluster, the noise cluster last; skills without a cluster drop out."""
    cluster = F.when(F.col("skill_id") % 4 == 3, "noise").otherwise(F.concat(F.lit("c"), (F.col("skill_id") % 4).cast("string")))
    labels = S.esco_skills(spark, d).select(F.col("label").alias("skill_text"), cluster.alias("cluster"))
    jobs = S.raw_jobs(spark, d).select("job_id", A.quarter("posted_date", dash=False).alias("quarter_str"))
    rows = S.extracted_skills(spark, d).select("job_id", "skill_text").join(jobs, "job_id").join(labels, "skill_text")
    return rows.groupBy("quarter_str").pivot("cluster", ["c0", "c1", "c2", "noise"]).agg(F.count(F.lit(1))).na.fill(0)


@register("SELECT CAST(date_trunc('month', posted_date) AS DATE) AS month, portal, count(*) AS n FROM raw_jobs WHERE posted_date >= DATE '2000-01-01' GROUP BY 1, 2")
def monthly_jobs_by_portal(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.raw_jobs(spark, d).where("posted_date >= date '2000-01-01'").withColumn("month", F.trunc("posted_date", "month")), "month", "portal")


# -- views and table functions


@register("SELECT skill_text, count(*) AS frequency, count(DISTINCT job_id) AS job_count, count(DISTINCT country) AS country_count FROM extracted_skills JOIN raw_jobs USING (job_id) GROUP BY 1")
def skill_frequency_view(spark: SparkSession, d: str) -> DataFrame:
    joined = S.extracted_skills(spark, d).join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id")
    return joined.groupBy("skill_text").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("job_id").alias("job_count"), F.countDistinct("country").alias("country_count"))


@register("SELECT country, skill_text, count(*) AS frequency FROM extracted_skills JOIN raw_jobs USING (job_id) GROUP BY 1, 2")
def country_skill_distribution_view(spark: SparkSession, d: str) -> DataFrame:
    return A.counted(S.extracted_skills(spark, d).join(S.raw_jobs(spark, d).select("job_id", "country"), "job_id"), "country", "skill_text", name="frequency")


@register("""SELECT country, portal, count(*) AS total, count(CASE WHEN extraction_status = 'completed' THEN 1 END) AS extracted, count(CASE WHEN extraction_status = 'failed' THEN 1 END) AS extraction_failed,
 count(CASE WHEN enhancement_status = 'completed' THEN 1 END) AS enhanced, count(CASE WHEN enhancement_status = 'pending' THEN 1 END) AS enhancement_pending FROM raw_jobs GROUP BY 1, 2""")
def pipeline_status_overview(spark: SparkSession, d: str) -> DataFrame:
    when = lambda c, v: F.count_if(F.col(c) == v)
    return A.counted(S.raw_jobs(spark, d), "country", "portal", name="total", extracted=when("extraction_status", "completed"), extraction_failed=when("extraction_status", "failed"), enhanced=when("enhancement_status", "completed"), enhancement_pending=when("enhancement_status", "pending"))


@register("SELECT job_id, portal, country, combined_word_count FROM raw_jobs JOIN cleaned_jobs USING (job_id) WHERE is_usable AND extraction_status = 'pending'")
def extraction_ready(spark: SparkSession, d: str) -> DataFrame:
    return S.raw_jobs(spark, d).where("is_usable and extraction_status = 'pending'").join(S.cleaned_jobs(spark, d), "job_id").select("job_id", "portal", "country", "combined_word_count")


@register("""SELECT 'total_raw' AS metric, count(*) AS value FROM raw_jobs UNION ALL SELECT 'usable', count(*) FROM raw_jobs WHERE is_usable UNION ALL SELECT 'junk', count(*) FROM raw_jobs WHERE NOT is_usable
UNION ALL SELECT 'duplicates', count(*) FROM raw_jobs WHERE is_duplicate""")
def cleaning_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.metric_rows(S.raw_jobs(spark, d), total_raw=F.count(F.lit(1)), usable=F.count_if("is_usable"), junk=F.count_if(~F.col("is_usable")), duplicates=F.count_if("is_duplicate"))


@register("SELECT skill_group, string_agg(DISTINCT skill_type, ', ' ORDER BY skill_type) AS types, count(*) AS label_count FROM esco_skills GROUP BY 1")
def esco_search_view(spark: SparkSession, d: str) -> DataFrame:
    return S.esco_skills(spark, d).groupBy("skill_group").agg(F.concat_ws(", ", F.sort_array(F.collect_set("skill_type"))).alias("types"), F.count(F.lit(1)).alias("label_count"))


@register("SELECT source_uri, s.label AS source_label, target_uri, t.label AS target_label, relation_type FROM esco_relations JOIN esco_skills s ON source_uri = s.skill_uri JOIN esco_skills t ON target_uri = t.skill_uri")
def taxonomy_relations_view(spark: SparkSession, d: str) -> DataFrame:
    """The same dimension joined twice."""
    dim = S.esco_skills(spark, d)
    return S.esco_relations(spark, d).join(dim.select(F.col("skill_uri").alias("source_uri"), F.col("label").alias("source_label")), "source_uri").join(dim.select(F.col("skill_uri").alias("target_uri"), F.col("label").alias("target_label")), "target_uri").select("source_uri", "source_label", "target_uri", "target_label", "relation_type")


@register("SELECT target_uri AS skill_uri, label, relation_type FROM esco_relations JOIN esco_skills ON target_uri = skill_uri WHERE source_uri = 'uri:small ring' AND relation_type = 'broader'")
def taxonomy_related(spark: SparkSession, d: str) -> DataFrame:
    return related_skills(S.esco_relations(spark, d), S.esco_skills(spark, d), "uri:small ring", "broader")


def related_skills(relations: DataFrame, skills: DataFrame, uri: str, relation: str = "all") -> DataFrame:
    """One-hop neighbours of a skill; ``all`` takes every relation."""
    edges = relations.where(F.col("source_uri") == uri)
    if relation != "all":
        edges = edges.where(F.col("relation_type") == relation)
    return edges.select(F.col("target_uri").alias("skill_uri"), "relation_type").join(skills.select("skill_uri", "label"), "skill_uri").select("skill_uri", "label", "relation_type")


@register("""SELECT status, count(*) AS n, CAST(sum(CASE WHEN enhancement_status = 'completed' THEN 1 ELSE 0 END) AS BIGINT) AS enhanced, round(sum(CASE WHEN enhancement_status = 'completed' THEN 1 ELSE 0 END) * 100.0 / count(*), 2) AS completion_rate
FROM (SELECT extraction_status AS status, enhancement_status FROM raw_jobs) GROUP BY 1""")
def admin_extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    done = F.sum(F.when(F.col("enhancement_status") == "completed", 1).otherwise(0))
    return S.raw_jobs(spark, d).groupBy(F.col("extraction_status").alias("status")).agg(F.count(F.lit(1)).alias("n"), done.alias("enhanced"), F.round(done * 100.0 / F.count(F.lit(1)), 2).alias("completion_rate"))


@register("""SELECT completed, failed, total, CAST(CASE WHEN failed * 10 > total THEN greatest(0, 100 - failed * 100.0 / total) ELSE 100 END AS DOUBLE) AS health, round(hours, 4) AS span_hours FROM
(SELECT count(*) FILTER (extraction_status = 'completed') AS completed, count(*) FILTER (extraction_status = 'failed') AS failed, count(*) AS total, epoch(max(scraped_at) - min(scraped_at)) / 3600.0 AS hours FROM raw_jobs WHERE scraped_at >= TIMESTAMP '2001-07-01')""")
def pipeline_health(spark: SparkSession, d: str) -> DataFrame:
    """Failures above ten percent lower the score."""
    recent = S.raw_jobs(spark, d).where("scraped_at >= timestamp '2001-07-01'")
    got = recent.agg(F.count_if(F.col("extraction_status") == "completed").alias("completed"), F.count_if(F.col("extraction_status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"), F.round((F.unix_timestamp(F.max("scraped_at").cast("timestamp")) - F.unix_timestamp(F.min("scraped_at").cast("timestamp"))) / 3600.0, 4).cast("double").alias("span_hours"))
    return got.select("completed", "failed", "total", F.when(F.col("failed") * 10 > F.col("total"), F.greatest(F.lit(0.0), 100 - F.col("failed") * 100.0 / F.col("total"))).otherwise(100.0).cast("double").alias("health"), "span_hours")
