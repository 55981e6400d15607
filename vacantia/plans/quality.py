"""Evaluation against the gold standard, set relations and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import evaluate as E
from vacantia.operators import selection as X
from vacantia.plans import standins as S
from vacantia.plans.registry import register


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return S.gold(spark, d).select("job_id", F.col("skill_text").alias("skill"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """What the regex method found in annotated jobs."""
    rows = S.extracted_skills(spark, d).where("extraction_method = 'regex' and job_id % 10 = 0")
    return rows.select("job_id", F.col("skill_text").alias("skill"))


_SETS = """WITH g AS (SELECT DISTINCT job_id, skill_text AS skill FROM gold), p AS (SELECT DISTINCT job_id, skill_text AS skill FROM extracted_skills WHERE extraction_method = 'regex' AND job_id % 10 = 0),
c AS (SELECT coalesce(g.job_id, p.job_id) AS job_id, coalesce(g.skill, p.skill) AS skill, g.skill IS NOT NULL AS in_g, p.skill IS NOT NULL AS in_p FROM g FULL JOIN p ON g.job_id = p.job_id AND g.skill = p.skill),
u AS (SELECT skill, bool_or(in_g) AS in_g, bool_or(in_p) AS in_p FROM c GROUP BY 1)"""
_COUNTS = "count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g AND in_p) AS fp, count(*) FILTER (in_g AND NOT in_p) AS fn"
_SCORES = """*, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE ELSE 0 END AS accuracy, tp + fn AS support, tp + fp AS predicted_count"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _round_sql(keys: str, body: str) -> str:
    return f"{_SETS}, s AS (SELECT {_SCORES} FROM ({body})) SELECT {keys} tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, support, predicted_count FROM s"


@register(_round_sql("job_id,", f"SELECT job_id, {_COUNTS} FROM c GROUP BY 1"))
def prf_per_job(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.per_job(_gold(spark, d), _found(spark, d)))


@register(_round_sql("", f"SELECT {_COUNTS} FROM u"))
def prf_global(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.of_union(_gold(spark, d), _found(spark, d)))


@register(_round_sql("", f"SELECT {_COUNTS} FROM c"))
def prf_micro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.micro(_gold(spark, d), _found(spark, d)))


@register(f"{_SETS}, s AS (SELECT {_SCORES} FROM (SELECT job_id, {_COUNTS} FROM c GROUP BY 1)) SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(accuracy), 6) AS accuracy, count(*) AS jobs FROM s")
def prf_macro(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.macro(_gold(spark, d), _found(spark, d)))


@register(f"{_SETS}, s AS (SELECT job_id, {_SCORES} FROM (SELECT job_id, {_COUNTS} FROM c GROUP BY 1)) SELECT * FROM (SELECT 'best' AS side, job_id, round(f1, 6) AS f1 FROM s ORDER BY s.f1 DESC, job_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'worst', job_id, round(f1, 6) AS f1 FROM s ORDER BY s.f1, job_id LIMIT 5)")
def best_and_worst_jobs(spark: SparkSession, d: str) -> DataFrame:
    per = E.per_job(_gold(spark, d), _found(spark, d)).select("job_id", F.round("f1", 6).alias("f1"))
    best, worst = per.orderBy(F.desc("f1"), "job_id").limit(5), per.orderBy("f1", "job_id").limit(5)
    return best.select(F.lit("best").alias("side"), "job_id", "f1").union(worst.select(F.lit("worst"), "job_id", "f1"))


@register("""WITH s AS (SELECT DISTINCT llm_model, normalized_skill, job_id FROM enhanced_skills), i AS (SELECT llm_model, job_id || ':' || normalized_skill AS skill FROM s), n AS (SELECT llm_model, count(*) AS n FROM i GROUP BY 1),
c AS (SELECT a.llm_model AS model_1, b.llm_model AS model_2, count(*) AS common FROM i a JOIN i b ON a.skill = b.skill AND a.llm_model < b.llm_model GROUP BY 1, 2)
SELECT model_1, model_2, common, x.n AS n_1, y.n AS n_2, round(common / (x.n + y.n - common)::DOUBLE, 6) AS jaccard FROM c JOIN n x ON x.llm_model = model_1 JOIN n y ON y.llm_model = model_2""")
def model_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = S.enhanced_skills(spark, d).select(F.col("llm_model").alias("model"), F.concat_ws(":", "job_id", "normalized_skill").alias("skill"))
    return _rounded(E.overlaps(rows))


@register("""WITH o AS (SELECT label AS skill, CASE WHEN skill_id % 3 <> 0 THEN skill_uri END AS uri FROM esco_skills), n AS (SELECT label AS skill, CASE WHEN skill_id % 4 = 1 THEN skill_uri || '/new' WHEN skill_id % 5 <> 0 THEN skill_uri END AS uri FROM esco_skills)
SELECT count(*) AS total, count(*) FILTER (o.uri = n.uri) AS same, count(*) FILTER (o.uri IS NOT NULL AND n.uri IS NULL) AS lost, count(*) FILTER (o.uri IS NULL AND n.uri IS NOT NULL) AS gained, count(*) FILTER (o.uri <> n.uri) AS changed,
 round(count(o.uri) * 100.0 / count(*), 2) AS old_coverage, round(count(n.uri) * 100.0 / count(*), 2) AS new_coverage FROM o FULL JOIN n USING (skill)""")
def mapping_audit(spark: SparkSession, d: str) -> DataFrame:
    known, k = S.esco_skills(spark, d), F.col("skill_id")
    old = known.select(F.col("label").alias("skill"), F.when(k % 3 != 0, F.col("skill_uri")).alias("uri"))
    new = known.select(F.col("label").alias("skill"), F.when(k % 4 == 1, F.concat("skill_uri", F.lit("/new"))).when(k % 5 != 0, F.col("skill_uri")).alias("uri"))
    return E.mapping_audit(old, new)


@register("""WITH f AS (SELECT job_id, lower(skill_text) AS skill, bool_or(extraction_method = 'regex') AS a, bool_or(extraction_method = 'ner') AS b FROM extracted_skills WHERE extraction_method IN ('regex', 'ner') GROUP BY 1, 2),
r AS (SELECT coalesce(a, false) AS a, coalesce(b, false) AS b FROM (SELECT DISTINCT job_id, lower(skill_text) AS skill FROM gold) LEFT JOIN f USING (job_id, skill))
SELECT count(*) AS gold, count(*) FILTER (a AND NOT b) AS regex_only, count(*) FILTER (b AND NOT a) AS ner_only, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS missing FROM r""")
def recall_by_method(spark: SparkSession, d: str) -> DataFrame:
    found = S.extracted_skills(spark, d).select("job_id", F.col("skill_text").alias("skill"), F.col("extraction_method").alias("method"))
    return E.recall_by_method(_gold(spark, d), found)


_PAIRS = "SELECT job_id, skill_text AS skill FROM gold {op} SELECT job_id, skill_text FROM extracted_skills WHERE extraction_method = 'regex' AND job_id % 10 = 0"


@register(_PAIRS.format(op="INTERSECT"))
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    """True positives."""
    return _gold(spark, d).intersect(_found(spark, d))


@register(_PAIRS.format(op="EXCEPT"))
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """False negatives."""
    return _gold(spark, d).subtract(_found(spark, d))


@register(_PAIRS.format(op="UNION"))
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).union(_found(spark, d)).distinct()


@register("SELECT content_hash, job_id, title FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY posted_date DESC, job_id) AS r FROM raw_jobs) WHERE r = 1")
def distinct_on_hash(spark: SparkSession, d: str) -> DataFrame:
    return X.distinct_on(S.raw_jobs(spark, d), "content_hash", F.desc("posted_date"), F.asc("job_id")).select("content_hash", "job_id", "title")


@register("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def longest_per_source(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").withColumn("key", F.concat_ws("|", "source", "lang"))
    return X.longest_per_key(docs, "key", "text", "doc_id").select("source", "doc_id", "n_chars")


@register("""WITH c AS (SELECT country AS grp, portal AS role, salary AS score, job_id AS id FROM raw_jobs WHERE is_usable), q AS (SELECT *, row_number() OVER (PARTITION BY grp, role ORDER BY score DESC, id) AS r FROM c),
m AS (SELECT *, r <= CASE role WHEN '1-urgent' THEN 8 WHEN '2-high' THEN 5 ELSE 0 END AS by_quota FROM q), f AS (SELECT *, sum(by_quota::INT) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp, by_quota ORDER BY score DESC, id) AS k FROM m)
SELECT grp, role, score, id, CASE WHEN by_quota THEN 1 ELSE 2 END AS pass FROM f WHERE by_quota OR k <= 20 - n""")
def quota_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = S.raw_jobs(spark, d).where("is_usable").select(F.col("country").alias("grp"), F.col("portal").alias("role"), F.col("salary").alias("score"), F.col("job_id").alias("id"))
    countries = S.table(spark, d, "region").select(F.col("r_name").alias("grp"))
    quotas = countries.select("grp", F.explode(F.create_map(F.lit("1-urgent"), F.lit(8), F.lit("2-high"), F.lit(5))).alias("role", "quota"))
    return X.quota_selection(rows, quotas, countries.withColumn("total", F.lit(20)))


@register("SELECT job_id, CAST(ntile(7) OVER (ORDER BY job_id) AS INT) AS worker FROM raw_jobs")
def worker_ranges(spark: SparkSession, d: str) -> DataFrame:
    return X.worker_ranges(S.raw_jobs(spark, d).select("job_id"), "job_id", 7)


@register("""SELECT lower(skill_text) AS skill, count(*) AS n, round(count(DISTINCT job_id) / 300.0 * 100, 2) AS coverage FROM extracted_skills GROUP BY 1 HAVING count(*) > 1""")
def skill_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = S.extracted_skills(spark, d).groupBy(F.lower("skill_text").alias("skill"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.countDistinct("job_id") / F.lit(300.0) * 100, 2).alias("coverage")).where("n > 1")


@register("""WITH p AS (SELECT skill_text, count(*) AS n FROM extracted_skills GROUP BY 1)
SELECT count(*) AS count, round(avg(n), 4) AS mean, CAST(median(n) AS DOUBLE) AS median, round(stddev_pop(n), 4) AS std, min(n) AS min, max(n) AS max, round(stddev_samp(n), 4) AS sample_std, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM p""")
def frequency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Population and sample deviation, and the upper median (no interpolation)."""
    per = S.extracted_skills(spark, d).groupBy("skill_text").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("n"), 4).alias("mean"), F.median("n").cast("double").alias("median"), F.round(F.stddev_pop("n"), 4).alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), F.round(F.stddev_samp("n"), 4).alias("sample_std"), F.element_at(F.sort_array(F.collect_list("n")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("upper_median"))


@register("""WITH m AS (SELECT llm_model, count(*) AS n, avg(processing_time_seconds) AS s, avg(llm_confidence) AS c FROM enhanced_skills GROUP BY 1)
SELECT llm_model, n, rank() OVER (ORDER BY s) AS speed_rank, rank() OVER (ORDER BY c DESC) AS quality_rank, round(0.4 * c + 0.3 * (1 / s) + 0.2 * 1 + 0.1 * 1, 6) AS score FROM m""")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A handful of models, so one window task ranks them all."""
    from pyspark.sql import Window

    m = S.enhanced_skills(spark, d).groupBy("llm_model").agg(F.count(F.lit(1)).alias("n"), F.avg("processing_time_seconds").alias("s"), F.avg("llm_confidence").alias("c"))
    return m.select("llm_model", "n", F.rank().over(Window.orderBy("s")).alias("speed_rank"), F.rank().over(Window.orderBy(F.desc("c"))).alias("quality_rank"), F.round(0.4 * F.col("c") + 0.3 / F.col("s") + 0.2 + 0.1, 6).alias("score"))
