"""Reports on dictionaries, validation, experiments and the taxonomy's effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.functions import rules
from vacantia.operators import evaluate as E
from vacantia.operators import extract
from vacantia.plans import standins as S
from vacantia.plans.registry import register


def prompt(template: str, **values: Column) -> Column:
    """A template's ``{name}`` places filled from columns, whole."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, with three dots where something was left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def job_prompts(jobs: DataFrame, most: int | None = None) -> DataFrame:
    """``job_id``, ``prompt`` for every job; texts are whole unless ``most`` limits them."""
    text = F.col("company") if most is None else shortened(F.col("company"), most)
    return jobs.select("job_id", prompt("Title: {title}\nText: {text}", title=F.col("title"), text=text).alias("prompt"))


@register("""SELECT job_id, 'Title: ' || title || chr(10) || 'Text: ' || CASE WHEN length(company) > 12 THEN substr(company, 1, 12) || '...' ELSE company END AS prompt FROM raw_jobs WHERE job_id < 500""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """A preview: ids under 500 and short texts, as its SQL states; ``prompts_whole`` has every job."""
    return job_prompts(S.raw_jobs(spark, d).where("job_id < 500"), 12)


@register("SELECT job_id, 'Title: ' || title || chr(10) || 'Text: ' || company AS prompt FROM raw_jobs")
def prompts_whole(spark: SparkSession, d: str) -> DataFrame:
    return job_prompts(S.raw_jobs(spark, d))


@register("""WITH w AS (SELECT skill_id, string_split(lower(label), ' ') AS w FROM esco_skills), g AS (SELECT DISTINCT skill_id, unnest(list_concat(w, [array_to_string(w, ' ')])) AS ngram FROM w),
p AS (SELECT ngram, count(*) AS n FROM g WHERE length(ngram) >= 3 GROUP BY 1)
SELECT count(*) AS ngrams, round(avg(n), 4) AS mean_postings, CAST(median(n) AS DOUBLE) AS median_postings, max(n) AS max_postings FROM p""")
def dictionary_stats(spark: SparkSession, d: str) -> DataFrame:
    index = extract.ngram_dictionary(S.esco_skills(spark, d), most=2).withColumn("n", F.size("skills").cast("long"))
    return index.agg(F.count(F.lit(1)).alias("ngrams"), F.round(F.avg("n"), 4).alias("mean_postings"), F.median("n").cast("double").alias("median_postings"), F.max("n").alias("max_postings"))


@register("""WITH g AS (SELECT DISTINCT skill_id, unnest(string_split(lower(label), ' ')) AS ngram FROM esco_skills) SELECT ngram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, ngram LIMIT 10""")
def dictionary_top(spark: SparkSession, d: str) -> DataFrame:
    index = extract.ngram_dictionary(S.esco_skills(spark, d), most=1, least=1)
    return index.select("ngram", F.size("skills").cast("long").alias("n")).orderBy(F.desc("n"), "ngram").limit(10)


@register("""SELECT CASE WHEN length(trim(said)) < 2 THEN 'Too short' WHEN regexp_matches(said, '^\\d+\\s*-\\s*\\d+') THEN 'noise' ELSE 'valid' END AS outcome, count(*) AS n
FROM (SELECT CASE skill_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '3 - 5 ' || label ELSE label END AS said FROM esco_skills) GROUP BY 1""")
def validation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the skill validator over names with defects put in."""
    k = F.col("skill_id") % 4
    said = F.when(k == 0, "x").when(k == 1, F.concat(F.lit("3 - 5 "), "label")).otherwise(F.col("label"))
    v = S.esco_skills(spark, d).select(rules.llm_skill(said).alias("v"))
    outcome = F.when(F.col("v.is_valid"), "valid").when(F.startswith(F.col("v.reason"), F.lit("Matches noise")), "noise").otherwise(F.col("v.reason"))
    return v.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT max(TRY_CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT)) + 1 AS next_id FROM customer")
def next_sequence_id(spark: SparkSession, d: str) -> DataFrame:
    number = F.expr("try_cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint)")
    return S.table(spark, d, "customer").agg((F.max(number) + 1).alias("next_id"))


@register("SELECT skill_group, count(*) AS n FROM esco_skills GROUP BY 1 ORDER BY n DESC, skill_group LIMIT 15")
def taxonomy_groups(spark: SparkSession, d: str) -> DataFrame:
    return S.esco_skills(spark, d).groupBy("skill_group").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill_group").limit(15)


@register("""WITH c AS (SELECT skill_group, skill_type, count(*) AS n FROM esco_skills GROUP BY ALL) SELECT skill_group, skill_type AS most_frequent, n FROM (SELECT *, row_number() OVER (PARTITION BY skill_group ORDER BY n DESC, skill_type) AS r FROM c) WHERE r = 1""")
def group_modes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent type in each group; ties by name."""
    c = S.esco_skills(spark, d).groupBy("skill_group", "skill_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("skill_group").orderBy(F.desc("n"), "skill_type")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("skill_group", F.col("skill_type").alias("most_frequent"), "n")


def dual_comparison(gold: DataFrame, predicted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scores by skill type on plain text and after mapping to the taxonomy (unmapped skills drop out).

    gold, predicted: job_id, skill, skill_type; mapping: skill, uri. Sets are united over jobs.
    """
    out = None
    for kind in ("hard", "soft", "all"):
        g, p = (df if kind == "all" else df.where(F.col("skill_type") == kind) for df in (gold, predicted))
        to_uri = lambda df: df.join(mapping, "skill").where("uri is not null").select("job_id", F.col("uri").alias("skill"))
        for view, a, b in (("text", g, p), ("taxonomy", to_uri(g), to_uri(p))):
            row = E.of_union(a, b).select(F.lit(kind).alias("skill_type"), F.lit(view).alias("view"), "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
            out = row if out is None else out.unionByName(row)
    return out


def _dual_sql(gold: str, found: str) -> str:
    """``gold`` and ``found``: conditions on the gold rows and on the predictions."""
    parts = []
    for kind, where in (("hard", "WHERE skill_type = 'hard'"), ("soft", "WHERE skill_type = 'soft'"), ("all", "")):
        for view, skill in (("text", "skill"), ("taxonomy", "uri")):
            src = lambda t, s=skill, w=where: f"SELECT DISTINCT {s} AS x FROM {t} {'JOIN m USING (skill)' if s == 'uri' else ''} {w} {('AND' if w else 'WHERE') + ' uri IS NOT NULL' if s == 'uri' else ''}"
            parts.append(f"SELECT '{kind}' AS skill_type, '{view}' AS view, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS tp, count(*) FILTER (a.x IS NULL) AS fp, count(*) FILTER (b.x IS NULL) AS fn FROM ({src('g')}) a FULL JOIN ({src('p')}) b ON a.x = b.x")
    body = " UNION ALL ".join(parts)
    return f"""WITH g AS (SELECT job_id, skill_text AS skill, skill_type FROM gold{gold}), p AS (SELECT job_id, skill_text AS skill, skill_type FROM extracted_skills WHERE extraction_method = 'regex' AND {found}),
m AS (SELECT label AS skill, CASE WHEN skill_id % 4 <> 0 THEN skill_group END AS uri FROM esco_skills)
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) ELSE 0 END AS f1 FROM ({body})"""


def dual_of(spark: SparkSession, d: str, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    named = [df.select("job_id", F.col("skill_text").alias("skill"), "skill_type") for df in (gold, predicted.where("extraction_method = 'regex'"))]
    mapping = S.esco_skills(spark, d).select(F.col("label").alias("skill"), F.when(F.col("skill_id") % 4 != 0, F.col("skill_group")).alias("uri"))
    return dual_comparison(*named, mapping)


@register(_dual_sql(" WHERE job_id % 200 = 0", "job_id % 200 = 0"))
def dual_pipeline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """One in 20 of the annotated jobs, as its SQL states; ``dual_pipeline_whole`` has all of them."""
    sample = "job_id % 200 = 0"
    return dual_of(spark, d, S.gold(spark, d).where(sample), S.extracted_skills(spark, d).where(sample))


@register(_dual_sql("", "job_id IN (SELECT job_id FROM gold)"))
def dual_pipeline_whole(spark: SparkSession, d: str) -> DataFrame:
    """All annotated jobs; predictions count where a job is annotated."""
    gold = S.gold(spark, d)
    return dual_of(spark, d, gold, S.extracted_skills(spark, d).join(gold.select("job_id").distinct(), "job_id", "left_semi"))


@register("""WITH r AS (SELECT llm_model AS model, CAST(tokens_used // 10 AS INT) AS setting, avg(llm_confidence) AS quality, avg(processing_time_seconds) AS seconds, count(*) AS n FROM enhanced_skills GROUP BY ALL)
SELECT setting, round(avg(quality), 6) AS quality, round(avg(seconds), 6) AS seconds, CAST(sum(n) AS BIGINT) AS n, round(0.4 * avg(quality) + 0.3 * (1 / (1 + avg(seconds))) + 0.2 * min(quality) + 0.1 * max(quality), 6) AS score FROM r GROUP BY 1""")
def experiment_trends(spark: SparkSession, d: str) -> DataFrame:
    """Runs averaged by a setting, with a weighted score."""
    runs = S.enhanced_skills(spark, d).groupBy("llm_model", F.expr("cast(tokens_used div 10 as int)").alias("setting")).agg(F.avg("llm_confidence").alias("q"), F.avg("processing_time_seconds").alias("s"), F.count(F.lit(1)).alias("k"))
    score = 0.4 * F.avg("q") + 0.3 / (1 + F.avg("s")) + 0.2 * F.min("q") + 0.1 * F.max("q")
    return runs.groupBy("setting").agg(F.round(F.avg("q"), 6).alias("quality"), F.round(F.avg("s"), 6).alias("seconds"), F.sum("k").alias("n"), F.round(score, 6).alias("score"))
