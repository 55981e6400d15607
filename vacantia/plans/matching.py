"""Plans that match skills to the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators import match as M
from vacantia.plans import standins as S
from vacantia.plans.registry import register


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with an even first id are in the taxonomy; the others are what texts hold."""
    return S.esco_skills(spark, d).where("skill_id % 2 = 0").select("skill_uri", "label")


def _skills(spark: SparkSession, d: str) -> DataFrame:
    """Names as they are, without their first letter, and their last word alone."""
    names = S.esco_skills(spark, d).select("label", "skill_id")
    word = F.element_at(F.split("label", " "), -1)
    return names.select(F.when(F.col("skill_id") % 3 == 0, F.upper("label")).when(F.col("skill_id") % 3 == 1, F.expr("substring(label, 2)")).otherwise(word).alias("skill")).distinct()


_TAX = "t AS (SELECT skill_uri, label, lower(label) AS key FROM esco_skills WHERE skill_id % 2 = 0), s AS (SELECT DISTINCT CASE skill_id % 3 WHEN 0 THEN upper(label) WHEN 1 THEN substr(label, 2) ELSE split_part(label, ' ', -1) END AS skill FROM esco_skills)"


@register(f"WITH {_TAX} SELECT skill, min(skill_uri) AS skill_uri, min(label) AS label, 1.0::DOUBLE AS confidence, 'exact' AS method FROM s JOIN t ON lower(trim(skill)) = key GROUP BY skill")
def taxonomy_exact(spark: SparkSession, d: str) -> DataFrame:
    return M.exact(_skills(spark, d), _taxonomy(spark, d))


_LADDER = "CASE WHEN starts_with(key, k || ' ') OR starts_with(key, k || '(') THEN 0.95 WHEN list_contains(w, k) THEN CASE WHEN w[1] = k THEN 0.92 ELSE 0.88 END WHEN contains(' ' || key || ' ', ' ' || k || ' ') THEN 0.85 WHEN starts_with(key, k) THEN 0.87 WHEN contains(key, k) THEN 0.80 ELSE 0 END"


@register(f"""WITH {_TAX}, c AS (SELECT skill, skill_uri, label, {_LADDER} AS confidence, starts_with(key, k)::INT AS starts FROM (SELECT *, lower(skill) AS k, string_split(key, ' ') AS w FROM s JOIN t ON contains(key, lower(skill)) WHERE length(skill) >= 3))
SELECT skill, skill_uri, label, CAST(confidence AS DOUBLE) AS confidence, 'substring' AS method FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY confidence DESC, starts DESC, skill_uri, label) AS r FROM c WHERE confidence >= 0.85) WHERE r = 1""")
def taxonomy_substring(spark: SparkSession, d: str) -> DataFrame:
    return M.substring(_skills(spark, d), _taxonomy(spark, d))


@register(f"WITH {_TAX}, x AS (SELECT lower(skill) AS a FROM s GROUP BY 1) SELECT a, key AS b, CAST(levenshtein(a, key) AS INT) AS distance FROM x JOIN t ON abs(length(a) - length(key)) <= 1 WHERE levenshtein(a, key) <= 1")
def taxonomy_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    left = _skills(spark, d).select(F.lower("skill").alias("s")).distinct()
    return M.edit_join(left, _taxonomy(spark, d).select(F.lower("label").alias("s")).distinct(), 1)


@register(f"WITH {_TAX}, x AS (SELECT lower(skill) AS a FROM s GROUP BY 1) SELECT a, key AS b FROM x JOIN t ON contains(key, a) WHERE a <> key AND length(a) >= 5 AND length(a) >= 0.7 * length(key)")
def taxonomy_contained(spark: SparkSession, d: str) -> DataFrame:
    left = _skills(spark, d).select(F.lower("skill").alias("s")).distinct()
    return M.contained(left, _taxonomy(spark, d).select(F.lower("label").alias("s")).distinct())


def _trigram_sql(col: str) -> str:
    return f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN string_split({col}, ' ')]))"


@register(f"""WITH t AS (SELECT skill_uri, label, lower(label) AS key FROM esco_skills), g AS (SELECT *, {_trigram_sql('key')} AS x, {_trigram_sql("'red ring'")} AS y FROM t),
c AS (SELECT skill_uri, label, greatest(CASE WHEN key = 'red ring' THEN 1.0 ELSE 0.0 END, CASE WHEN contains(key, 'red ring') THEN 0.8 ELSE 0.0 END, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE) AS c FROM g)
SELECT skill_uri, label, round(c::DOUBLE, 6) AS confidence FROM c WHERE c > 0.2""")
def taxonomy_trigram(spark: SparkSession, d: str) -> DataFrame:
    found = M.search(S.esco_skills(spark, d).select("skill_uri", "label"), "Red ring", 0.2)
    return found.withColumn("confidence", F.round("confidence", 6))


@register()
def taxonomy_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return M.fuzzy(_skills(spark, d), _taxonomy(spark, d), 0.86, 0.92)


@register()
def taxonomy_layers(spark: SparkSession, d: str) -> DataFrame:
    mapping = S.esco_skills(spark, d).where("skill_id % 5 = 0").select(F.element_at(F.split("label", " "), -1).alias("skill"), F.element_at(F.split("label", " "), -1).alias("target")).distinct().withColumn("confidence", F.lit(0.9))
    return M.layered(_skills(spark, d), _taxonomy(spark, d), mapping, enhanced=True)


@register()
def taxonomy_coverage(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage(M.layered(_skills(spark, d), _taxonomy(spark, d)))
