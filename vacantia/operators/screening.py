"""Screening of jobs and extracted skills: titles, generic roles, replacements, garbage, ordered duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.rules import has_any

# The title words of the annotated selection.
TECH_TITLES = ("developer", "engineer", "desarrollador", "ingeniero", "programador", "devops", "data scien", "scientist", "qa", "frontend", "backend", "mobile")
OTHER_TITLES = ("manager", "director", "gerente", "coordinator", "coordinador", "business analyst", "analista de negocio", "bi engineer", "business intelligence", "mechanical", "chemical", "civil engineer", "support engineer", "help desk", "scrum master", "product manager", "project manager")
GENERIC_TITLES = ("ingeniero de sistemas", "ingeniero", "developer", "engineer", "desarrollador", "programador", "software engineer")
PREFIX_MARKS = ",;:+·•-"


def wanted_title(title: Column, wanted: tuple[str, ...] = TECH_TITLES, unwanted: tuple[str, ...] = OTHER_TITLES) -> Column:
    """A wanted word (or ``full`` before ``stack``) and no unwanted one."""
    low = F.lower(title)
    return (has_any(low, wanted) | low.like("%full%stack%")) & ~has_any(low, unwanted)


def long_enough(least: int, *parts: Column) -> Column:
    return sum((F.length(F.coalesce(p, F.lit(""))) for p in parts), F.lit(0)) > least


def specific(title: Column, role: Column, score: Column, least: int = 95, generic: tuple[str, ...] = GENERIC_TITLES) -> Column:
    """No generic title; the role ``other`` only with a score of ``least`` or more."""
    return ~F.lower(F.trim(title)).isin(*generic) & ((role != "other") | (score >= least))


def replacements(wanted: DataFrame, jobs: DataFrame, excluded: DataFrame, n: int = 10, keys: tuple[str, ...] = ("country", "language")) -> DataFrame:
    """For each row of ``wanted`` (``keys``) the ``n`` longest jobs (``job_id``, ``size``) that aren't excluded; ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "job_id")
    free = jobs.join(excluded.select("job_id").distinct(), "job_id", "left_anti").join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def garbage(skill: Column, stopwords: tuple[str, ...] = (), acronyms: tuple[str, ...] = ()) -> Column:
    """Rules in order: stop word; two characters or fewer unless an acronym; a number; no letter or digit; a leading mark."""
    low = F.lower(F.trim(skill))
    short = F.length(skill) <= 2
    out = F.when(low.isin(*stopwords), True) if stopwords else F.when(F.lit(False), True)
    out = out.when(short, ~F.upper(F.trim(skill)).isin(*[a.upper() for a in acronyms]) if acronyms else F.lit(True))
    out = out.when(F.regexp_replace(skill, "[ .]", "").rlike("^[0-9]+$"), True).when(~skill.rlike(r"[\p{L}\p{N}]"), True)
    return out.when(F.contains(F.lit(PREFIX_MARKS), F.substring(skill, 1, 1)), True).otherwise(False)


def distinct_in_order(items: Column) -> Column:
    """The first of each group of items that are equal in lower case, in their order."""
    low = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``keys``, ``n`` and ``median``: the value at place n div 2 (from 0) in order. Counts of values are ranked, not rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*keys)
    upto = counts.withColumn("_u", F.sum("_c").over(over.orderBy("_v"))).withColumn("n", F.sum("_c").over(over))
    return upto.where(F.col("_u") > F.expr("n div 2")).groupBy(*keys, "n").agg(F.min("_v").alias("median"))
