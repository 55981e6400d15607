"""Aggregates and rankings that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """Largest ``n`` with a stated order for ties; runs as one TakeOrdered."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(t) for t in ties]).limit(n)


def share(df: DataFrame, value: str, within: tuple[str, ...] = (), name: str = "percentage", digits: int = 2) -> DataFrame:
    """Percent of the total (within groups); the window runs over aggregated rows only."""
    over = Window.partitionBy(*within) if within else Window.partitionBy()
    return df.withColumn(name, F.round(F.col(value) * F.lit(100.0) / F.sum(value).over(over), digits))


def counted(df: DataFrame, *keys: str, name: str = "n", **more: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), *[c.alias(k) for k, c in more.items()])


def top_per_group(df: DataFrame, n: int, keys: tuple[str, ...], by: str, *ties: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_per_group(df: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """One row per key, the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def quarter(col: str | Column, dash: bool = True) -> Column:
    """``2025-Q2`` or ``2025Q2``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.year(c).cast("string"), F.lit("-Q" if dash else "Q"), F.quarter(c).cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metric_rows(df: DataFrame, **metrics: Column) -> DataFrame:
    """One pass over ``df``, a row (metric, value) for each aggregate."""
    one = df.agg(*[c.cast("long").alias(k) for k, c in metrics.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in metrics)
    return one.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def cooccurring(skills: DataFrame, job: str = "job_id", skill: str = "skill_text", least: int = 1) -> DataFrame:
    """Pairs of distinct skills per job: ``skill_1`` < ``skill_2``, ``n``. Pairs are made inside each job's set."""
    sets = skills.groupBy(job).agg(F.sort_array(F.collect_set(skill)).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    rows = sets.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("skill_1"), F.col("p.b").alias("skill_2")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= least)
