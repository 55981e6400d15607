"""Evaluation of predicted skills against a gold standard, as set relations (job_id, skill)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators.aggregates import ratio


def confusion(gold: DataFrame, predicted: DataFrame, keys: tuple[str, ...] = ("job_id", "skill")) -> DataFrame:
    """One row for each key in either set with ``in_gold`` and ``in_predicted``; repeated rows count once."""
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    return g.join(p, list(keys), "full").select(*keys, F.col("g").isNotNull().alias("in_gold"), F.col("p").isNotNull().alias("in_predicted"))


def _counts() -> list[Column]:
    g, p = F.col("in_gold"), F.col("in_predicted")
    return [F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")]


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy (no true negatives); 0 where a denominator is 0."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    rows = counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("accuracy", ratio(tp, tp + fp + fn)).withColumn("support", F.col("tp") + F.col("fn")).withColumn("predicted_count", F.col("tp") + F.col("fp"))


def per_job(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return scores(confusion(gold, predicted).groupBy("job_id").agg(*_counts()))


def of_union(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores of the skill sets united over all jobs, so a skill found in the wrong job counts as found."""
    return scores(confusion(gold, predicted, ("skill",)).agg(*_counts()))


def micro(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores of the counts summed over (job, skill) pairs."""
    return scores(confusion(gold, predicted).agg(*_counts()))


def macro(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(c)
    return per_job(gold, predicted).agg(mean("precision"), mean("recall"), mean("f1"), mean("accuracy"), F.count(F.lit(1)).alias("jobs"))


def overlaps(rows: DataFrame, model: str = "model", item: str = "skill") -> DataFrame:
    """Jaccard similarity of the item sets of each pair of models."""
    sets = rows.select(model, item).distinct()
    sizes = sets.groupBy(model).agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.withColumnRenamed(model, "model_1"), sets.withColumnRenamed(model, "model_2")
    common = a.join(b, item).where("model_1 < model_2").groupBy("model_1", "model_2").agg(F.count(F.lit(1)).alias("common"))
    left, right = sizes.select(F.col(model).alias("model_1"), F.col("n").alias("n_1")), sizes.select(F.col(model).alias("model_2"), F.col("n").alias("n_2"))
    return common.join(left, "model_1").join(right, "model_2").withColumn("jaccard", F.col("common") / (F.col("n_1") + F.col("n_2") - F.col("common")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of each score between two single-row results."""
    names = ("precision", "recall", "f1")
    b, a = before.select(*[F.col(n).alias(f"{n}_before") for n in names], F.lit(1).alias("_k")), after.select(*[F.col(n).alias(f"{n}_after") for n in names], F.lit(1).alias("_k"))
    return b.join(a, "_k").select(*[c for n in names for c in (F.col(f"{n}_before"), F.col(f"{n}_after"), (F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"{n}_delta"))])


def mapping_audit(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new mapping of each skill compared: same, lost, gained, changed, and both coverages in percent."""
    both = old.select("skill", F.col("uri").alias("o")).join(new.select("skill", F.col("uri").alias("n")), "skill", "full")
    o, n = F.col("o"), F.col("n")
    total = F.count(F.lit(1))
    return both.agg(total.alias("total"), F.count_if(o.isNotNull() & (o == n)).alias("same"), F.count_if(o.isNotNull() & n.isNull()).alias("lost"), F.count_if(o.isNull() & n.isNotNull()).alias("gained"), F.count_if(o.isNotNull() & n.isNotNull() & (o != n)).alias("changed"), F.round(F.count(o) * 100.0 / total, 2).alias("old_coverage"), F.round(F.count(n) * 100.0 / total, 2).alias("new_coverage"))


def recall_by_method(gold: DataFrame, by_method: DataFrame, first: str = "regex", second: str = "ner") -> DataFrame:
    """Gold skills found by one method only, by the other only, by both or by none."""
    found = by_method.where(F.col("method").isin(first, second)).groupBy("job_id", F.lower("skill").alias("skill")).agg(F.bool_or(F.col("method") == first).alias("a"), F.bool_or(F.col("method") == second).alias("b"))
    rows = gold.select("job_id", F.lower("skill").alias("skill")).distinct().join(found, ["job_id", "skill"], "left").na.fill(False, ["a", "b"])
    a, b = F.col("a"), F.col("b")
    return rows.agg(F.count(F.lit(1)).alias("gold"), F.count_if(a & ~b).alias(f"{first}_only"), F.count_if(~a & b).alias(f"{second}_only"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("missing"))
