"""Selection and ranking of rows: quotas, ranges, longest or best per key, samples, non-overlapping matches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.operators.aggregates import first_per_group


def distinct_on(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in a stated order."""
    return first_per_group(df, (key,), *order)


def longest_per_key(df: DataFrame, key: str, text: str, tie: str) -> DataFrame:
    return first_per_group(df, (key,), F.desc(F.length(text)), F.asc(tie))


def quota_selection(candidates: DataFrame, quotas: DataFrame, totals: DataFrame, group: str = "grp", role: str = "role", score: str = "score", tie: str = "id") -> DataFrame:
    """Best rows of each role up to its quota, then the best others until the group's total is reached.

    ``quotas``: group, role, quota; ``totals``: group, total. ``pass`` says whether a row came by quota (1) or filled up (2).
    """
    best = F.row_number().over(Window.partitionBy(group, role).orderBy(F.desc(score), tie))
    ranked = candidates.withColumn("_r", best).join(F.broadcast(quotas), [group, role], "left").join(F.broadcast(totals), group)
    by_quota = F.coalesce(F.col("_r") <= F.col("quota"), F.lit(False))
    ranked = ranked.withColumn("_q", by_quota).withColumn("_n", F.sum(F.col("_q").cast("int")).over(Window.partitionBy(group)))
    fill = F.row_number().over(Window.partitionBy(group, "_q").orderBy(F.desc(score), tie))
    chosen = ranked.withColumn("_f", fill).where(F.col("_q") | (F.col("_f") <= F.col("total") - F.col("_n")))
    return chosen.withColumn("pass", F.when(F.col("_q"), 1).otherwise(2)).drop("_r", "_q", "_n", "_f", "quota", "total")


def worker_ranges(df: DataFrame, order: str, workers: int) -> DataFrame:
    """Rows in order dealt to ``workers`` consecutive ranges; the first ranges take the remainder.

    Ranks come from sorted partitions and their sizes, so no task holds all rows.
    """
    spread = df.repartitionByRange(order).withColumn("_b", F.spark_partition_id())
    sizes = spread.groupBy("_b").agg(F.count(F.lit(1)).alias("_s"))
    starts = sizes.withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_t", F.sum("_s").over(Window.partitionBy()))
    rank = F.col("_o") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    rows = spread.join(F.broadcast(starts), "_b").withColumn("_k", rank)
    size, extra = F.expr(f"_t div {workers}"), F.expr(f"_t % {workers}")
    edge = extra * (size + 1)
    worker = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (size + 1))).otherwise(extra + F.floor((F.col("_k") - edge) / F.greatest(size, F.lit(1))))
    return rows.withColumn("worker", (worker + 1).cast("int")).drop("_b", "_s", "_o", "_t", "_k")


def hash_workers(df: DataFrame, key: str, workers: int) -> DataFrame:
    """A worker for each row by its key's hash; never negative."""
    return df.withColumn("worker", F.pmod(F.xxhash64(key), F.lit(workers)).cast("int"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a hash of the key: the same rows in each run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def non_overlapping(matches: DataFrame, doc: str = "doc_id", start: str = "start", end: str = "end", size: str = "size") -> DataFrame:
    """Greedy choice per document: larger matches first, then earlier ones; a match that meets a chosen one goes.

    Rows are dealt by document and sorted, then streamed: no document is held as a whole but for the places taken.
    Matches of one span go by their other columns in order.
    """
    others = [c for c, kind in matches.dtypes if c not in (doc, start, end, size) and not kind.startswith(("map", "variant"))]
    rows = matches.repartition(doc).sortWithinPartitions(doc, F.desc(size), start, end, *others)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, taken = object(), set()
        for batch in batches:
            keep = []
            for d, a, z in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (doc, start, end)), strict=True):
                if d != of:
                    of, taken = d, set()
                span = range(a, z + 1)
                keep.append(taken.isdisjoint(span))
                if keep[-1]:
                    taken.update(span)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(choose, matches.schema)


def drop_contained(candidates: DataFrame, doc: str = "doc_id", ngram: str = "ngram") -> DataFrame:
    """Candidates (of three words at most) that are no substring, with all their words, of another of the document.

    Each candidate names what it could contain: the one to three of its own words, in any order, that are a
    substring of it; these are taken away as a set, without pairs of candidates. A group is the candidates of
    one document.
    """
    rows = candidates.groupBy(doc).agg(F.collect_list(F.struct(*[c for c in candidates.columns if c != doc])).alias("_all"))

    def inner(o: Column) -> Column:
        w = F.array_distinct(F.split(o, " "))
        two = F.flatten(F.transform(w, lambda a: F.transform(w, lambda b: F.concat_ws(" ", a, b))))
        three = F.flatten(F.transform(two, lambda a: F.transform(w, lambda b: F.concat_ws(" ", a, b))))
        return F.filter(F.concat(w, two, three), lambda c: (c != o) & F.contains(o, c))

    names = F.filter(F.transform("_all", lambda x: x[ngram]), lambda c: F.contains(c, F.lit(" ")))
    gone = F.array_distinct(F.flatten(F.transform(names, inner)))
    kept = rows.select(doc, "_all", F.array_intersect(F.transform("_all", lambda x: x[ngram]), gone).alias("_gone"))
    return kept.select(doc, F.explode(F.filter("_all", lambda x: ~F.array_contains("_gone", x[ngram]))).alias("_row")).select(doc, "_row.*").select(*candidates.columns)


def chunks(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Batches of at most ``size`` rows."""
    for pdf in rows:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]
