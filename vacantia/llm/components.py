"""Connected components by alternating large and small stars, without any graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node of ``edges`` (``u``, ``v``).

    Each round sends a node's larger neighbours, then its smaller ones, to the smallest; the edges end as
    stars. Rounds are logarithmic in the longest chain; each is written to the shared folder.
    """
    now = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now, at, mark = scratch.cut(now, f"{name}0"), 0, None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        # small star: large has u < v; v's smallest neighbour takes the others and v
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        at += 1
        now = scratch.cut(small, f"{name}{at}")
        scratch.drop(f"{name}{at - 1}")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select("u").distinct().select(F.col("u").alias("node"), F.col("u").alias("root")))
