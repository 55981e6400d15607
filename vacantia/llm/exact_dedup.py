"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch, spread_join


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.unhex(F.md5(text)).alias("_h"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Classes of two or more equal texts: ``_h`` (128-bit hash), ``_s`` (SHA-256), ``keep_id``, ``group_size``.

    Rows are grouped by hash and bytes, so two texts whose hashes collide fall into two classes. Map-side
    aggregation sends one row per task and text, however many copies there are, so no class is hot. A null
    text counts as empty; null ids never stay while the class has another id.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    classes = _hashed(docs, id_col, text_col).groupBy("_h", "_t").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return classes.where("group_size > 1").select("_h", F.sha2("_t", 256).alias("_s"), "keep_id", "group_size")


def _labelled(docs: DataFrame, id_col: str, text_col: str, keep: str, columns: list[Column]) -> DataFrame:
    """Rows with their class, and in ``_n`` their turn among rows of one class and id, the row that stays first.

    A class that holds a large share of all rows is dealt by id, so no task gets it whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*columns, F.col(id_col).alias("_id"), F.unhex(F.md5(text)).alias("_h"), F.sha2(text, 256).alias("_s"))
    classes = Scratch(docs.sparkSession).cut(exact_classes(docs, id_col, text_col, keep), "classes")
    rows = spread_join(rows, classes, ["_h", "_s"], "group_size", "_id", dealt=True)
    stays = F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))
    turn = F.row_number().over(Window.partitionBy("_hot", "_key__h", "_key__s").orderBy(F.desc("_stays"), "_id"))
    return rows.withColumn("_stays", stays).withColumn("_n", F.when(F.col("group_size").isNull(), 1).otherwise(turn))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the smallest (``keep="max"``: largest) id stays. Rows that repeat both id
    and text tie; exactly one of them is kept. Null texts equal empty ones; null ids stay only where a class has no
    other. Texts of any length are read whole. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    rows = _labelled(docs, id_col, text_col, keep, [])
    alone = F.col("group_size").isNull()
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_stays") & (F.col("_n") == 1)).alias("kept"),
        F.col("_s").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay (see ``exact_dedup``), with all their columns."""
    names = docs.columns
    kept = _labelled(docs, id_col, text_col, keep, [F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")])
    return kept.where("_stays and _n = 1").select("_row.*")
