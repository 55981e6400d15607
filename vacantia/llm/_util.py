"""Shared helpers: scratch tables in the cluster's shared folder and numpy views of Arrow text."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in numpy; one longer document forms a slice of its own.
SLICE_BYTES = 1 << 21


class Scratch:
    """Written tables that cut lineage, under ``spark.checkpoint.dir``.

    Where the session names no such folder, a session on one machine (``local`` master) uses one of our own in
    the temp directory; on a cluster that is an error, since executors share no local folder. The tables that a
    result still reads stay until the folder is cleared.
    """

    def __init__(self, spark: SparkSession) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = os.path.join(tempfile.gettempdir(), "vacantia-scratch")
        self.spark, self.root = spark, f"{base}/vacantia-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], rows: str, by: str, dealt: bool = False) -> DataFrame:
    """Left join of ``many`` with the unique ``keys`` of ``few``, whatever share of the rows one key has.

    ``few`` (a written table) tells in ``rows`` how many rows of ``many`` have each key. Keys with more than one
    part in four times the shuffle partitions are at most four times the partitions in number, so they are
    broadcast; their rows are dealt by ``by`` and meet nothing in the sort-merge join that serves all other keys.
    ``dealt`` keeps the columns that rows are dealt by (``_hot``, ``_key_...``), which tell groups of one key, or
    of one key and ``by``.
    """
    most = 4 * partitions(many.sparkSession)
    bound = max(1, (few.agg(F.sum(rows)).first()[0] or 0) // most)
    told = [c for c in few.columns if c not in keys]
    kinds = {k: many.schema[k].dataType for k in keys}
    hot = few.where(F.col(rows) > bound).select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in told], F.lit(True).alias("_hot"))
    tagged = many.join(F.broadcast(hot), keys, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    spread = [F.when(F.col("_hot"), F.xxhash64(F.col(by), F.lit(k)).cast("string").cast(kinds[k])).otherwise(F.col(k)).alias(f"_key_{k}") for k in keys]
    cold = few.where(F.col(rows) <= bound).select(*[F.col(k).cast(kinds[k]).alias(f"_key_{k}") for k in keys], *[F.col(c).alias(f"_cold_{c}") for c in told], F.lit(False).alias("_hot"))
    at = ["_hot", *[f"_key_{k}" for k in keys]]
    joined = tagged.select("*", *spread).join(cold.hint("merge"), at, "left")
    return joined.select(*many.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in told], *(at if dealt else []))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    got = batch.column(name)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets; null counts as empty."""
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each, whole rows only."""
    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), SLICE_BYTES + 1)
        for_base, for_inverse = (np.full(size, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        for_base[0] = for_inverse[0] = 1
        with np.errstate(over="ignore"):
            _POWERS, _INVERSE = np.cumprod(for_base), np.cumprod(for_inverse)
    return _POWERS, _INVERSE


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and how many each text has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    powers, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])))
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
