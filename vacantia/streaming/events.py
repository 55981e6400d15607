"""Structured Streaming: event bus, windows, status machine, incremental dedup and micro-batch loading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

TOPICS = ("jobs_scraped", "skills_extracted", "skills_enhanced", "clustering_completed")
PAYLOAD = "event string, timestamp timestamp, data struct<job_ids:array<string>,count:int,country:string,spider:string>"
#: Which task an event starts.
NEXT_TASK = {"jobs_scraped": "extract", "skills_extracted": "enhance", "skills_enhanced": "embed"}


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A stream over files that arrive in a folder; ``per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).load(path)


def payloads(messages: DataFrame, value: str = "value") -> DataFrame:
    """Events read from JSON messages; a message that can't be read has a null event and is dropped."""
    return messages.select(F.from_json(F.col(value).cast("string"), PAYLOAD).alias("m")).select("m.*").where("event is not null")


def publish(rows: DataFrame, event: str, at: Column, data: Column) -> DataFrame:
    """Messages ``{event, timestamp, data}`` as JSON, for any sink that takes a value column."""
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), at.alias("timestamp"), data.alias("data"))).alias("value"))


def topics(events: DataFrame, pattern: str) -> DataFrame:
    """Events whose topic matches a pattern with ``*``."""
    return events.where(F.col("event").rlike("^" + pattern.replace("*", ".*") + "$"))


def tasks(events: DataFrame) -> DataFrame:
    """One task for each job id of an event: ``task``, ``job_id``, ``timestamp``."""
    kind = F.create_map(*[F.lit(x) for pair in NEXT_TASK.items() for x in pair])
    return events.select(F.try_element_at(kind, F.col("event")).alias("task"), F.explode("data.job_ids").alias("job_id"), "timestamp").where("task is not null")


def tumbling(events: DataFrame, size: str, late: str | None = None, ts: str = "ts", *keys: str) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    got = rows.groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None, ts: str = "ts", *keys: str) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    got = rows.groupBy(F.window(ts, size, step), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None, ts: str = "ts") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    got = rows.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def health(jobs: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Completed and failed over the last 24 hours, each hour anew."""
    rows = jobs.withWatermark(ts, late) if late else jobs
    got = rows.groupBy(F.window(ts, "24 hours", "1 hour")).agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))
    return got.select(F.col("window.end").alias("at"), "completed", "failed", "total")


# -- status machine


def last_status(updates: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The batch form: last status, time of the last completion, number of failures and last error."""
    at = F.col(order)
    return updates.groupBy(key).agg(
        F.max_by("status", at).alias("status"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
        F.count_if(F.col("status") == "failed").alias("attempts"),
        F.max_by("error", F.when(F.col("status") == "failed", at)).alias("error"),
    )


def status_stream(updates: DataFrame, key: str = "job_id", key_type: str = "long") -> DataFrame:
    """The streaming form over (key, seq, ts, status, error): the state of each job after every micro-batch that touches it.

    An update older than the state's changes no status but still counts its failure.
    """

    def step(k: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, done, attempts, error, error_seq = state.get if state.exists else (-1, None, None, 0, None, -1)
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                if r.seq > seq:
                    seq, status = int(r.seq), r.status
                if r.status == "completed":
                    done = r.ts.isoformat() if done is None else max(done, r.ts.isoformat())
                if r.status == "failed":
                    attempts += 1
                    if r.seq > error_seq:
                        error, error_seq = r.error, int(r.seq)
        state.update((seq, status, done, attempts, error, error_seq))
        yield pd.DataFrame({key: [k[0]], "status": [status], "completed_at": [pd.Timestamp(done) if done else pd.NaT], "attempts": [attempts], "error": [error]})

    return updates.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, status string, completed_at timestamp, attempts long, error string", "seq long, status string, done string, attempts long, error string, error_seq long", "update", GroupStateTimeout.NoTimeout)


# -- incremental loading


def dedup_within(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """First rows of each key; the state is bounded by the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def load_new(stream: DataFrame, target: str, key: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append rows whose key is not in the target yet, one micro-batch at a time, until nothing is left.

    A batch that is run again after a failure finds its rows in the target and adds none.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(target).select(key)
            rows = rows.join(known, key, "left_anti")
        except Exception as e:  # the target comes to be with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        rows.write.mode("append").parquet(target)
        if after is not None:
            after(rows, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its result; for tests and reports."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
