"""Windows and the status machine over events, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.plans.registry import register
from vacantia.plans.standins import table
from vacantia.streaming import events as E


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone and totals rounded, as the oracle has them."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "timestamp" else F.round(c, 2).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@register("""SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _plain(E.tumbling(_events(spark, d), "1 hour", None, "ts", "event_type"))


@register("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 1 HOUR AS start, value FROM events, (SELECT unnest(range(0, 6)) AS k)) SELECT start, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1""")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return _plain(E.sliding(_events(spark, d), "6 hours", "1 hour"))


@register("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, sid""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return _plain(E.sessions(_events(spark, d), "30 minutes", "user_id"))


_UPDATES = "u AS (SELECT user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'processing' END AS status, CASE event_type WHEN 'error' THEN props END AS error FROM events)"


def status_updates(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("processing")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.when(kind == "error", F.col("props")).alias("error"))


@register(f"""WITH {_UPDATES} SELECT job_id, arg_max(status, seq) AS status, max(ts) FILTER (status = 'completed') AS completed_at, count(*) FILTER (status = 'failed') AS attempts, arg_max(error, seq) FILTER (status = 'failed') AS error FROM u GROUP BY 1""")
def status_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return _plain(E.last_status(status_updates(_events(spark, d))))


@register("""SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and type, and how many there are."""
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@register("""WITH t AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR + k * INTERVAL 1 HOUR AS "at", event_type FROM events, (SELECT unnest(range(0, 24)) AS k))
SELECT "at", count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM t GROUP BY 1""")
def rolling_health(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("status", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing"))
    return _plain(E.health(rows))


@register("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """A field dug out of JSON properties."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return _events(spark, d).groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
