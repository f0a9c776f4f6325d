"""Queries over the event stream, and the change feed applied as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import changefeed
from skeinwork.session import cut, read, shared_folder
from skeinwork.sources.snapshots import Snapshots
from skeinwork.streaming import events as ev
from skeinwork.streaming import keyed

_AS_OF = "2024-01-20 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def session_gap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(_events(spark, sf_dir), "user_id", "ts")


def inactive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.inactive(_events(spark, sf_dir).where(F.col("ts") < F.lit(_AS_OF).cast("timestamp")), "user_id", "ts", _AS_OF, 24 * 60)


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windows(_events(spark, sf_dir), "event_type", "ts", "value", "1 hour").withColumn("total", F.round("total", 4))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windows(_events(spark, sf_dir), "event_type", "ts", "value", "6 hours", "2 hours").withColumn("total", F.round("total", 4))


def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, types and hours that occur."""
    e = _events(spark, sf_dir).select("user_id", "event_type", F.date_trunc("hour", "ts").alias("hour"))
    return ev.once(e, ["user_id", "event_type", "hour"], "hour")


def latest_desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest(_events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "ts", "event_id", "event_type", "value")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of the JSON properties, and what it adds up to by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(k.isNotNull()).alias("with_k"), F.sum(k).alias("sum_k"))


def stream_change_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed read as a stream and folded batch by batch into a snapshot; the rows that exist at the end."""
    root = f"{shared_folder(spark)}/change-fold-{uuid.uuid4().hex}"
    order, payload = ["source_generation", "attempts"], ["source_fingerprint"]
    store = Snapshots(spark, f"{root}/state")
    feed = spark.readStream.schema(read(spark, sf_dir, "job_changes").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/job_changes.parque[t]")
    sink = ev.fold_into(store, "jobs", "segment_id", order, payload)
    feed.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    state = store.read("jobs")
    if state is None:
        state = changefeed.fold(read(spark, sf_dir, "job_changes").limit(0), "segment_id", order, payload)
    live = cut(changefeed.current(state, "segment_id", order, payload).select("segment_id", "source_generation", "source_fingerprint"))
    store.remove(root)
    return live


def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed read as a stream into keyed state: the last change of each segment, and whether it deleted it."""
    root = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, keyed.PROVIDER)
    try:
        feed = spark.readStream.schema(read(spark, sf_dir, "job_changes").schema).parquet(f"{sf_dir}/job_changes.parque[t]")
        told = keyed.latest(feed, "segment_id", ["source_generation", "attempts"], "source_fingerprint")
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
        told.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    done = spark.read.schema("key string, first long, second long, value string, outcome string").parquet(f"{root}/out").where("outcome <> 'late'")
    last = done.groupBy("key").agg(F.max(F.struct("first", "second", "outcome")).alias("s"))
    out = cut(last.select(F.col("key").alias("segment_id"), F.col("s.first").alias("source_generation"), F.col("s.second").alias("attempts"), F.col("s.outcome").alias("outcome")))
    Snapshots(spark, root).remove(root)
    return out


_WINDOWS = """SELECT w AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT *, unnest({}) AS w FROM events) GROUP BY ALL"""

SQL = {
    "session_gap_windows": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTES THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTES AS "end", count(*) AS events FROM s GROUP BY user_id, n""",
    "inactive_sessions": f"SELECT user_id, max(ts) AS last FROM events WHERE ts < TIMESTAMP '{_AS_OF}' GROUP BY user_id HAVING max(ts) <= TIMESTAMP '{_AS_OF}' - INTERVAL 1 DAY",
    "hourly_windows": _WINDOWS.format("[date_trunc('hour', ts)]"),
    "sliding_windows": _WINDOWS.format("list_transform([0, 2, 4], lambda h: time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(h))"),
    "event_dedupe": "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events",
    "latest_desired": "SELECT user_id, ts, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS with_k, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events GROUP BY event_type",
}

QUERIES = {f.__name__: f for f in (session_gap_windows, inactive_sessions, hourly_windows, sliding_windows, event_dedupe, latest_desired, event_properties, stream_change_fold, stream_keyed_state)}
