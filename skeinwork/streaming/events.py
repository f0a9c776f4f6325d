"""Operators that work on a batch and on a stream alike: sessions by gap, windows, deduplication, latest state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators import changefeed
from skeinwork.sources.snapshots import Snapshots, bucket_of

GAP, LATE = "10 minutes", "1 hour"
#: Buckets that a folded state is kept in.
BUCKETS = 64


def timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark; times without a zone, which watermarks do not take, are read as UTC. Batches stay as they are."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def sessions(events: DataFrame, key: str, at: str, gap: str = GAP, late: str = LATE) -> DataFrame:
    """(key, start, end, events): runs of a key's events with no gap of `gap` or more; end is the gap after the last event."""
    rows, kind_of = timed(events, at, late), events.schema[at].dataType
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").cast(kind_of).alias("start"), F.col("w.end").cast(kind_of).alias("end"), "events")


def windows(events: DataFrame, kind: str, at: str, value: str, size: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, kind, events, total) of tumbling or sliding windows."""
    rows, kind_of = timed(events, at, late), events.schema[at].dataType
    return rows.groupBy(F.window(at, size, slide or size).alias("w"), kind).agg(F.count("*").alias("events"), F.sum(value).alias("total")).select(F.col("w.start").cast(kind_of).alias("start"), kind, "events", "total")


def once(events: DataFrame, key: list[str], at: str, late: str = LATE) -> DataFrame:
    """One event per key; in a stream among those that come within the time events may be late."""
    return timed(events, at, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; one aggregation, so it also runs as a stream in update or complete mode."""
    rest = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in [*order, *rest]))


def inactive(events: DataFrame, key: str, at: str, as_of: str, minutes: int = 10) -> DataFrame:
    """(key, last): keys whose last event is at least so long before the given time."""
    last = events.groupBy(key).agg(F.max(at).alias("last"))
    return last.where(F.col("last") <= F.lit(as_of).cast(events.schema[at].dataType) - F.expr(f"INTERVAL {minutes} MINUTES"))


def fold_into(store: Snapshots, table: str, key: str, order: list[str], payload: list[str], op: str = "op", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A sink for `foreachBatch`: folds each batch of changes into the state kept in a snapshot table.

    The state is kept in buckets by key, and a batch rewrites only those its keys fall into. The fold is idempotent and the
    commit marked with the batch's number, so a batch that is run again after a failure changes nothing.
    """

    def sink(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col(key).isNotNull())
        touched = [r["b"] for r in rows.select(bucket_of(key, buckets).alias("b")).distinct().collect()]  # at most `buckets`
        if not touched:
            return
        version = store.version
        state = changefeed.fold(rows, key, order, payload, op, store.read(table, touched, version))
        store.commit({}, version, (table, str(number)), {table: (state.withColumn("_bucket", bucket_of(key, buckets)), buckets)})

    return sink
