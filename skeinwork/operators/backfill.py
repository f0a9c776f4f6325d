"""What of all sessions is still to be submitted: segments against what is stored of them, and a report of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import ids
from skeinwork.operators import conversation as conv
from skeinwork.session import small


def plan(rows: DataFrame, stored: DataFrame, as_of: str, minutes: int = 10, bounds: DataFrame | None = None, limit: int = conv.LIMIT) -> DataFrame:
    """(session_id, segment_id, start_id, end_id, closed, messages, fingerprint, status) of every segment that may be submitted.

    stored: (segment_id, fingerprint, eligible), one row per segment. Closed segments may be submitted, open ones once nothing
    was updated in their session for so many minutes before `as_of`. status is `eligible` if the segment is stored just as it
    is and may be used, `stale` if it is stored otherwise, `new` if it is not.
    """
    packed = conv.segments(conv.turns(rows), limit, bounds).select("session_id", "start_id", "end_id", "closed")
    last = rows.groupBy(F.col("session_id").alias("_s")).agg(F.max("time_updated").alias("last"))
    idle = F.col("last") <= F.lit(as_of).cast(rows.schema["time_updated"].dataType) - F.expr(f"INTERVAL {minutes} MINUTES")
    ready = packed.join(last, F.col("session_id").eqNullSafe(F.col("_s")), "left").where(F.col("closed") | idle).select(*packed.columns)
    texts = conv.read_back(rows, ready).where("problem is null").groupBy("session_id", "start_id", "end_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("m"))
    listed = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    made = ready.join(texts, ["session_id", "start_id", "end_id"]).select(
        "session_id", ids.segment_id(F.col("session_id"), F.col("start_id")).alias("segment_id"), "start_id", "end_id", "closed", F.size("m").alias("messages"), ids.source_fingerprint(F.col("session_id"), F.col("start_id"), F.col("end_id"), listed).alias("fingerprint")
    )
    known = stored.select(F.col("segment_id").alias("_id"), F.col("fingerprint").alias("_mark"), F.coalesce("eligible", F.lit(False)).alias("_fine"))
    status = F.when(F.col("_id").isNull(), "new").when(F.col("_fine") & F.col("_mark").eqNullSafe(F.col("fingerprint")), "eligible").otherwise("stale")
    return made.join(small(known), F.col("segment_id") == F.col("_id"), "left").select(*made.columns, status.alias("status"))


def report(planned: DataFrame) -> DataFrame:
    """(status, sessions, segments, messages)."""
    per = planned.groupBy("status", "session_id").agg(F.count("*").alias("n"), F.sum("messages").alias("m"))
    return per.groupBy("status").agg(F.count("*").alias("sessions"), F.sum("n").alias("segments"), F.sum("m").alias("messages"))
