"""Queries over the change feed of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import changefeed
from skeinwork.session import read

_ORDER, _PAYLOAD = ["source_generation", "attempts"], ["source_fingerprint"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that exist after all changes, with their last generation and fingerprint."""
    state = changefeed.fold(read(spark, sf_dir, "job_changes"), "segment_id", _ORDER, _PAYLOAD)
    return changefeed.current(state, "segment_id", _ORDER, _PAYLOAD).select("segment_id", "source_generation", "source_fingerprint")


def p5_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose last change is a delete: what must be kept so that a late change cannot revive them."""
    state = changefeed.fold(read(spark, sf_dir, "job_changes"), "segment_id", _ORDER, _PAYLOAD)
    return state.where(F.col("last.kind") == changefeed.DELETE).select("segment_id", F.col("last.seq.s0").alias("source_generation"), F.col("last.seq.s1").alias("attempts"))


_FOLDED = """
WITH c AS (
  SELECT segment_id, source_generation AS g, coalesce(attempts, 0) AS a, source_fingerprint AS f,
         CASE WHEN lower(trim(op)) IN ('i', 'insert', 'c', 'create') THEN 1 WHEN lower(trim(op)) IN ('u', 'update') THEN 0
              WHEN lower(trim(op)) IN ('d', 'delete') THEN 2 END AS kind
  FROM job_changes WHERE segment_id IS NOT NULL AND source_generation IS NOT NULL),
one AS (SELECT segment_id, g, a, max(kind) AS kind, max(f) FILTER (WHERE kind <> 2) AS f FROM c WHERE kind IS NOT NULL GROUP BY ALL),
runs AS (SELECT *, sum(CASE WHEN kind <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY segment_id ORDER BY g, a) AS run,
                row_number() OVER (PARTITION BY segment_id ORDER BY g DESC, a DESC) AS back FROM one),
kept AS (SELECT segment_id, run, arg_max(f, g * 1000000 + a) FILTER (WHERE f IS NOT NULL AND kind <> 2) AS f FROM runs GROUP BY ALL),
last AS (SELECT * FROM runs WHERE back = 1)
"""

SQL = {
    "p5_found": _FOLDED + "SELECT segment_id, g AS source_generation, kept.f AS source_fingerprint FROM last JOIN kept USING (segment_id, run) WHERE kind <> 2",
    "p5_tombstones": _FOLDED + "SELECT segment_id, g AS source_generation, a::BIGINT AS attempts FROM last WHERE kind = 2",
}

#: The last change of each segment, and what it did.
LAST_CHANGE = _FOLDED + "SELECT segment_id, g AS source_generation, a::BIGINT AS attempts, CASE WHEN kind = 2 THEN 'deleted' ELSE 'set' END AS outcome FROM last"

QUERIES = {"p5_found": p5_found, "p5_tombstones": p5_tombstones}
