"""Queries of context projection and of the way from requests to claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork import memory
from skeinwork.operators import backfill, extraction, projection
from skeinwork.operators import conversation as conv
from skeinwork.plans import conversations
from skeinwork.session import read

#: A context small enough that sessions of the test data are due.
CONTEXT, OUTPUT = 1_000, 100
#: Later than all messages of the test data.
_AS_OF = "2030-01-01 00:00:00"


def context_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = conv.segments(conv.turns(read(spark, sf_dir, "chat_messages")), 600)
    return projection.tails(packed, F.lit(CONTEXT), F.lit(None).cast("long"), F.lit(OUTPUT))


def summary_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of each segment as entries of a summary of at most 200 characters, the last ones first."""
    c = read(spark, sf_dir, "claims").select("segment_id", "id", F.concat_ws(" ", "subject", "predicate").alias("t")).groupBy("segment_id", "id").agg(F.max("t").alias("text"))
    entries = c.select(F.col("segment_id").alias("session_id"), F.col("id").alias("place"), "text")
    return projection.summaries(entries, F.lit(200)).withColumnRenamed("session_id", "segment_id")


def extracted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the default extractor finds in all requests, resolved against the established entities."""
    known = read(spark, sf_dir, "entity_candidates").select("id", F.col("canonical_name").alias("name"))
    claims, _ = extraction.prepared(extraction.proposed(read(spark, sf_dir, "segment_requests")), known)
    return claims.drop("embedding")


def extracted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "entity_candidates").select("id", F.col("canonical_name").alias("name"))
    _, entities = extraction.prepared(extraction.proposed(read(spark, sf_dir, "segment_requests")), known)
    return entities.drop("embedding")


def prior_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summaries of all segments before each one in its session, oldest first; a segment without claims has no summary."""
    r = read(spark, sf_dir, "segment_requests").groupBy("session_id", "segment_id").agg(F.min("created_at").alias("at"))
    made = summary_budget(spark, sf_dir).select("segment_id", F.col("text").alias("summary"))
    return extraction.prior_texts(r.join(made, "segment_id", "left"))


def _summaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of a small limit, and summaries for two thirds of them, one in five of those with another end."""
    packed = conv.segments(conv.turns(read(spark, sf_dir, "chat_messages")), 600)
    told = F.when(F.col("segment_no") % 5 == 0, F.col("start_id")).otherwise(F.col("end_id"))
    made = packed.where("segment_no % 3 <> 0").select(F.concat("start_id", F.lit("-summary")).alias("id"), "session_id", "start_id", told.alias("end_id"), F.concat(F.lit("From "), "start_id", F.lit(" to "), "end_id").alias("summary"), F.lit(0).alias("created_at"))
    return packed, made


def summary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the summary of just their bounds."""
    packed, made = _summaries(spark, sf_dir)
    return projection.covered(packed.select("session_id", "segment_no", "start_id", "end_id"), made).select("session_id", "segment_no", "summary_id", "summary")


def context_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model of small limits would be shown of each session, and why."""
    _, info = projection.project(read(spark, sf_dir, "chat_messages"), _summaries(spark, sf_dir)[1], 12_000, output=10_000, limit=600)
    return info.withColumn("reasons", F.array_join("reasons", ","))


def projected_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown, _ = projection.project(read(spark, sf_dir, "chat_messages"), _summaries(spark, sf_dir)[1], 12_000, output=10_000, limit=600)
    return shown


def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all chats against stored ones: of every session's first three segments one is as stored, one is stored otherwise."""
    rows = read(spark, sf_dir, "chat_messages")
    made = backfill.plan(rows, spark.createDataFrame([], "segment_id string, fingerprint string, eligible boolean"), _AS_OF)
    first = made.withColumn("h", F.pmod(F.xxhash64("segment_id"), F.lit(3))).where("h < 2")
    stored = first.select("segment_id", F.when(F.col("h") == 0, F.col("fingerprint")).otherwise("another").alias("fingerprint"), F.lit(True).alias("eligible"))
    return backfill.plan(rows, stored, _AS_OF).select("session_id", "segment_id", "start_id", "end_id", "closed", "messages", "fingerprint", "status")


def segment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requested segment with its claims."""
    r = read(spark, sf_dir, "segment_requests").groupBy("segment_id").agg(F.min("session_id").alias("session_id"))
    shown = memory.viewed(r, read(spark, sf_dir, "claims"))
    return shown.select("segment_id", "session_id", F.size("claims").alias("n"), F.array_join("claims.id", ",").alias("claim_ids"))


SQL = {
    "segment_view": """WITH r AS (SELECT segment_id, min(session_id) AS session_id FROM segment_requests GROUP BY ALL), c AS (SELECT DISTINCT segment_id, id FROM claims)
SELECT r.segment_id, r.session_id, count(c.id)::INT AS n, coalesce(string_agg(c.id, ',' ORDER BY c.id), '') AS claim_ids FROM r LEFT JOIN c USING (segment_id) GROUP BY ALL""",
    "summary_coverage": f"""SELECT session_id, segment_no, CASE WHEN segment_no % 3 <> 0 AND (segment_no % 5 <> 0 OR start_id = end_id) THEN start_id || '-summary' END AS summary_id,
CASE WHEN segment_no % 3 <> 0 AND (segment_no % 5 <> 0 OR start_id = end_id) THEN 'From ' || start_id || ' to ' || end_id END AS summary FROM ({conversations._packs(600)})""",
    "context_tails": conversations._packs(600).replace("SELECT session_id, run::BIGINT", "SELECT * FROM (SELECT session_id, run::BIGINT", 1).rstrip() + ")",
    "summary_budget": """WITH c AS (SELECT segment_id, id, max(concat_ws(' ', subject, predicate)) AS t FROM claims GROUP BY ALL),
u AS (SELECT *, sum(length(t)) OVER (PARTITION BY segment_id ORDER BY id DESC) AS used FROM c)
SELECT segment_id, count(*) FILTER (WHERE used <= 200) AS kept, count(*) FILTER (WHERE used > 200) AS omitted, coalesce(string_agg(t, chr(10) ORDER BY id) FILTER (WHERE used <= 200), '') AS text, count(*) FILTER (WHERE used > 200) > 0 AS lossy
FROM u GROUP BY segment_id""",
}
_THRESHOLD, _TARGET = int(CONTEXT * 0.75), int(CONTEXT * 0.25)
SQL["context_tails"] = f"""WITH s AS ({SQL['context_tails']}),
t AS (SELECT *, ceil(weight / 4) AS n FROM s),
w AS (SELECT *, sum(n) OVER (PARTITION BY session_id) AS total, sum(n) OVER (PARTITION BY session_id ORDER BY segment_no DESC) AS tail,
             bool_and(closed) OVER (PARTITION BY session_id ORDER BY segment_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
c AS (SELECT *, tail <= {_TARGET} AS fits FROM w WHERE before AND total >= {_THRESHOLD}),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fits DESC, CASE WHEN fits THEN segment_no ELSE -segment_no END) AS rn FROM c)
SELECT session_id, segment_no, start_id, segment_no - 1 AS archived, tail AS tail_tokens, fits FROM r WHERE rn = 1"""
SQL["prior_summaries"] = f"""WITH r AS (SELECT session_id, segment_id, min(created_at) AS made FROM segment_requests GROUP BY ALL), b AS ({SQL['summary_budget']})
SELECT segment_id, coalesce(list(b.text) FILTER (WHERE b.text IS NOT NULL) OVER (PARTITION BY session_id ORDER BY made, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS prior FROM r LEFT JOIN b USING (segment_id)"""

QUERIES = {f.__name__: f for f in (context_tails, summary_budget, summary_coverage, context_projection, projected_messages, backfill_plan, segment_view, extracted_claims, extracted_entities, prior_summaries)}
