"""Queries of recall, identifiers and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import ids, scoring
from skeinwork.operators import recall
from skeinwork.session import cut, read

DIM = 64


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["subject_entity_id", "object_entity_id", "confidence", "equivalence_key", "segment_id"]
    return recall.usable(read(spark, sf_dir, "claims"), DIM, "id", "embedding", keep)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def recall_grouped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.recall(_queries(spark, sf_dir), _claims(spark, sf_dir), read(spark, sf_dir, "segment_requests"), DIM)
    return found.select("query", "place", "id", "is_direct", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "support_count", "session_count", F.array_join("segment_ids", ",").alias("segment_ids"))


def vector_topk_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.nearest(_queries(spark, sf_dir), _claims(spark, sf_dir), DIM, 10).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def vector_topk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = recall.usable(read(spark, sf_dir, "entities"), DIM, "id", "embedding", [])
    return recall.nearest(_queries(spark, sf_dir), items, DIM, 5).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def graph_one_hop_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _queries(spark, sf_dir), _claims(spark, sf_dir)
    direct = cut(recall.nearest(q, c, DIM, 10)).join(c.select("id", "subject_entity_id", "object_entity_id"), "id")
    return recall.neighbours(q, recall.seeds(direct), c, DIM, 10).select("query", "entity", "id", F.round("similarity", 6).alias("similarity"), F.round("seed", 6).alias("seed"))


def claim_support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.support_counts(read(spark, sf_dir, "claims"), read(spark, sf_dir, "segment_requests"))


def claim_support_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.supporting(read(spark, sf_dir, "claims"), read(spark, sf_dir, "segment_requests"))


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "segment_requests")
    made = ids.source_fingerprint(F.col("session_id"), F.col("start_user_message_id"), F.col("end_user_message_id"), F.col("messages"))
    return r.select("segment_id", made.alias("fingerprint")).distinct()


def projection_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", ids.projection_fingerprint(F.coalesce("project_key", F.lit("-")), F.col("doc_id").cast("string"), F.col("text"), F.lit(1)).alias("fingerprint"))


def uuid5_segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "segment_requests").select("session_id", "start_user_message_id", ids.segment_id(F.col("session_id"), F.col("start_user_message_id")).alias("made_id")).distinct()


def equivalence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "claims")
    made = ids.equivalence_key(F.col("subject_entity_id"), F.lower("predicate"), F.col("object_entity_id"), F.lower("object_value"))
    return c.select("id", made.alias("made_key")).distinct()


def context_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits of made-up models: contexts, inputs and outputs taken from part sizes and keys."""
    p = read(spark, sf_dir, "part")
    models = p.select("p_partkey", (F.col("p_size") * 4_000).alias("context"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 3_000).alias("given"), (F.col("p_partkey") % 5 * 8_000).alias("output"))
    lim = scoring.context_limits(F.col("context"), F.col("given"), F.col("output"))
    return models.select("p_partkey", lim.alias("l")).select("p_partkey", "l.usable", "l.hard", "l.threshold", "l.target", "l.summary_chars")


_VECTORS = """
WITH c AS (SELECT id, any_value(embedding) AS v, any_value(subject_entity_id) AS s, any_value(object_entity_id) AS o, any_value(confidence) AS conf,
                  any_value(equivalence_key) AS key, any_value(segment_id) AS seg
           FROM claims WHERE len(embedding) = 64 GROUP BY id),
n AS (SELECT *, list_transform(v, lambda x: x::DOUBLE) AS w FROM c),
u AS (SELECT id, s, o, conf, key, seg, w, sqrt(list_dot_product(w, w)) AS size FROM n),
q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % 20 = 0),
sim AS (SELECT query, id, s, o, list_dot_product(q.w, u.w) / (size * sqrt(list_dot_product(q.w, q.w))) AS similarity FROM q, u),
direct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM sim) WHERE place <= 10),
seeds AS (SELECT query, entity, greatest(0, max(similarity)) AS seed FROM (SELECT query, similarity, unnest([s, o]) AS entity FROM direct) WHERE entity IS NOT NULL GROUP BY ALL),
ends AS (SELECT DISTINCT id, entity FROM (SELECT id, unnest([s, o]) AS entity FROM c) WHERE entity IS NOT NULL),
near AS (SELECT * FROM (SELECT query, entity, id, similarity, seed, row_number() OVER (PARTITION BY query, entity ORDER BY similarity DESC, id) AS place
         FROM seeds JOIN ends USING (entity) JOIN sim USING (query, id)) WHERE place <= 10)
"""

_SUPPORT = """
SELECT equivalence_key, string_agg(DISTINCT segment_id, ',' ORDER BY segment_id) AS segment_ids, count(DISTINCT segment_id) AS support_count, count(DISTINCT session_id) AS session_count
FROM claims JOIN (SELECT DISTINCT segment_id, session_id FROM segment_requests) USING (segment_id) WHERE equivalence_key IS NOT NULL GROUP BY equivalence_key
"""


def _uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


SQL = {
    "recall_grouped_topk": _VECTORS + f""", sup AS ({_SUPPORT}),
offered AS (SELECT query, id, similarity, NULL AS seed, true AS is_direct FROM direct UNION ALL SELECT query, id, similarity, seed, false FROM near),
rows_ AS (SELECT o.*, greatest(0, least(1, coalesce(u.conf, 0))) AS conf, u.key, u.seg, sup.segment_ids, sup.support_count, sup.session_count,
                 greatest(0, least(1, similarity)) AS sm, least(0.1::DOUBLE, 0.02::DOUBLE * greatest(0, coalesce(sup.session_count, 1) - 1)) AS boost
          FROM offered o JOIN u USING (id) LEFT JOIN sup ON sup.equivalence_key = u.key),
scored AS (SELECT *, round(CASE WHEN is_direct THEN 1.0::DOUBLE + 0.8::DOUBLE * sm + 0.2::DOUBLE * conf + boost
           ELSE 0.8::DOUBLE * (0.5::DOUBLE * sm + 0.3::DOUBLE * greatest(0, least(1, seed)) + 0.2::DOUBLE * conf) + boost END, 9) AS score FROM rows_),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, key ORDER BY score DESC, is_direct DESC, id) AS rn FROM scored) WHERE rn = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, is_direct DESC, id) AS place FROM one)
SELECT query, place::INT AS place, id, is_direct, round(similarity, 6) AS similarity, round(score, 6) AS score, coalesce(support_count, 1) AS support_count,
       coalesce(session_count, 1) AS session_count, coalesce(segment_ids, seg) AS segment_ids FROM placed WHERE place <= 20
""",
    "vector_topk_direct": _VECTORS + "SELECT query, id, round(similarity, 6) AS similarity, place::INT AS place FROM direct",
    "vector_topk_entities": """
WITH u AS (SELECT id, list_transform(any_value(embedding), lambda x: x::DOUBLE) AS w FROM entities WHERE len(embedding) = 64 GROUP BY id),
q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % 20 = 0),
sim AS (SELECT query, id, list_dot_product(q.w, u.w) / sqrt(list_dot_product(u.w, u.w) * list_dot_product(q.w, q.w)) AS similarity FROM q, u)
SELECT query, id, round(similarity, 6) AS similarity, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM sim) WHERE place <= 5
""",
    "graph_one_hop_neighbors": _VECTORS + "SELECT query, entity, id, round(similarity, 6) AS similarity, round(seed, 6) AS seed FROM near",
    "claim_support_counts": f"SELECT equivalence_key, support_count, session_count FROM ({_SUPPORT})",
    "claim_support_segments": "SELECT DISTINCT equivalence_key, segment_id FROM claims WHERE equivalence_key IS NOT NULL AND segment_id IN (SELECT segment_id FROM segment_requests WHERE segment_id IS NOT NULL)",
    "source_fingerprint": """
SELECT DISTINCT segment_id, sha256('source-v1:' || strlen(session_id) || ':' || session_id || strlen(start_user_message_id) || ':' || start_user_message_id || strlen(end_user_message_id) || ':' || end_user_message_id
  || len(messages) || ':' || list_aggregate(list_transform(messages, lambda m: strlen(m.role) || ':' || m.role || strlen(m.text) || ':' || m.text), 'string_agg', '')) AS fingerprint
FROM segment_requests
""",
    "projection_fingerprint": "SELECT doc_id, sha256(coalesce(project_key, '-') || ':' || length(doc_id::VARCHAR) || ':' || doc_id || ':' || length(text) || ':' || text || ':1') AS fingerprint FROM documents",
    "uuid5_segment_ids": f"SELECT DISTINCT session_id, start_user_message_id, {_uuid5_sql(ids.SEGMENT_NAMESPACE, 'session_id || chr(0) || start_user_message_id')} AS made_id FROM segment_requests",
    "equivalence_keys": """
SELECT DISTINCT id, CASE WHEN (object_entity_id IS NULL) <> (object_value IS NULL) THEN
  sha256(subject_entity_id || chr(0) || lower(predicate) || chr(0) || CASE WHEN object_value IS NULL THEN 'entity:' || object_entity_id ELSE 'literal:' || lower(object_value) END) END AS made_key FROM claims
""",
    "context_limits": """
WITH m AS (SELECT p_partkey, p_size * 4000 AS c, CASE WHEN p_partkey % 3 = 0 THEN p_size * 3000 END AS i, CASE WHEN p_partkey % 5 = 0 THEN 32000 ELSE p_partkey % 5 * 8000 END AS o FROM part),
l AS (SELECT *, CASE WHEN i IS NOT NULL THEN i - least(20000, o) ELSE c - o END AS usable, greatest(0, least(floor(c * 0.9::DOUBLE), least(coalesce(i, c), c - o))) AS hard FROM m)
SELECT p_partkey, usable::BIGINT AS usable, hard::BIGINT AS hard, greatest(0, least(floor(c * 0.75::DOUBLE), usable, hard))::BIGINT AS threshold, floor(c * 0.25::DOUBLE)::BIGINT AS target, floor(c * 0.05::DOUBLE * 4)::BIGINT AS summary_chars FROM l
""",
}

QUERIES = {f.__name__: f for f in (recall_grouped_topk, vector_topk_direct, vector_topk_entities, graph_one_hop_neighbors, claim_support_counts, claim_support_segments, source_fingerprint, projection_fingerprint, uuid5_segment_ids, equivalence_keys, context_limits)}
