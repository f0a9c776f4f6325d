"""Queries of the training-text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import knn, language, mixing, names, neardup, packing, pii, split, threads, tokens
from skeinwork.session import read

#: Dimension of the embeddings.
DIM = 64


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each claim and each entity vector the 5 most similar others of its table."""
    return knn.neighbours(read(spark, sf_dir, "claims"), DIM).withColumn("collection", F.lit("claim")).unionByName(knn.neighbours(read(spark, sf_dir, "entities"), DIM).withColumn("collection", F.lit("entity")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which either is among the 5 most similar of the other."""
    parts = [knn.mutual_pairs(knn.neighbours(read(spark, sf_dir, table), DIM)).select(F.lit(name).alias("collection"), "id_a", "id_b") for name, table in (("claim", "claims"), ("entity", "entities"))]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that had to be split."""
    return p2_pieces(spark, sf_dir).select("segment_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every segment over the limit."""
    return split.split(read(spark, sf_dir, "segment_requests"), "segment_id", "messages").withColumnRenamed("id", "segment_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal items in the texts of all messages."""
    return pii.found(read(spark, sf_dir, "segment_requests")).select(F.col("id").alias("segment_id"), "message_no", "pii_type", "pii_text").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders in place of personal items."""
    requests = read(spark, sf_dir, "segment_requests")
    return pii.masked(requests, pii.found(requests)).withColumnRenamed("id", "segment_id")


def _long_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = read(spark, sf_dir, "claims").where(F.length("object_value") >= 60)
    return claims.select("id", neardup.words(F.col("subject"), F.col("predicate"), F.col("object_value")).alias("words"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of claims with a long object_value whose words agree to 0.6 or more."""
    return neardup.expand(*neardup.similar(_long_claims(spark, sf_dir)))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim with a long object_value, its class of equal words, its group and its class's number of links."""
    classes, links = neardup.similar(_long_claims(spark, sf_dir))
    return neardup.grouped(classes, links)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that each mention's text names."""
    return names.link(read(spark, sf_dir, "mentions"), read(spark, sf_dir, "entity_candidates")).select("mention_key", "entity_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of whole sessions in order."""
    return threads.whole_sessions(read(spark, sf_dir, "chat_messages")).select("session_id", "turn_no", "message_id")


def p7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of every reply: the recorded one, else the likeliest."""
    return threads.links(read(spark, sf_dir, "chat_messages"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(read(spark, sf_dir, "documents"), "doc_id", "text", {"source": "source"})


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of each document."""
    return packing.fill(_sized(spark, sf_dir))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of capacity used."""
    return packing.usage(p8_containers(spark, sf_dir))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture in order."""
    return mixing.mixture(_sized(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source really has."""
    return mixing.shares(p9_mixture(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return language.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lang_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of documents whose label is missing or wrong, or that mix languages."""
    return language.mislabelled(p10_stretches(spark, sf_dir)).select("doc_id", "segment_no", "lang_code")


_NAMES = (
    p1_found, p1_neighbours, p2_found, p2_pieces, p3_found, p3_masked, p4_found, p4_groups, p6_found, p7_found, p7_links, p8_containers, p8_usage, p9_mixture, p9_shares, p10_found, p10_stretches,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


def oracle_sql() -> dict[str, str]:
    return SQL


SQL = {
    "p2_found": """
SELECT segment_id FROM (SELECT DISTINCT segment_id, messages FROM segment_requests WHERE segment_id IS NOT NULL)
WHERE list_sum(list_transform(messages, lambda m: length(coalesce(m.text, '')) + length(regexp_replace(coalesce(m.text, ''), '[\\x{0}-\\x{ffff}]', '', 'g')))) > 20000
GROUP BY segment_id
""",
    "p4_found": """
WITH w AS (SELECT DISTINCT id, list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object_value)), '[\\p{L}\\p{N}]+')) AS words
           FROM claims WHERE id IS NOT NULL AND length(object_value) >= 60),
s AS (SELECT id, words, len(words) AS n FROM w WHERE len(words) > 0),
p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.words, b.words)) AS common, a.n + b.n AS total FROM s a JOIN s b ON a.id < b.id AND 10 * least(a.n, b.n) >= 6 * greatest(a.n, b.n))
SELECT DISTINCT id_a, id_b FROM p WHERE 10 * common >= 6 * (total - common)
""",
    "p7_found": """
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY time_updated DESC) AS rn FROM chat_messages) WHERE rn = 1),
m AS (SELECT message_id, session_id, lower(trim(coalesce(role, ''))) AS role, parent_id, time_created AS made,
             (error_name IS NULL OR error_name = 'MessageAbortedError')
             AND len(list_filter(parts, lambda p: p.type = 'text' AND NOT coalesce(p.ignored, false) AND regexp_matches(coalesce(p.text, ''), '[^\\s]'))) > 0 AS speaks
      FROM latest),
r AS (SELECT a.*, u.message_id AS parent, u.made AS asked FROM m a LEFT JOIN m u ON u.message_id = a.parent_id AND u.session_id = a.session_id AND u.role = 'user' AND a.role = 'assistant'),
n AS (SELECT parent, count(*) AS answers FROM r WHERE parent IS NOT NULL AND speaks GROUP BY parent),
j AS (SELECT r.*, n.answers FROM r LEFT JOIN n ON n.parent = r.message_id),
kept AS (SELECT session_id FROM j GROUP BY session_id
         HAVING bool_and(role IN ('user', 'assistant') AND CASE WHEN role = 'assistant' THEN parent IS NOT NULL ELSE speaks AND answers IS NOT NULL END))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(asked, made), coalesce(parent, message_id), role = 'assistant', made, message_id)::INT AS turn_no, message_id
FROM j WHERE speaks AND session_id IN (SELECT session_id FROM kept)
""",
}
