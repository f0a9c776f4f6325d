"""Queries over names, claims and the keeping of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions import text
from skeinwork.operators import candidates, recall, tables
from skeinwork.plans import changes
from skeinwork.session import read


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: mentions whose key is divisible by 20."""
    return read(spark, sf_dir, "mentions").where("mention_key % 20 = 0").select(F.col("mention_key").alias("query"), "text").distinct()


def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates.by_trigrams(_mentions(spark, sf_dir), candidates.entity_names(read(spark, sf_dir, "entity_candidates")))
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by trigrams, and vectors of the embedding of the same number."""
    q = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query"), F.col("embedding").alias("vector"))
    items = recall.usable(read(spark, sf_dir, "entities"), 64, "id", "embedding", [])
    near = candidates.by_trigrams(_mentions(spark, sf_dir), candidates.entity_names(read(spark, sf_dir, "entity_candidates")))
    return candidates.union(near, recall.nearest(q, items, 64, candidates.EACH))


def described_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates by name with the entity's name and its aliases in order of their normal form."""
    e = read(spark, sf_dir, "entity_candidates")
    found = candidates.described(candidates.by_trigrams(_mentions(spark, sf_dir), candidates.entity_names(e)), e)
    return found.select("query", "id", "place", "canonical_name", F.array_join("aliases", "|").alias("aliases"))


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "mentions").select("text", text.normalize_name(F.col("text")).alias("normal")).distinct()


def predicate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "claims").select("predicate").distinct().select("predicate", text.normalize_predicate(F.col("predicate")).alias("normal"), text.natural_predicate(F.col("predicate")).alias("natural"))


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "segment_requests").select("segment_id", "messages").distinct().select("segment_id", F.posexplode("messages").alias("place", "m"))
    return m.select("segment_id", "place", F.length("m.text").alias("points"), text.utf8_length(F.col("m.text")).alias("bytes"), text.utf16_length(F.col("m.text")).alias("units"))


def copied_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(text.identifiers(F.col("text"))).alias("identifier"))


def unsupported_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a claim that its segment's texts do not have."""
    sources = read(spark, sf_dir, "segment_requests").select("segment_id", F.array_join("messages.text", "\n").alias("source")).groupBy("segment_id").agg(F.max("source").alias("source"))
    c = read(spark, sf_dir, "claims").select("id", "segment_id", F.concat_ws("\n", "subject", "predicate", "object_entity", "object_value").alias("output"))
    c = c.groupBy("id").agg(F.max(F.struct("segment_id", "output")).alias("s")).select("id", "s.segment_id", "s.output")
    return c.join(sources, "segment_id").select("id", F.explode(text.unsupported(F.col("output"), F.col("source"))).alias("identifier"))


def mention_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's mentions: its subject, and its object if that is an entity, with the claim as display text."""
    c = read(spark, sf_dir, "claims")
    shown = F.concat_ws(" | ", "subject", "predicate", F.coalesce("object_entity", "object_value"))
    ends = F.array_compact(F.array(F.struct(F.lit("subject").alias("role"), F.col("subject").alias("text")), F.when(F.col("object_entity").isNotNull(), F.struct(F.lit("object").alias("role"), F.col("object_entity").alias("text")))))
    return c.select("id", shown.alias("supporting_claim"), F.explode(ends).alias("e")).select("id", "e.role", "e.text", "supporting_claim").distinct()


def tagged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tagged object per claim, and back to two columns."""
    c = read(spark, sf_dir, "claims").select("id", F.when(F.col("object_entity").isNotNull(), "entity").otherwise("literal").alias("kind"), F.coalesce("object_entity", "object_value").alias("object")).distinct()
    return c.select("id", "kind", F.when(F.col("kind") == "entity", F.col("object")).alias("entity"), F.when(F.col("kind") == "literal", F.col("object")).alias("value"))


def alias_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each entity, of one normal form the first: canonical name, then aliases in order."""
    e = read(spark, sf_dir, "entities").select("id", F.posexplode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array()))).alias("place", "alias")).where("alias is not null").distinct()
    return tables.first_spelling(e, "id", "alias", text.normalize_name(F.col("alias")), ["place", "alias"])


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with every third one changed, every fifth of those moved to a key of its own."""
    c = read(spark, sf_dir, "customer")
    updates = c.where("c_custkey % 3 = 0").withColumns({"c_custkey": F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey")), "c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("CHANGED")})
    return tables.upsert(c, updates, ["c_custkey"], keep=("c_mktsegment",))


def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every seventh order replaced by its first line alone."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = li.where("l_orderkey % 7 = 0 and l_linenumber = 1").withColumn("l_quantity", F.lit(1.0).cast(li.schema["l_quantity"].dataType))
    return tables.replace_partitions(li, fresh, "l_orderkey")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims left when the segments of projection version 0 are deleted."""
    kept = read(spark, sf_dir, "segment_requests").where("projection_version > 0")
    return tables.cascade(read(spark, sf_dir, "claims").select("id", "segment_id").distinct(), kept, "segment_id", "segment_id")


def superseded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job changes left when those of segments that a request in version 0 names are deleted."""
    gone = read(spark, sf_dir, "segment_requests").where("projection_version = 0").select("segment_id")
    return tables.delete(read(spark, sf_dir, "job_changes").select("change_no", "segment_id"), gone, ["segment_id"])


def orphan_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.orphans(read(spark, sf_dir, "entities"), read(spark, sf_dir, "claims"))


def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "one kind of object": F.col("object_entity").isNull() != F.col("object_value").isNull(),
        "confidence from 0 to 1": F.col("confidence").between(0, 1),
        "natural predicate": text.natural_predicate(F.col("predicate")),
        "trimmed subject": F.col("subject") == F.trim("subject"),
        "vector of 64": F.size("embedding") == 64,
    }
    return tables.violations(read(spark, sf_dir, "claims"), "id", rules)


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that were requested against those that have mentions."""
    return tables.coverage(read(spark, sf_dir, "segment_requests"), read(spark, sf_dir, "mentions").select("segment_id", "mention_key").distinct(), "segment_id")


def latest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that counts of each segment: running before pending before others, then the latest generation, nulls last."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).otherwise(2)
    order = [rank, F.desc_nulls_last("source_generation"), F.desc("attempts"), F.desc("change_no")]
    return tables.first_of(read(spark, sf_dir, "job_changes"), ["segment_id"], order).select("segment_id", "change_no", "status", "source_generation")


def generation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("segment_id").orderBy("change_no"))
    highest = read(spark, sf_dir, "job_changes").groupBy("segment_id").agg(F.max("source_generation").alias("highest"))
    return read(spark, sf_dir, "job_changes").select("segment_id", "change_no", place.alias("number")).join(highest, "segment_id")


def not_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed changes after which nothing newer of their segment was asked for."""
    j = read(spark, sf_dir, "job_changes").select("change_no", "segment_id", "source_generation", "changed_at", "status")
    newest = j.where("status <> 'failed'").groupBy(F.col("segment_id").alias("s")).agg(F.max("changed_at").alias("newest"))
    failed = j.where("status = 'failed'")
    return failed.join(newest, (F.col("segment_id") == F.col("s")) & (F.col("newest") > F.col("changed_at")), "left_anti").select("change_no", "segment_id")


def fingerprint_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints that the first change of each segment gave and that still are those of its latest generation."""
    j = read(spark, sf_dir, "job_changes").where("source_generation is not null")
    first = tables.first_of(j, ["segment_id"], [F.col("change_no")]).select("segment_id", "source_fingerprint")
    last = tables.first_of(j, ["segment_id"], [F.desc("source_generation"), F.desc("attempts"), F.desc("change_no")]).where("change_no % 5 <> 0").select("segment_id", "source_fingerprint")
    return tables.still_valid(first, last, ["segment_id"], "source_fingerprint")


def changed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose fingerprint is distinct, null-safely, from that of the segment's change before."""
    w = Window.partitionBy("segment_id").orderBy("change_no")
    j = read(spark, sf_dir, "job_changes").select("segment_id", "change_no", "source_fingerprint", F.lag("source_fingerprint").over(w).alias("before"))
    return j.where(~F.col("source_fingerprint").eqNullSafe(F.col("before"))).select("segment_id", "change_no")


def segment_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and job changes as one list of rows with empty columns where a kind has none, numbered in order of a session."""
    r = read(spark, sf_dir, "segment_requests").select("session_id", "segment_id", F.lit("request").alias("kind"), "created_at", F.col("projection_version").alias("version"), F.lit(None).cast("bigint").alias("source_generation")).distinct()
    j = read(spark, sf_dir, "job_changes").select("segment_id", F.lit("change").alias("kind"), F.col("changed_at").alias("created_at"), "source_generation").distinct()
    of = r.select("session_id", "segment_id").distinct()
    both = r.unionByName(j.join(of, "segment_id"), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "segment_id", F.desc("kind"), F.col("source_generation").asc_nulls_last()))
    return both.select("session_id", place.alias("place"), "segment_id", "kind", "version", "source_generation")


def prior_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many segments of its session come before each, and which one is the last of them."""
    r = read(spark, sf_dir, "segment_requests").groupBy("session_id", "segment_id").agg(F.min("created_at").alias("at"))
    w = Window.partitionBy("session_id").orderBy("at", "segment_id")
    return r.select("session_id", "segment_id", (F.row_number().over(w) - 1).alias("prior"), F.lag("segment_id").over(w).alias("last_prior"))


def segment_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested segments by whether claims of them exist and whether their change feed ends in a delete."""
    r = read(spark, sf_dir, "segment_requests").select("segment_id", F.size("messages").alias("messages")).distinct()
    c = read(spark, sf_dir, "claims").select(F.col("segment_id").alias("c")).distinct()
    d = changes.p5_tombstones(spark, sf_dir).select(F.col("segment_id").alias("d"))
    status = F.when(F.col("d").isNotNull(), "stale").when(F.col("c").isNotNull(), "known").otherwise("new")
    return r.join(c, F.col("segment_id") == F.col("c"), "left").join(d, F.col("segment_id") == F.col("d"), "left").groupBy(status.alias("status")).agg(F.count("*").alias("segments"), F.sum("messages").alias("messages"))


def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts and suppliers by the orders and customers that support them."""
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


_SPACED = "trim(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '[\\s\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'), ' +', ' ', 'g'))"
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"

_TRIGRAMS = f"""
names AS (SELECT DISTINCT id, name FROM (SELECT id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS name FROM entity_candidates) WHERE name IS NOT NULL),
qs AS (SELECT DISTINCT mention_key AS query, text FROM mentions WHERE mention_key % 20 = 0),
qg AS (SELECT text, {_GRAMS.format('text')} AS g FROM (SELECT DISTINCT text FROM qs)), ng AS (SELECT name, {_GRAMS.format('name')} AS h FROM (SELECT DISTINCT name FROM names)),
pairs AS (SELECT text, name, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS similarity FROM qg, ng WHERE len(list_intersect(g, h)) > 0),
best AS (SELECT text, id, max(similarity) AS similarity FROM pairs JOIN names USING (name) WHERE similarity >= 0.3::DOUBLE GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY similarity DESC, id) AS place FROM best) WHERE place <= 5),
tri AS (SELECT query, id, similarity, place FROM qs JOIN ranked USING (text))
"""

SQL = {
    "trigram_candidates": f"WITH {_TRIGRAMS} SELECT query, id, round(similarity, 6) AS similarity, place::INT AS place FROM tri",
    "candidate_union": f"""WITH {_TRIGRAMS},
u AS (SELECT id, list_transform(any_value(embedding), lambda x: x::DOUBLE) AS w FROM entities WHERE len(embedding) = 64 GROUP BY id),
q AS (SELECT vec_id::BIGINT AS query, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % 20 = 0),
vec AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY list_dot_product(q.w, u.w) / sqrt(list_dot_product(u.w, u.w) * list_dot_product(q.w, q.w)) DESC, id) AS place FROM q, u),
b AS (SELECT query, id, place, 0 AS r FROM tri UNION ALL SELECT query, id, place, 1 FROM vec WHERE place <= 5),
o AS (SELECT query, id, min((r, place)) AS m FROM b GROUP BY ALL)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY m)::INT AS place, CASE WHEN m[1] = 0 THEN 'name' ELSE 'vector' END AS source FROM o""",
    "described_candidates": f"""WITH {_TRIGRAMS},
a AS (SELECT id, unnest(aliases) AS alias FROM entity_candidates), n AS (SELECT id, alias, replace(lower({_SPACED.format('alias')}), 'ß', 'ss') AS normal FROM a WHERE alias IS NOT NULL),
l AS (SELECT id, string_agg(alias, '|' ORDER BY normal, alias) AS aliases FROM n GROUP BY id)
SELECT query, tri.id, place::INT AS place, canonical_name, coalesce(l.aliases, '') AS aliases FROM tri JOIN entity_candidates e ON e.id = tri.id LEFT JOIN l ON l.id = tri.id""",
    "normalize_names": f"SELECT DISTINCT text, replace(lower({_SPACED.format('text')}), 'ß', 'ss') AS normal FROM mentions",
    "predicate_normalize": r"""SELECT predicate, trim(regexp_replace(lower(regexp_replace(regexp_replace(replace(predicate, '_', ' '), '([A-Z]{3,})([A-Z][a-z]{2,})', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g')), '\s+', ' ', 'g')) AS normal,
length(trim(predicate)) BETWEEN 1 AND 500 AND NOT contains(predicate, '_') AND NOT regexp_matches(predicate, '[a-z][A-Z]') AS natural FROM (SELECT DISTINCT predicate FROM claims)""",
    "text_lengths": r"""SELECT segment_id, (place - 1)::INT AS place, length(t)::INT AS points, strlen(t)::INT AS bytes, (length(t) + length(regexp_replace(t, '[\x{0}-\x{ffff}]', '', 'g')))::INT AS units
FROM (SELECT segment_id, unnest(range(1, len(messages) + 1)) AS place, unnest(list_transform(messages, lambda m: m.text)) AS t FROM (SELECT DISTINCT segment_id, messages FROM segment_requests))""",
    "mention_explode": """WITH c AS (SELECT DISTINCT id, subject, object_entity, concat_ws(' | ', subject, predicate, coalesce(object_entity, object_value)) AS supporting_claim FROM claims)
SELECT DISTINCT id, 'subject' AS role, subject AS text, supporting_claim FROM c UNION SELECT id, 'object', object_entity, supporting_claim FROM c WHERE object_entity IS NOT NULL""",
    "tagged_objects": "SELECT DISTINCT id, CASE WHEN object_entity IS NULL THEN 'literal' ELSE 'entity' END AS kind, object_entity AS entity, CASE WHEN object_entity IS NULL THEN object_value END AS value FROM claims",
    "alias_dedupe": f"""WITH a AS (SELECT DISTINCT id, unnest(range(0, len(l))) AS place, unnest(l) AS alias FROM (SELECT id, list_concat([canonical_name], coalesce(aliases, [])) AS l FROM entities)),
n AS (SELECT *, replace(lower({_SPACED.format('alias')}), 'ß', 'ss') AS normal FROM a WHERE alias IS NOT NULL)
SELECT id, alias, normal FROM (SELECT *, row_number() OVER (PARTITION BY id, normal ORDER BY place, alias) AS rn FROM n) WHERE rn = 1""",
    "upsert_merge": """SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, 0.0::DOUBLE, 'CHANGED' FROM customer WHERE c_custkey % 15 = 0""",
    "replace_partition": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1)
UNION ALL SELECT l_orderkey, l_linenumber, 1.0::DOUBLE FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1""",
    "cascade_delete": "SELECT DISTINCT id, segment_id FROM claims WHERE segment_id IN (SELECT segment_id FROM segment_requests WHERE projection_version > 0) OR segment_id IS NULL",
    "superseded_delete": "SELECT change_no, segment_id FROM job_changes WHERE segment_id NOT IN (SELECT segment_id FROM segment_requests WHERE projection_version = 0 AND segment_id IS NOT NULL)",
    "orphan_entities": "SELECT DISTINCT id FROM entities e WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM claims WHERE subject_entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM claims WHERE object_entity_id = e.id)",
    "validation_violations": """SELECT DISTINCT id, rule FROM (
SELECT id, 'one kind of object' AS rule FROM claims WHERE (object_entity IS NULL) = (object_value IS NULL) UNION ALL SELECT id, 'confidence from 0 to 1' FROM claims WHERE confidence IS NULL OR confidence NOT BETWEEN 0 AND 1 UNION ALL
SELECT id, 'natural predicate' FROM claims WHERE contains(predicate, '_') OR regexp_matches(predicate, '[a-z][A-Z]') OR length(trim(predicate)) NOT BETWEEN 1 AND 500 UNION ALL
SELECT id, 'trimmed subject' FROM claims WHERE subject <> trim(subject) UNION ALL SELECT id, 'vector of 64' FROM claims WHERE embedding IS NULL OR len(embedding) <> 64)""",
    "coverage_gaps": """WITH w AS (SELECT DISTINCT segment_id FROM segment_requests), a AS (SELECT segment_id, count(DISTINCT mention_key) AS n FROM mentions GROUP BY ALL)
SELECT coalesce(w.segment_id, a.segment_id) AS segment_id, CASE WHEN a.segment_id IS NULL THEN 'missing' WHEN w.segment_id IS NULL THEN 'unknown' ELSE 'repeated' END AS problem
FROM w FULL JOIN a ON w.segment_id = a.segment_id WHERE a.segment_id IS NULL OR w.segment_id IS NULL OR n > 1""",
    "latest_target": """SELECT segment_id, change_no, status, source_generation FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END,
source_generation DESC NULLS LAST, attempts DESC, change_no DESC) AS rn FROM job_changes) WHERE rn = 1""",
    "generation_numbers": "SELECT segment_id, change_no, row_number() OVER (PARTITION BY segment_id ORDER BY change_no)::INT AS number, max(source_generation) OVER (PARTITION BY segment_id) AS highest FROM job_changes",
    "not_superseded": "SELECT change_no, segment_id FROM job_changes f WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM job_changes n WHERE n.segment_id = f.segment_id AND n.status <> 'failed' AND n.changed_at > f.changed_at)",
    "fingerprint_cache": """WITH j AS (SELECT * FROM job_changes WHERE source_generation IS NOT NULL),
f AS (SELECT segment_id, source_fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY change_no) AS rn FROM j) WHERE rn = 1),
l AS (SELECT segment_id, source_fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY source_generation DESC, attempts DESC NULLS LAST, change_no DESC) AS rn FROM j) WHERE rn = 1 AND change_no % 5 <> 0)
SELECT f.segment_id, f.source_fingerprint FROM f LEFT JOIN l ON l.segment_id = f.segment_id WHERE l.segment_id IS NULL OR l.source_fingerprint IS NOT DISTINCT FROM f.source_fingerprint""",
    "changed_fingerprints": "SELECT segment_id, change_no FROM (SELECT *, lag(source_fingerprint) OVER (PARTITION BY segment_id ORDER BY change_no) AS b FROM job_changes) WHERE source_fingerprint IS DISTINCT FROM b",
    "segment_listing": """WITH r AS (SELECT DISTINCT session_id, segment_id, 'request' AS kind, created_at, projection_version AS version, NULL::BIGINT AS source_generation FROM segment_requests),
j AS (SELECT DISTINCT segment_id, 'change' AS kind, changed_at AS created_at, source_generation FROM job_changes),
b AS (SELECT * FROM r UNION ALL SELECT s.session_id, segment_id, j.kind, j.created_at, NULL, j.source_generation FROM j JOIN (SELECT DISTINCT session_id, segment_id FROM r) s USING (segment_id))
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, segment_id, kind DESC, source_generation ASC NULLS LAST)::INT AS place, segment_id, kind, version, source_generation FROM b""",
    "prior_segments": """WITH r AS (SELECT session_id, segment_id, min(created_at) AS made FROM segment_requests GROUP BY ALL)
SELECT session_id, segment_id, (row_number() OVER w - 1)::INT AS prior, lag(segment_id) OVER w AS last_prior FROM r WINDOW w AS (PARTITION BY session_id ORDER BY made, segment_id)""",
    "segment_status_counts": f"""WITH r AS (SELECT DISTINCT segment_id, len(messages) AS n FROM segment_requests), gone AS ({changes.SQL["p5_tombstones"]})
SELECT CASE WHEN segment_id IN (SELECT segment_id FROM gone) THEN 'stale' WHEN segment_id IN (SELECT segment_id FROM claims WHERE segment_id IS NOT NULL) THEN 'known' ELSE 'new' END AS status,
count(*) AS segments, sum(n)::BIGINT AS messages FROM r GROUP BY 1""",
    "edge_support": "SELECT l_partkey, l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
}

QUERIES = {
    f.__name__: f
    for f in (
        trigram_candidates, candidate_union, described_candidates, normalize_names, predicate_normalize, text_lengths, copied_identifiers, unsupported_identifiers, mention_explode, tagged_objects, alias_dedupe, upsert_merge, replace_partition,
        cascade_delete, superseded_delete, orphan_entities, validation_violations, coverage_gaps, latest_target, generation_numbers, not_superseded, fingerprint_cache, changed_fingerprints, segment_listing, prior_segments, segment_status_counts, edge_support,
    )
}
