"""Queries over chat messages: turns, segments, tails, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.operators import conversation as conv
from skeinwork.operators import folding, prefix
from skeinwork.session import read
from skeinwork.sources import readers

#: A limit that most sessions reach, beside the standard one.
SMALL = 1_000
TAIL_BUDGET = 1_500


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "chat_messages")


def turns_with_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.turns(_chat(spark, sf_dir)).select("session_id", "user_message_id", "weight", "messages")


def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = [F.col(c) for c in ("role", "error_name", "parts")]
    return conv.latest(_chat(spark, sf_dir)).select("message_id", conv.text_of(*col).alias("text"))


def segment_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.segments(conv.turns(_chat(spark, sf_dir)), SMALL)


def segment_pack_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.segments(conv.turns(_chat(spark, sf_dir)))


def _bounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns, and bounds such as two earlier runs with other limits would have stored."""
    t = conv.turns(_chat(spark, sf_dir))
    older = [conv.segments(t, limit).select("session_id", F.concat("start_id", F.lit(f"-{limit}")).alias("id"), "start_id", "end_id", F.lit(v).alias("version"), F.col("closed").alias("eligible")) for limit, v in ((SMALL, 1), (2 * SMALL, 0))]
    return t, older[0].unionByName(older[1])


def boundary_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.reconcile(*_bounds(spark, sf_dir))


def segment_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between stored bounds; some ask for it the wrong way round or with an unknown end."""
    t, bounds = _bounds(spark, sf_dir)
    odd = bounds.select("session_id", F.when(F.col("version") == 1, F.col("start_id")).otherwise(F.col("end_id")).alias("start_id"), F.when(F.col("version") == 1, F.col("end_id")).otherwise(F.col("start_id")).alias("end_id"))
    return conv.between(t, odd.unionByName(bounds.where("version = 0").select("session_id", "start_id", F.lit("unknown").alias("end_id"))))


def messages_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of their own, brought together again in order; messages without parts keep an empty list."""
    m = conv.latest(_chat(spark, sf_dir)).select("session_id", F.col("message_id").alias("id"), "parts")
    parts = m.select(F.col("id").alias("message_id"), F.posexplode("parts").alias("place", "p")).select("message_id", F.col("place").alias("id"), F.to_json(F.struct(F.concat_ws(":", "p.type", F.coalesce("p.text", "p.tool", "p.filename")).alias("part"))).alias("data"))
    whole = readers.assembled(m.drop("parts"), parts, "part string")
    return whole.select("session_id", F.col("id").alias("message_id"), F.size("parts").alias("n"), F.array_join("parts.part", "|").alias("parts"))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns, and every third segment of an earlier run with a small limit, as bounds that were stored."""
    t = conv.turns(_chat(spark, sf_dir))
    bounds = conv.segments(t, SMALL).where("segment_no % 3 = 1").select("session_id", F.col("start_id").alias("id"), "start_id", "end_id", F.lit(1).alias("version"), F.lit(True).alias("eligible"))
    return t, bounds


def segment_pack_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing around stored bounds, with another limit than they were made with."""
    t, bounds = _stored(spark, sf_dir)
    return conv.segments(t, 2 * SMALL, bounds)


def segment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of stored bounds in order."""
    return conv.read_back(_chat(spark, sf_dir), _stored(spark, sf_dir)[1]).select("session_id", "start_id", "place", "message_id", "role", "text")


def tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages of each session whose texts together stay within the budget; the first that does not ends the tail."""
    col = [F.col(c) for c in ("role", "error_name", "parts")]
    m = conv.latest(_chat(spark, sf_dir)).select("session_id", "message_id", F.col("time_created").alias("at"), F.length(conv.text_of(*col)).cast("long").alias("size"))
    day = -F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / 86_400)
    summed = prefix.running_sum(m, ["session_id"], day, [F.desc("at"), F.desc("message_id")], F.col("size"), "from_here")
    return summed.where(F.col("from_here") <= TAIL_BUDGET).select("session_id", "message_id", "from_here")


def latest_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user and the last assistant message of each session."""
    m = conv.latest(_chat(spark, sf_dir)).where("role in ('user', 'assistant') and session_id is not null")
    last = m.groupBy("session_id", "role").agg(F.max(F.struct("time_created", "message_id")).alias("s"))
    return last.groupBy("session_id").pivot("role", ["user", "assistant"]).agg(F.first("s.message_id")).withColumnsRenamed({"user": "last_user", "assistant": "last_assistant"})


def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of each segment in batches of at most 4 items and 400 bytes."""
    c = read(spark, sf_dir, "claims").select("segment_id", "id", F.concat_ws(" | ", "subject", "predicate", F.coalesce("object_entity", "object_value")).alias("t")).distinct()
    sized = c.groupBy("segment_id", "id").agg(F.max(F.octet_length("t")).cast("double").alias("bytes"))
    return folding.batched(sized, "segment_id", ["id"], "bytes", 4, 400).select("segment_id", "id", F.col("run_no").alias("batch_no"))


_LATEST = """
latest AS (SELECT * EXCLUDE (rn, role), lower(trim(role)) AS role FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY time_updated DESC) AS rn FROM chat_messages) WHERE rn = 1),
seen AS (SELECT *, role = 'user' OR error_name IS NULL OR (error_name = 'MessageAbortedError' AND len(list_filter(parts, lambda p: p.type NOT IN ('step-start', 'reasoning'))) > 0) AS shown,
         list_filter(parts, lambda p: role = 'assistant' OR NOT coalesce(p.ignored, false)) AS vp FROM latest),
w AS (SELECT *, CASE WHEN shown THEN coalesce(list_sum(list_transform(vp, lambda p: CASE
        WHEN p.type IN ('text', 'reasoning') THEN (coalesce(length(p.text), 0) + coalesce(length(regexp_replace(p.text, '[\\x{0}-\\x{ffff}]', '', 'g')), 0))::DOUBLE
        WHEN p.type = 'tool' THEN coalesce(length(p.tool), 0)::DOUBLE + 4
        WHEN p.type = 'file' THEN CASE WHEN coalesce(p.mime, '') LIKE 'image/%' THEN 32000::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE 0::DOUBLE END)), 0) ELSE 0 END AS weight FROM seen),
turns AS (SELECT u.session_id, u.message_id AS user_message_id, u.time_created AS made, u.weight + coalesce(sum(a.weight), 0) AS weight, 1 + count(a.message_id) AS messages
          FROM w u LEFT JOIN (SELECT * FROM w WHERE role = 'assistant' AND shown) a ON a.parent_id = u.message_id AND a.session_id = u.session_id WHERE u.role = 'user' GROUP BY u.session_id, u.message_id, u.time_created, u.weight)
"""


def _packs(limit: int) -> str:
    return f"""WITH RECURSIVE {_LATEST},
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY made, user_message_id) AS i FROM turns),
f AS (SELECT session_id, user_message_id, i, weight, 1 AS run, weight AS size, weight >= {limit} AS ended FROM t WHERE i = 1
      UNION ALL
      SELECT t.session_id, t.user_message_id, t.i, t.weight, CASE WHEN f.ended OR f.size + t.weight > {limit} THEN f.run + 1 ELSE f.run END,
             CASE WHEN f.ended OR f.size + t.weight > {limit} THEN t.weight ELSE f.size + t.weight END,
             CASE WHEN f.ended OR f.size + t.weight > {limit} THEN t.weight ELSE f.size + t.weight END >= {limit}
      FROM f JOIN t ON t.session_id = f.session_id AND t.i = f.i + 1),
p AS (SELECT session_id, run, arg_min(user_message_id, i) AS start_id, arg_max(user_message_id, i) AS end_id, count(*) AS turns, sum(weight) AS weight, bool_or(ended) AS ended FROM f GROUP BY ALL)
SELECT session_id, run::BIGINT AS segment_no, start_id, end_id, turns, weight, ended OR run < max(run) OVER (PARTITION BY session_id) AS closed FROM p
"""


_TEXT = """CASE WHEN shown THEN list_aggregate(list_transform(list_filter(vp, lambda p: p.type IN ('text', 'file')), lambda p: CASE WHEN p.type = 'text' THEN coalesce(p.text, '')
  ELSE '[Attachment' || CASE WHEN coalesce(p.filename, '') <> '' THEN ' ' || left(p.filename, 500) ELSE '' END || CASE WHEN coalesce(p.mime, '') <> '' THEN ' (' || left(p.mime, 200) || ')' ELSE '' END || ']' END), 'string_agg', '') END"""

SQL = {
    "turns_with_weights": f"WITH {_LATEST} SELECT session_id, user_message_id, weight, messages FROM turns",
    "visible_text": f"WITH {_LATEST} SELECT message_id, coalesce({_TEXT}, '') AS text FROM seen",
    "segment_pack": _packs(SMALL),
    "segment_pack_standard": _packs(conv.LIMIT),
    "messages_with_parts": f"""WITH {_LATEST} SELECT session_id, message_id, len(parts)::INT AS n,
coalesce(list_aggregate(list_transform(parts, lambda p: concat_ws(':', p.type, coalesce(p.text, p.tool, p.filename))), 'string_agg', '|'), '') AS parts FROM latest""",
    "tail_budget": f"""WITH {_LATEST}, s AS (SELECT session_id, message_id, sum(length(coalesce({_TEXT}, ''))) OVER (PARTITION BY session_id ORDER BY time_created DESC, message_id DESC)::BIGINT AS from_here FROM seen)
SELECT * FROM s WHERE from_here <= {TAIL_BUDGET}""",
    "latest_by_role": f"""WITH {_LATEST} SELECT session_id, arg_max(message_id, (time_created, message_id)) FILTER (WHERE role = 'user') AS last_user, arg_max(message_id, (time_created, message_id)) FILTER (WHERE role = 'assistant') AS last_assistant
FROM latest WHERE role IN ('user', 'assistant') AND session_id IS NOT NULL GROUP BY session_id""",
    "embedding_batches": """WITH RECURSIVE c AS (SELECT segment_id, id, max(strlen(concat_ws(' | ', subject, predicate, coalesce(object_entity, object_value)))) AS b FROM claims GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY id) AS i FROM c),
f AS (SELECT segment_id, id, i, 1::BIGINT AS run, b AS size, 1 AS n FROM t WHERE i = 1 UNION ALL
      SELECT t.segment_id, t.id, t.i, CASE WHEN f.n >= 4 OR f.size + t.b > 400 THEN f.run + 1 ELSE f.run END, CASE WHEN f.n >= 4 OR f.size + t.b > 400 THEN t.b ELSE f.size + t.b END,
             CASE WHEN f.n >= 4 OR f.size + t.b > 400 THEN 1 ELSE f.n + 1 END FROM f JOIN t ON t.segment_id = f.segment_id AND t.i = f.i + 1)
SELECT segment_id, id, run AS batch_no FROM f""",
}

SQL["segment_read_back"] = f"""WITH RECURSIVE a1 AS ({_packs(SMALL)}), a2 AS ({_packs(2 * SMALL)}), {_LATEST},
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY made, user_message_id) AS i FROM turns),
b AS (SELECT session_id, start_id, end_id FROM a1 UNION SELECT session_id, end_id, start_id FROM a2 UNION SELECT session_id, start_id, 'unknown' FROM a2),
j AS (SELECT b.*, x.i AS a, y.i AS z FROM b LEFT JOIN n x ON x.session_id = b.session_id AND x.user_message_id = b.start_id LEFT JOIN n y ON y.session_id = b.session_id AND y.user_message_id = b.end_id),
s AS (SELECT session_id, start_id, end_id, a, z, CASE WHEN a IS NULL OR z IS NULL THEN 'missing' WHEN a > z THEN 'reversed' END AS problem FROM j),
r AS (SELECT session_id, i, sum(weight) OVER (PARTITION BY session_id ORDER BY i) AS upto, weight FROM n)
SELECT s.session_id, s.start_id, s.end_id, CASE WHEN problem IS NULL THEN z - a + 1 END AS turns, CASE WHEN problem IS NULL THEN p.upto - (q.upto - q.weight) END AS weight, problem
FROM s LEFT JOIN r p ON p.session_id = s.session_id AND p.i = s.z LEFT JOIN r q ON q.session_id = s.session_id AND q.i = s.a"""

SQL["segment_pack_bounded"] = f"""WITH RECURSIVE {_LATEST}, a1 AS ({_packs(SMALL)}),
t0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY made, user_message_id) AS i FROM turns),
s1 AS (SELECT session_id, start_id, end_id, segment_no FROM a1 WHERE segment_no % 3 = 1),
k AS (SELECT s1.session_id, s1.segment_no AS b, x.i AS a, y.i AS z FROM s1 JOIN t0 x ON x.session_id = s1.session_id AND x.user_message_id = s1.start_id JOIN t0 y ON y.session_id = s1.session_id AND y.user_message_id = s1.end_id),
t AS (SELECT t0.*, k.b FROM t0 LEFT JOIN k ON k.session_id = t0.session_id AND t0.i BETWEEN k.a AND k.z),
f AS (SELECT session_id, user_message_id, i, weight, b, 1 AS run, weight AS size, b IS NOT NULL OR weight >= {2 * SMALL} AS ended FROM t WHERE i = 1
      UNION ALL
      SELECT n.session_id, n.user_message_id, n.i, n.weight, n.b, CASE WHEN fresh THEN run + 1 ELSE run END, CASE WHEN fresh THEN n.weight ELSE size + n.weight END,
             n.b IS NOT NULL OR CASE WHEN fresh THEN n.weight ELSE size + n.weight END >= {2 * SMALL}
      FROM (SELECT t.session_id, t.user_message_id, t.i, t.weight, t.b, f.run, f.size,
                   t.b IS DISTINCT FROM f.b OR (t.b IS NULL AND (f.ended OR f.size + t.weight > {2 * SMALL})) AS fresh FROM f JOIN t ON t.session_id = f.session_id AND t.i = f.i + 1) n),
p AS (SELECT session_id, run, arg_min(user_message_id, i) AS start_id, arg_max(user_message_id, i) AS end_id, count(*) AS turns, sum(weight) AS weight, bool_or(ended) AS ended FROM f GROUP BY ALL)
SELECT session_id, run::BIGINT AS segment_no, start_id, end_id, turns, weight, ended OR run < max(run) OVER (PARTITION BY session_id) AS closed FROM p"""
SQL["segment_messages"] = f"""WITH RECURSIVE {_LATEST}, a1 AS ({_packs(SMALL)}),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY made, user_message_id) AS i FROM turns),
k AS (SELECT s.session_id, s.start_id, x.i AS a, y.i AS z FROM a1 s JOIN n x ON x.session_id = s.session_id AND x.user_message_id = s.start_id JOIN n y ON y.session_id = s.session_id AND y.user_message_id = s.end_id WHERE segment_no % 3 = 1),
said AS (SELECT session_id, message_id, role, time_created, CASE WHEN role = 'user' THEN message_id ELSE parent_id END AS opener, coalesce({_TEXT}, '') AS text FROM seen WHERE shown AND role IN ('user', 'assistant'))
SELECT k.session_id, k.start_id, row_number() OVER (PARTITION BY k.session_id, k.start_id ORDER BY said.time_created, said.message_id)::INT AS place, said.message_id, said.role, said.text
FROM k JOIN n ON n.session_id = k.session_id AND n.i BETWEEN k.a AND k.z JOIN said ON said.session_id = n.session_id AND said.opener = n.user_message_id"""

QUERIES = {f.__name__: f for f in (turns_with_weights, visible_text, segment_pack, segment_pack_standard, boundary_reconcile, segment_pack_bounded, segment_messages, segment_read_back, messages_with_parts, tail_budget, latest_by_role, embedding_batches)}
