"""Conversations rebuilt from message rows: reply links, link trees, and the sessions that are whole.

Every reply gets one parent among the user messages of its session by one score: a recorded parent that is such a message,
closeness in time, standing next to it, identifiers the reply mentions, and words in common. The record's weight exceeds all
other terms together, so a reply that has it needs no other candidate. Replies whose record is lost or wrong are disentangled;
their candidates are the last question before and the first one after, of all questions of the session and of those that name
one of the reply's identifiers. On either side a farther question that names nothing of the reply's can never win: its time
counts less, and all its words less than standing next to it.

Links form trees of a user message and its replies; a session counts as whole only if every link in it is recorded.

Hot sessions: links are joined by message, aggregates are combined before the shuffle, candidates are found in hour slots of a
session, and the final order is one range shuffle in which a session spans as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.operators.prefix import numbered
from skeinwork.session import counted_small, cut, small

ABORTED = "MessageAbortedError"
SLOT_S = 3_600
#: Weights of the record, of time, of mentioned identifiers and of common words.
RECORD, TIME, MENTION, WORDS = 10.0, 1.0, 1.5, 0.2
#: What standing next to a reply counts: the last question before it, and the first after it. Not below WORDS (see above).
NEXT_BEFORE, NEXT_AFTER = 0.5, 0.2
#: Seconds in which the weight of time falls to 1/e.
FADE_S = 600.0
#: Factor of the weight of time where clocks disagree so that the question is timed after the reply.
BEHIND = 0.25
_NAMES, _PLAIN = r"[\p{L}\p{N}]+(?:[_./-][\p{L}\p{N}]+)+", r"[\p{L}\p{N}]{3,}"

def messages(rows: DataFrame) -> DataFrame:
    """One row per message_id in its latest state: session_id, role (trimmed, lower case), parent_id, at, speaks, said.

    `said` is the text of the text parts that are not ignored; a message speaks if that is not all blank and there is no error
    but an abort. Rows without message_id are left out; of states of equal time_updated the greatest counts.
    """
    texts = F.transform(F.filter(F.coalesce("parts", F.array()), lambda p: (p["type"] == "text") & ~F.coalesce(p["ignored"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit("")))
    blank = F.forall(texts, lambda t: t.rlike(r"(?U)^\s*$"))
    state = rows.where(F.col("message_id").isNotNull()).select(
        "message_id",
        F.struct(
            "time_updated", "session_id", F.regexp_replace(F.lower(F.coalesce("role", F.lit(""))), r"(?U)^\s+|\s+$", "").alias("role"), "parent_id",
            F.col("time_created").alias("at"), (~blank & (F.col("error_name").isNull() | (F.col("error_name") == ABORTED))).alias("speaks"), F.array_join(texts, "\n").alias("said"),
        ).alias("s"),
    )
    return state.groupBy("message_id").agg(F.max("s").alias("s")).select("message_id", "s.session_id", "s.role", "s.parent_id", "s.at", "s.speaks", "s.said")


def _tokens(text, pattern: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def _share(a, b):
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def recorded(m: DataFrame) -> DataFrame:
    """(session_id, message_id, at, speaks, parent, asked): every reply; parent is its parent_id and asked that one's time if it
    is a user message of the session, else both are null."""
    users = m.where("role = 'user'").select(F.col("message_id").alias("parent"), F.col("session_id").alias("_session"), F.col("at").alias("asked"))
    replies = m.where("role = 'assistant'").select("session_id", "message_id", "at", "speaks", "parent_id")
    joined = replies.join(users, (F.col("parent_id") == F.col("parent")) & F.col("session_id").eqNullSafe(F.col("_session")), "left")
    return joined.select("session_id", "message_id", "at", "speaks", "parent", "asked")


def _neighbours(events: DataFrame) -> DataFrame:
    """(message_id, parent, side): for each reply event the last question before it and the first after it, of the same session and token.

    events: (session_id, token, at, asks, message_id). Order is by time, then id, a question before a reply of its time. Fine
    order is settled within hour slots; what goes from slot to slot is one question.
    """
    slot = F.coalesce(F.floor(F.unix_micros(F.col("at").cast("timestamp")) / (SLOT_S * 1_000_000)), F.lit(-(1 << 40)))
    question = F.when(F.col("asks"), F.struct("at", "message_id"))
    rows = events.withColumn("slot", slot)
    group = ["session_id", "token"]
    ends = rows.where("asks").groupBy(*group, "slot").agg(F.min(F.struct("at", "message_id")).alias("low"), F.max(F.struct("at", "message_id")).alias("high"))
    there = rows.select(*group, "slot").distinct().join(ends.withColumnsRenamed({c: "_" + c for c in (*group, "slot")}), F.col("session_id").eqNullSafe(F.col("_session_id")) & (F.col("token") == F.col("_token")) & (F.col("slot") == F.col("_slot")), "left")
    over = Window.partitionBy(*group)
    earlier = F.last("high", ignorenulls=True).over(over.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    later = F.last("low", ignorenulls=True).over(over.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1))
    carried = there.select(F.col("session_id").alias("_s"), F.col("token").alias("_t"), F.col("slot").alias("_n"), earlier.alias("earlier"), later.alias("later"))
    within = Window.partitionBy(*group, "slot")
    before = F.last(question, ignorenulls=True).over(within.orderBy("at", F.desc("asks"), "message_id").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(question, ignorenulls=True).over(within.orderBy(F.desc("at"), F.asc("asks"), F.desc("message_id")).rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumn("before", before).withColumn("after", after).where("not asks")
    met = seen.join(carried, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("token") == F.col("_t")) & (F.col("slot") == F.col("_n")))
    sides = F.explode(F.array(F.struct(F.coalesce("before", "earlier").alias("q"), F.lit("before").alias("side")), F.struct(F.coalesce("after", "later").alias("q"), F.lit("after").alias("side"))))
    return met.select("message_id", "token", sides.alias("x")).where("x.q is not null").select("message_id", F.col("x.q.message_id").alias("parent"), F.when(F.col("token") == "", F.col("x.side")).alias("side"))


def _tokens(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def inferred(m: DataFrame, replies: DataFrame) -> DataFrame:
    """(message_id, parent, asked, score): for replies (see `recorded`) without a recorded parent the likeliest question of their session.

    Of equal scores the nearest in time counts, then the later. A reply without a time stands before all questions; replies
    of a session without a question have no row.
    """
    lost = replies.where("parent is null")
    # texts stay where they are: what they are looked up by is broadcast if it is few rows
    shown = m.join(counted_small(lost.select("message_id")), "message_id", "left_semi").select("session_id", "message_id", "at", F.lit(False).alias("asks"), "said")
    asked = m.where("role = 'user'").join(counted_small(lost.select(F.col("session_id").alias("_s")).distinct()), F.col("session_id").eqNullSafe(F.col("_s")), "left_semi").select("session_id", "message_id", "at", F.lit(True).alias("asks"), "said")
    rows = cut(shown.unionByName(asked).select("session_id", "message_id", "at", "asks", _tokens(F.col("said"), _NAMES).alias("names"), _tokens(F.col("said"), _PLAIN).alias("words")))
    near = _neighbours(rows.select("session_id", F.explode(F.concat(F.array(F.lit("")), "names")).alias("token"), "at", "asks", "message_id"))
    offered = near.groupBy("message_id", "parent").agg(F.max("side").alias("side"))
    one = rows.select("message_id", "at", F.col("names").alias("n1"), F.col("words").alias("w1"))
    two = rows.select(F.col("message_id").alias("parent"), F.col("at").alias("asked"), F.col("names").alias("n2"), F.col("words").alias("w2"))
    both = offered.join(one, "message_id").join(two, "parent")
    gap = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("asked").cast("timestamp"))) / 1_000_000
    score = (
        TIME * F.coalesce(F.when(gap < 0, BEHIND).otherwise(1.0) * F.exp(-F.abs(gap) / FADE_S), F.lit(0.0))
        + F.when(F.col("side") == "before", NEXT_BEFORE).when(F.col("side") == "after", NEXT_AFTER).otherwise(0.0)
        + MENTION * _share(F.col("n1"), F.col("n2")) + WORDS * _share(F.col("w1"), F.col("w2"))
    )
    best = F.max(F.struct(score.alias("score"), (-F.abs(gap)).alias("near"), F.col("asked"), F.col("parent").alias("parent")))
    return both.groupBy("message_id").agg(best.alias("b")).select("message_id", "b.parent", "b.asked", "b.score")


def linked(m: DataFrame) -> DataFrame:
    """(session_id, message_id, at, speaks, parent, asked, source, score): every reply that can have a parent, with it.

    m as from `messages`; source is `recorded` or `inferred`. The score of a recorded link is its RECORD term alone, since no
    other candidate can exceed it.
    """
    replies = cut(recorded(m))
    known = replies.where("parent is not null").select("*", F.lit("recorded").alias("source"), F.lit(RECORD).alias("score"))
    lost = replies.where("parent is null")
    if lost.isEmpty():
        return known
    found = inferred(m, replies)
    return known.unionByName(lost.drop("parent", "asked").join(found, "message_id").select("session_id", "message_id", "at", "speaks", "parent", "asked", F.lit("inferred").alias("source"), "score"))


def links(rows: DataFrame) -> DataFrame:
    """(session_id, message_id, parent_id, source, score): one parent for every reply that can have one; source is `recorded` or `inferred`."""
    return linked(cut(messages(rows))).select("session_id", "message_id", F.col("parent").alias("parent_id"), "source", "score")


def whole_sessions(rows: DataFrame, texts: bool = False) -> DataFrame:
    """(session_id, turn_no, message_id, role): the speaking messages, in order, of the sessions that are whole; with `said` if asked for.

    Whole: every role is user or assistant, every assistant message has a recorded link, every user message speaks and has a
    speaking reply. Order: user messages by time, then id, each followed by its speaking replies in the same order. Messages
    without a session form the session null and are judged like any other; an empty input gives no rows.
    """
    m = cut(messages(rows))
    tree = linked(m)
    answered = tree.where("speaks").groupBy(F.col("parent").alias("_asked")).agg(F.lit(1).alias("answered"))
    users = cut(m.where("role = 'user'").select("session_id", "message_id", "at", "speaks").join(answered, F.col("message_id") == F.col("_asked"), "left").drop("_asked"))
    # what a session holds against what of it is fine; equal numbers make it whole
    counts = (
        m.select("session_id", F.lit(1).alias("held"), F.lit(0).alias("fine"))
        .unionByName(tree.where("source = 'recorded'").select("session_id", F.lit(0).alias("held"), F.lit(1).alias("fine")))
        .unionByName(users.where("speaks and answered = 1").select("session_id", F.lit(0).alias("held"), F.lit(1).alias("fine")))
    )
    kept = counts.groupBy("session_id").agg(F.sum("held").alias("held"), F.sum("fine").alias("fine")).where("held = fine").select(F.col("session_id").alias("_kept"))
    spoken = users.select("session_id", F.col("at").alias("asked"), F.col("message_id").alias("root"), F.lit(0).alias("below"), "at", "message_id").unionByName(
        tree.where("speaks").select("session_id", "asked", F.col("parent").alias("root"), F.lit(1).alias("below"), "at", "message_id")
    )
    inside = spoken.join(small(kept), F.col("session_id").eqNullSafe(F.col("_kept")), "left_semi")
    placed = numbered(inside, "session_id", ["asked", "root", "below", "at", "message_id"], "turn_no")
    out = placed.select("session_id", F.col("turn_no").cast("int").alias("turn_no"), "message_id", F.when(F.col("below") == 0, "user").otherwise("assistant").alias("role"))
    return out.join(m.select("message_id", "said"), "message_id").select(*out.columns, "said") if texts else out
