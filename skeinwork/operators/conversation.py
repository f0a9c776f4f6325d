"""Chat messages as turns and segments of bounded weight, and the choice among stored segment boundaries."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from skeinwork.functions.scoring import CHARS_PER_TOKEN
from skeinwork.functions.text import media_tokens, tool_state_weight, utf16_length
from skeinwork.operators import folding, prefix

#: Weight of a segment aimed at.
LIMIT = 20_000


def latest(rows: DataFrame) -> DataFrame:
    """Messages in their latest state, roles trimmed and in lower case; one row per message_id."""
    state = F.struct("time_updated", "session_id", F.lower(F.trim("role")).alias("role"), "parent_id", "error_name", "parts", "time_created")
    return rows.where("message_id is not null").groupBy("message_id").agg(F.max(state).alias("s")).select("message_id", "s.*")


def visible(role: Column, error: Column, parts: Column) -> Column:
    """Whether a model sees a message: users always, assistants unless they failed; an aborted one if it has content."""
    content = F.exists(parts, lambda p: ~p["type"].isin("step-start", "reasoning"))
    return (role == "user") | error.isNull() | ((error == "MessageAbortedError") & content)


def _shown(role: Column, part: Column) -> Column:
    return (role == "assistant") | ~F.coalesce(part["ignored"], F.lit(False))


def text_of(role: Column, error: Column, parts: Column) -> Column:
    """The text a model sees: text parts as they are, files as a marker with name and kind."""
    def mark(p: Column) -> Column:
        name = F.when(F.coalesce(p["filename"], F.lit("")) != "", F.concat(F.lit(" "), F.left(p["filename"], F.lit(500)))).otherwise("")
        mime = F.when(F.coalesce(p["mime"], F.lit("")) != "", F.concat(F.lit(" ("), F.left(p["mime"], F.lit(200)), F.lit(")"))).otherwise("")
        return F.concat(F.lit("[Attachment"), name, mime, F.lit("]"))

    shown = F.filter(parts, lambda p: _shown(role, p) & p["type"].isin("text", "file"))
    text = F.array_join(F.transform(shown, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(mark(p))), "")
    return F.when(visible(role, error, parts), text).otherwise("")


def _has(parts_type: DataType, name: str) -> bool:
    return name in parts_type.elementType.fieldNames()


def weight_of(role: Column, error: Column, parts: Column, parts_type: DataType | None = None) -> Column:
    """Weight in UTF-16 units: text and reasoning by length, tools by name, files by media tokens.

    A tool's state is weighed by `weighed`; here each counts what an absent one does, the four letters of null. Files are sized
    by their `url` if parts have one; media of unknown size that is no image weighs infinitely much.
    """
    sized = parts_type is not None and _has(parts_type, "url")

    def one(p: Column) -> Column:
        size = lambda c: F.coalesce(utf16_length(c), F.lit(0)).cast("double")
        return (
            F.when(p["type"].isin("text", "reasoning"), size(p["text"])).when(p["type"] == "tool", size(p["tool"]) + len("null"))
            .when(p["type"] == "file", CHARS_PER_TOKEN * media_tokens(p["mime"], p["url"] if sized else F.lit(None).cast("string"))).otherwise(0.0)
        )

    total = F.aggregate(F.filter(parts, lambda p: _shown(role, p)), F.lit(0.0), lambda a, p: a + one(p))
    return F.when(visible(role, error, parts), total).otherwise(0.0)


def weighed(m: DataFrame) -> DataFrame:
    """Messages in their latest state (see `latest`) with `seen` and `weight`.

    Where parts have a `state` (JSON), tools weigh its length as a model sees it and the tokens of its attachments. Only parts
    with a state go through Python, as rows of their own.
    """
    col = [F.col(c) for c in ("role", "error_name", "parts")]
    kind = m.schema["parts"].dataType
    rows = m.withColumn("seen", visible(*col)).withColumn("weight", weight_of(*col, kind))
    if not _has(kind, "state"):
        return rows
    tools = rows.where("seen").select("message_id", F.explode(F.filter("parts", lambda p: (p["type"] == "tool") & p["state"].isNotNull() & _shown(F.col("role"), p))).alias("p"))
    more = tools.select("message_id", (tool_state_weight(F.col("p.state")) - len("null")).alias("w")).groupBy("message_id").agg(F.sum("w").alias("more"))
    return rows.join(more, "message_id", "left").withColumn("weight", F.col("weight") + F.coalesce("more", F.lit(0.0))).drop("more")


@dataclass(frozen=True)
class Notice:
    """A message that the system itself puts among those of the user: its text, and its metadata, an object of one key that holds an object of just a type and a version."""

    text: str
    key: str
    kind: str
    version: int


def opens_turn(role: Column, parts: Column, parts_type: DataType, notice: Notice | None = None) -> Column:
    """Whether a message begins a turn: of a user, without a compaction part, and not the system's own notice.

    A notice is recognised only if all of it fits: one text part with just its text, neither synthetic nor ignored, and
    metadata (JSON) of exactly its keys and values. Parts without such fields hold no notice.
    """
    plain = (role == "user") & ~F.exists(F.coalesce(parts, F.array().cast(parts_type)), lambda p: p["type"] == "compaction")
    if notice is None or not all(_has(parts_type, f) for f in ("synthetic", "metadata")):
        return plain
    p = F.get(parts, F.lit(0))
    inner = F.get_json_object(p["metadata"], f"$.{notice.key}")
    exact = (
        (F.size(parts) == 1) & (p["type"] == "text") & (p["text"] == notice.text) & ~p["synthetic"] & ~p["ignored"] & (F.json_object_keys(p["metadata"]) == F.array(F.lit(notice.key)))
        & (F.array_sort(F.json_object_keys(inner)) == F.array(F.lit("type"), F.lit("version"))) & (F.get_json_object(inner, "$.type") == notice.kind) & (F.get_json_object(inner, "$.version") == str(notice.version))
    )
    return plain & ~F.coalesce(exact, F.lit(False))


def turns(rows: DataFrame, notice: Notice | None = None) -> DataFrame:
    """(session_id, user_message_id, at, weight, messages): each message that opens a turn with the visible assistant messages that answer it.

    Assistants whose parent opens no turn of the session are dropped; users without an answer are turns.
    """
    m = latest(rows)
    kept = weighed(m).select("session_id", "message_id", "role", "parent_id", F.col("time_created").alias("at"), "seen", "weight", opens_turn(F.col("role"), F.col("parts"), m.schema["parts"].dataType, notice).alias("opens"))
    users = kept.where("opens").select("session_id", F.col("message_id").alias("user_message_id"), "at", "weight")
    answers = kept.where("role = 'assistant' and seen and parent_id is not null").select(F.col("session_id").alias("s"), "parent_id", "weight")
    per = answers.groupBy("s", "parent_id").agg(F.sum("weight").alias("more"), F.count("*").alias("n"))
    joined = users.join(per, (F.col("session_id") == F.col("s")) & (F.col("user_message_id") == F.col("parent_id")), "left")
    return joined.select("session_id", "user_message_id", "at", (F.col("weight") + F.coalesce("more", F.lit(0.0))).alias("weight"), (1 + F.coalesce("n", F.lit(0))).cast("long").alias("messages"))


def placed(turn_rows: DataFrame) -> DataFrame:
    """Turns with their number `i` (from 1) in the session and the weight up to and with them; long sessions are numbered by day."""
    day = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / 86_400)
    order = [F.col("at"), F.col("user_message_id")]
    numbered = prefix.running_sum(turn_rows, ["session_id"], day, order, F.lit(1), "i").withColumn("i", F.col("i").cast("int"))
    return prefix.running_sum(numbered, ["session_id"], day, order, F.col("weight"), "upto")


def segments(turn_rows: DataFrame, limit: int = LIMIT, bounds: DataFrame | None = None) -> DataFrame:
    """(session_id, segment_no, start_id, end_id, turns, weight, closed): turns packed in order.

    A segment closes before a turn that would take it over the limit and when it meets the limit; a heavier turn stands alone.
    The last segment of a session is open unless it met the limit. Stored bounds (see `reconcile`) that are chosen are segments
    of their own, whatever their weight, and always closed; only what lies between them is packed.
    """
    if bounds is None:
        cut = folding.packed(turn_rows, "session_id", ["at", "user_message_id"], "weight", limit)
    else:
        chosen = reconcile(turn_rows, bounds).select(F.col("session_id").alias("s"), F.col("id").alias("bound"), F.explode(F.sequence("a", "z")).alias("n"))
        held = placed(turn_rows).drop("upto").join(chosen, (F.col("session_id") == F.col("s")) & (F.col("i") == F.col("n")), "left").drop("s", "n", "i")
        cut = folding.runs(held, "session_id", ["at", "user_message_id"], "weight", lambda: folding.BoundPacker(limit), "bound")
    at = F.struct("at", "user_message_id")
    packs = cut.groupBy("session_id", F.col("run_no").alias("segment_no")).agg(
        F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("turns"), F.sum("weight").alias("weight"), F.max("run_ended").alias("ended")
    )
    last = F.max("segment_no").over(Window.partitionBy("session_id"))
    return packs.select("session_id", "segment_no", F.col("a.user_message_id").alias("start_id"), F.col("z.user_message_id").alias("end_id"), "turns", "weight", (F.col("ended") | (F.col("segment_no") < last)).alias("closed"))


def _located(turn_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds (session_id, start_id, end_id, ...) with the turn numbers a and z of their ends, null where there is no such turn."""
    one = turn_rows.select("session_id", F.col("user_message_id").alias("start_id"), F.col("i").alias("a"), (F.col("upto") - F.col("weight")).alias("to_a"))
    two = turn_rows.select("session_id", F.col("user_message_id").alias("end_id"), F.col("i").alias("z"), F.col("upto").alias("to_z"))
    return bounds.join(one, ["session_id", "start_id"], "left").join(two, ["session_id", "end_id"], "left")


def _problem() -> Column:
    return F.when(F.col("a").isNull() | F.col("z").isNull(), "missing").when(F.col("a") > F.col("z"), "reversed")


def between(turn_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(session_id, start_id, end_id, turns, weight, problem) of stored bounds: what lies between them, or why that is undefined."""
    judged = _located(placed(turn_rows), bounds.select("session_id", "start_id", "end_id").distinct()).withColumn("problem", _problem())
    fine = F.col("problem").isNull()
    return judged.select("session_id", "start_id", "end_id", F.when(fine, F.col("z") - F.col("a") + 1).cast("long").alias("turns"), F.when(fine, F.col("to_z") - F.col("to_a")).alias("weight"), "problem")


def read_back(rows: DataFrame, bounds: DataFrame, notice: Notice | None = None) -> DataFrame:
    """(session_id, start_id, end_id, place, message_id, role, text, problem): the messages of stored bounds, in their original order.

    A bound takes in its turns from the first to the last: the messages that open them and the visible answers, wherever those
    stand. A bound that is missing or reversed has one row that says so.
    """
    m = latest(rows)
    located = _located(placed(turns(rows, notice)), bounds.select("session_id", "start_id", "end_id").distinct()).select("session_id", "start_id", "end_id", "a", "z", _problem().alias("problem"))
    turn_of = placed(turns(rows, notice)).select("session_id", F.col("user_message_id").alias("opener"), "i")
    col = [F.col(c) for c in ("role", "error_name", "parts")]
    said = m.where(visible(*col)).select(F.col("session_id").alias("s"), "message_id", "role", F.col("time_created").alias("at"), F.when(F.col("role") == "user", F.col("message_id")).otherwise(F.col("parent_id")).alias("of"), text_of(*col).alias("text")).where("role in ('user', 'assistant')")
    inside = said.join(turn_of, (F.col("s") == F.col("session_id")) & (F.col("of") == F.col("opener"))).select(F.col("s"), "i", "message_id", "role", "at", "text")
    # a bound meets its turns by number, so that no turn meets bounds it is not in
    wanted = located.where("problem is null").select("session_id", "start_id", "end_id", F.explode(F.sequence("a", "z")).alias("n"))
    met = wanted.join(inside, (F.col("session_id") == F.col("s")) & (F.col("n") == F.col("i")))
    place = F.row_number().over(Window.partitionBy("session_id", "start_id", "end_id").orderBy("at", "message_id"))
    whole = met.select("session_id", "start_id", "end_id", place.alias("place"), "message_id", "role", "text", F.lit(None).cast("string").alias("problem"))
    return whole.unionByName(located.where("problem is not null").select("session_id", "start_id", "end_id", "problem"), allowMissingColumns=True)


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted interval scheduling: most turns covered, then most eligible, then the highest versions, then the smallest key.

    The best plan of the first n bounds either leaves out the n-th or puts it behind the best plan of those that end before it
    starts, found by bisection; plans are chains of back pointers, and keys are spelt out only where all else is equal.
    """
    rows = pdf.sort_values(["z", "a", "id"]).reset_index(drop=True)
    ends, starts = rows["z"].tolist(), rows["a"].tolist()
    gain = list(zip((rows["z"] - rows["a"] + 1).tolist(), rows["eligible"].fillna(False).astype(int).tolist(), rows["version"].fillna(0).astype(int).tolist(), strict=True))
    name = (rows["start_id"] + ":" + rows["end_id"] + ":" + rows["id"].fillna("")).tolist()
    score, link = [(0, 0, 0)], [(-1, -1)]  # of each plan; and its last bound with the plan before that

    def key(n: int) -> str:
        parts = []
        while link[n][0] >= 0:
            parts.append(name[link[n][0]])
            n = link[n][1]
        return "|".join(reversed(parts))

    for n in range(len(rows)):
        before = bisect.bisect_left(ends, starts[n], 0, n)
        taken = tuple(x + y for x, y in zip(score[before], gain[n], strict=True))
        with_it = taken > score[n]
        if taken == score[n]:
            head = key(before)
            with_it = (head + "|" if head else "") + name[n] < key(n)
        score.append(taken if with_it else score[n])
        link.append((n, before) if with_it else link[n])
    keep, n = [], len(rows)
    while link[n][0] >= 0:
        keep.append(link[n][0])
        n = link[n][1]
    return rows.loc[sorted(keep), ["session_id", "id", "a", "z"]]


def reconcile(turn_rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(session_id, id, a, z): the stored bounds (session_id, id, start_id, end_id, version, eligible) that together cover most turns
    without overlapping; a and z are turn numbers. Bounds with an unknown or reversed end are out.

    Of bounds with the same ends the best is taken first. What is left of one session, at most as many bounds as segments were
    ever stored of it, is chosen among by one task in the order of its number times its logarithm.
    """
    located = _located(placed(turn_rows), bounds).where("a <= z")
    best = located.groupBy("session_id", "a", "z").agg(F.max(F.struct(F.coalesce("eligible", F.lit(False)).alias("eligible"), F.coalesce("version", F.lit(0)).alias("version"))).alias("top"), F.first("start_id").alias("start_id"), F.first("end_id").alias("end_id"))
    ids = located.select("session_id", "a", "z", "id", F.coalesce("eligible", F.lit(False)).alias("e"), F.coalesce("version", F.lit(0)).alias("v"))
    first = ids.join(best, ["session_id", "a", "z"]).where("e = top.eligible and v = top.version").groupBy("session_id", "a", "z").agg(F.min("id").alias("id"), F.first("start_id").alias("start_id"), F.first("end_id").alias("end_id"), F.first("e").alias("eligible"), F.first("v").alias("version"))
    return first.groupBy("session_id").applyInPandas(_chosen, "session_id string, id string, a int, z int")
