import datetime as dt

import pytest

from skeinwork.functions import text
from skeinwork.operators import conversation as conv
from skeinwork.operators import projection

T0 = dt.datetime(2025, 1, 1)
PART = {"type": "text", "text": None, "tool": None, "filename": None, "mime": None, "ignored": None, "state": None, "url": None}
SCHEMA = """message_id string, session_id string, role string, parent_id string, error_name string, provider_id string, model_id string, summary boolean, reported long,
parts array<struct<type: string, text: string, tool: string, filename: string, mime: string, ignored: boolean, state: string, url: string>>, time_created timestamp, time_updated timestamp"""


def row(i, role, at, parent=None, parts=(), session="s", summary=None, reported=None, model="m", error=None):
    return (i, session, role, parent, error, "p", model, summary, reported, [PART | x for x in parts], T0 + dt.timedelta(seconds=at), T0)


def talk(n, size, session="s"):
    """n turns of a question and an answer of so many letters, and a question at the end."""
    rows = []
    for k in range(n):
        rows += [row(f"{session}u{k}", "user", 10 * k, parts=[{"text": "q" * size}], session=session), row(f"{session}a{k}", "assistant", 10 * k + 5, f"{session}u{k}", [{"text": "a" * size}], session=session)]
    return [*rows, row(f"{session}u{n}", "user", 10 * n, parts=[{"text": "now"}], session=session)]


NO_SUMMARIES = "id string, session_id string, start_id string, end_id string, summary string, created_at int"


def run(spark, rows, summaries=(), **limits):
    shown, info = projection.project(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(summaries), NO_SUMMARIES), **({"context": 60_000, "output": 1_000, "limit": 20_000} | limits))
    return sorted(shown.collect(), key=lambda r: (r["session_id"], r["place"])), {r["session_id"]: r for r in info.collect()}


def test_below_the_threshold_nothing_changes(spark):
    rows = talk(3, 100)
    shown, info = run(spark, rows)
    assert [r["message_id"] for r in shown] == [r[0] for r in rows] and not info["s"]["due"] and not info["s"]["reset"]


def test_reset_keeps_a_tail_and_tells_of_the_rest(spark):
    """Four turns a segment; of the archived segments one has a summary of just its bounds, one of more than that."""
    rows = talk(16, 5_000)
    summaries = [("x1", "s", "su0", "su1", " first part ", 1), ("x2", "s", "su2", "su5", "too wide", 1), ("x1b", "s", "su0", "su1", "later", 2)]
    shown, info = run(spark, rows, summaries)
    d = info["s"]
    assert d["due"] and d["reset"] and d["tokens_after"] < d["threshold"] <= d["tokens"] and d["reasons"] == ["missing-summaries"]
    assert shown[0]["message_id"].endswith("_context_user") and shown[1]["message_id"].endswith("_context_assistant") and shown[0]["at"] < shown[1]["at"] < shown[2]["at"]
    assert [r["message_id"] for r in shown[2:]] == [r[0] for r in rows[d["archived_messages"] :]] and shown[2]["message_id"] == d["tail_start_id"]
    told = shown[1]["text"]
    assert "### Segment x1\nfirst part" in told and "too wide" not in told and "later" not in told and projection.MARKERS["missing-summaries"] in told and d["included"] == 1


def test_reported_tokens_make_a_reset_due(spark):
    """What an answer of the active model reported counts, what another model's did does not."""
    rows = talk(4, 5_000)
    told = lambda model: [*rows[:-1], row("sa9", "assistant", 36, "su3", [{"text": "x"}], reported=90_000, model=model), rows[-1]]
    assert run(spark, told("m"), context=100_000)[1]["s"]["due"] and not run(spark, told("other"), context=100_000)[1]["s"]["due"]


def test_no_reset_within_a_turn_but_at_the_hard_limit(spark):
    rows = talk(14, 5_000)[:-1]
    wide, tight = run(spark, rows, context=105_000)[1]["s"], run(spark, rows, context=70_000)[1]["s"]
    assert wide["threshold"] <= wide["tokens"] < wide["hard"] and not wide["due"]
    assert tight["tokens"] >= tight["hard"] and tight["reset"]


def test_media_of_unknown_size_fits_nowhere(spark):
    rows = talk(6, 5_000)
    rows[-1] = row("su6", "user", 60, parts=[{"type": "file", "mime": "a/b"}])
    assert run(spark, rows)[1]["s"]["due"] and not run(spark, rows)[1]["s"]["reset"]


def test_tools_reasoning_and_an_earlier_compaction(spark):
    done = '{"status": "completed", "input": {"p": 1}, "output": "' + "o" * 3_000 + '", "attachments": [{"filename": "f.png", "mime": "image/png"}]}'
    rows = [row("old", "user", -9, parts=[{"text": "forgotten"}]), row("c", "user", -8, parts=[{"type": "compaction"}]), row("cs", "assistant", -7, "c", [{"text": "what came before"}], summary=True), row("l", "assistant", -6, "old", [{"text": "loose end"}]), *talk(16, 5_000)]
    rows.append(row("t", "assistant", 6, "su0", [{"type": "tool", "tool": "ls", "state": done}, {"type": "tool", "tool": "rm", "state": '{"status": "pending"}'}, {"type": "reasoning", "text": "hm"}]))
    shown, info = run(spark, rows, context=80_000)
    d, told = info["s"], shown[1]["text"]
    assert d["reasons"] == ["archived-media", "archived-reasoning", "missing-summaries", "tool-cut", "unfinished-tools"]
    assert "### Earlier summary\nwhat came before" in told and "loose end" in told and "forgotten" not in told
    assert '[Tool ls] {"p":1}\n' + "o" * 2_000 + "\nAttachments: f.png (image/png)" in told


def test_sessions_go_their_own_ways(spark):
    shown, info = run(spark, talk(2, 50, "a") + talk(16, 5_000, "b"))
    assert not info["a"]["reset"] and info["b"]["reset"] and sum(r["session_id"] == "a" for r in shown) == 5
    nothing, none = run(spark, [])
    assert nothing == [] and none == {}


@pytest.mark.parametrize(
    ("state", "entry", "cut", "missing"),
    [
        ('{"status": "error", "input": [1], "error": "no"}', "[Tool t error] [1]\nno", False, None), ('{"status": "completed", "output": "x", "time": {"compacted": 1}}', "[Tool t] null\n[output was compacted]", False, None),
        ('{"status": "completed"}', "[Tool t] null\n[no text output]", False, None), ('{"status": "running"}', None, False, "unfinished-tools"), (None, None, False, "unfinished-tools"),
    ],
)
def test_tool_records(state, entry, cut, missing):
    assert text.tool_record_of("t", state) == (entry, cut, missing)


def test_coverage_wants_just_the_bounds(spark):
    archived = spark.createDataFrame([("s", 1, "a", "b"), ("s", 2, "c", "d")], "session_id string, segment_no long, start_id string, end_id string")
    summaries = spark.createDataFrame([("2", "s", "a", "b", "late", 5), ("1", "s", "a", "b", "early", 1), ("3", "s", "c", "e", "wide", 1)], NO_SUMMARIES)
    assert {(r["segment_no"], r["summary"]) for r in projection.covered(archived, summaries).collect()} == {(1, "early"), (2, None)}
    assert conv.LIMIT == 20_000
