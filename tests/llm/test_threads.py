import datetime as dt
import random

from skeinwork.llm import threads

SCHEMA = "message_id string, session_id string, role string, parent_id string, error_name string, parts array<struct<type: string, text: string, ignored: boolean>>, time_created timestamp, time_updated timestamp, said string, slot int, parent string"
T0 = dt.datetime(2025, 1, 1)


def row(i, session, role, at, parent=None, text="hello", error=None, updated=0, parts="text"):
    p = None if parts is None else [("text", text, None)]
    return (i, session, role, parent, error, p, T0 + dt.timedelta(seconds=at), T0 + dt.timedelta(seconds=updated), "x", 1, "y")


def kept(spark, rows):
    return sorted((r["session_id"], r["turn_no"], r["message_id"]) for r in threads.whole_sessions(spark.createDataFrame(rows, SCHEMA)).collect())


def test_order_states_and_silence(spark):
    rows = [
        row("u2", "s", "user", 5000), row("u1", "s", " User", 10), row("a1", "s", "assistant", 30, "u1"), row("a0", "s", "Assistant", 20, "u1"), row("a3", "s", "assistant", 9000, "u2"),
        row("a4", "s", "assistant", 9001, "u2", text="  "), row("a5", "s", "assistant", 9002, "u2", error="UnknownError"), row("a6", "s", "assistant", 9003, "u2", error="MessageAbortedError"),
        row("a1", "s", "assistant", 30, "gone", updated=-5), row("a1", "s", "assistant", 30, "u1"),
    ]
    assert kept(spark, rows) == [("s", 1, "u1"), ("s", 2, "a0"), ("s", 3, "a1"), ("s", 4, "u2"), ("s", 5, "a3"), ("s", 6, "a6")]


def test_broken_sessions_are_dropped(spark):
    good = lambda s: [row(f"u{s}", s, "user", 1), row(f"a{s}", s, "assistant", 2, f"u{s}")]
    rows = [
        *good("ok"), *good("tool"), row("t", "tool", "tool", 3), *good("norole"), row("n", "norole", None, 3), *good("lost"), row("l", "lost", "assistant", 3, None), *good("other"), row("o", "other", "assistant", 3, "uok"),
        *good("silent"), row("q", "silent", "user", 3), *good("mute"), row("m", "mute", "user", 3, text=" "), row("ma", "mute", "assistant", 4, "m"), *good("failed"), row("f", "failed", "user", 3), row("fa", "failed", "assistant", 4, "f", error="X"),
        *good("chain"), row("c", "chain", "assistant", 3, "achain"), row("e", "empty", "user", 1, parts=None), (None, "ok", "user", None, None, None, T0, T0, "", 0, ""),
    ]
    assert kept(spark, rows) == [("ok", 1, "uok"), ("ok", 2, "aok")]


def test_ties_of_time_go_by_id_and_empty_table(spark):
    rows = [row("b", "s", "user", 0), row("a", "s", "user", 0), row("z", "s", "assistant", 0, "a"), row("y", "s", "assistant", 0, "a"), row("x", "s", "assistant", 0, "b")]
    assert [m for *_, m in kept(spark, rows)] == ["a", "y", "z", "b", "x"]
    assert kept(spark, []) == []


def test_lost_links_are_found_again(spark):
    rng = random.Random(5)
    rows, true = [], {}
    for s in range(20):
        at = 0
        for t in range(6):
            at += rng.choice([60, 4000, 90_000])
            rows.append(row(f"u{s}-{t}", f"s{s}", "user", at, text=f"please look at src/file_{s}_{t}.py now"))
            rows.append(row(f"a{s}-{t}", f"s{s}", "assistant", at + rng.randint(5, 50), f"u{s}-{t}" if t % 2 else None, text=f"done with src/file_{s}_{t}.py"))
            true[f"a{s}-{t}"] = f"u{s}-{t}"
    found = {r["message_id"]: (r["parent_id"], r["source"]) for r in threads.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v[0] for k, v in found.items()} == true
    assert sum(s == "inferred" for _, s in found.values()) == 60


def test_every_lost_reply_is_offered_all_questions(spark):
    rows = [row("u0", "hot", "user", 0, text="plain"), row("u1", "hot", "user", 3600, text="look at src/queue_a.py"), *(row(f"a{n}", "hot", "assistant", 3601 + 60 * n, text="done with src/queue_a.py") for n in range(50))]
    rows += [*(row(f"q{n}", "woven", "user", 60 * n, text=f"look at src/file_{n}.py") for n in range(8)), row("w", "woven", "assistant", 500, text="done with src/file_1.py")]
    rows += [row("late", "clock", "user", 300, text="look at src/late.py"), row("early", "clock", "assistant", 0, text="done with src/late.py")]
    found = {r["message_id"]: r["parent_id"] for r in threads.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {f"a{n}": "u1" for n in range(50)} | {"w": "q1", "early": "late"}


def test_replies_without_a_record_in_one_run(spark):
    # fourteen replies within seconds name what the newer question names; an older question lies an hour before
    rows = [row("u0", "s", "user", 0, text="plain words"), row("u1", "s", "user", 3600, text="look at src/queue_a.py"), *(row(f"a{n:02}", "s", "assistant", 3601 + n, text="done with src/queue_a.py") for n in range(14))]
    assert {r["parent_id"] for r in threads.links(spark.createDataFrame(rows, SCHEMA)).collect()} == {"u1"}


def test_odd_times_and_sessions_without_questions(spark):
    untimed = (*row("n", "s", "assistant", 0, text="x")[:6], None, T0, "x", 1, "y")
    rows = [row("u", "s", "user", 50), untimed, row("b", "s", "assistant", 10), row("alone", "t", "assistant", 10), row("na", None, "user", 1), row("nb", None, "assistant", 2)]
    assert {(r["message_id"], r["parent_id"], r["source"]) for r in threads.links(spark.createDataFrame(rows, SCHEMA)).collect()} == {("n", "u", "inferred"), ("b", "u", "inferred"), ("nb", "na", "inferred")}


def test_texts_and_roles_of_whole_sessions(spark):
    rows = [row("u", "s", "user", 1, text="ask"), row("a", "s", "assistant", 2, "u", text="tell")]
    assert sorted((r["turn_no"], r["role"], r["said"]) for r in threads.whole_sessions(spark.createDataFrame(rows, SCHEMA), texts=True).collect()) == [(1, "user", "ask"), (2, "assistant", "tell")]
