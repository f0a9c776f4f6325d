import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import conversation as conv
from skeinwork.operators import extraction, folding, prefix, projection, tables
from skeinwork.sources import readers
from skeinwork.sources.snapshots import Conflict, Snapshots

T0 = dt.datetime(2025, 1, 1)


def turn_rows(spark, weights):
    return spark.createDataFrame([("s", f"u{i}", T0 + dt.timedelta(seconds=i), float(w), 1) for i, w in enumerate(weights, 1)], "session_id string, user_message_id string, at timestamp, weight double, messages long")


@pytest.mark.parametrize(
    ("weights", "limit", "wanted"),
    [
        ([4, 4, 4], 10, [("u1", "u2", True), ("u3", "u3", False)]), ([5, 5, 5], 10, [("u1", "u2", True), ("u3", "u3", False)]), ([3, 25, 3], 10, [("u1", "u1", True), ("u2", "u2", True), ("u3", "u3", False)]),
        ([10], 10, [("u1", "u1", True)]), ([0, 0], 10, [("u1", "u2", False)]), ([9, 10, 1], 10, [("u1", "u1", True), ("u2", "u2", True), ("u3", "u3", False)]),
    ],
)
def test_packing(spark, weights, limit, wanted):
    got = conv.segments(turn_rows(spark, weights), limit).sort("segment_no").collect()
    assert [(r["start_id"], r["end_id"], r["closed"]) for r in got] == wanted


def test_a_hot_session_streams(spark):
    rng = random.Random(1)
    weights = [rng.randint(1, 90) for _ in range(3000)]
    got = [r["weight"] for r in conv.segments(turn_rows(spark, weights), 100).sort("segment_no").collect()]
    wanted, size = [], None
    for w in weights:
        if size is None or size + w > 100:
            size, w = w, None
            wanted.append(size)
        else:
            size = wanted[-1] = size + w
        if size >= 100:
            size = None
    assert sum(got) == sum(weights) and len(got) == len(wanted)


def test_batches(spark):
    df = spark.createDataFrame([("g", i, 30_000.0) for i in range(4)] + [("h", i, 1.0) for i in range(129)], "g string, i int, bytes double")
    got = folding.batched(df, "g", ["i"], "bytes").groupBy("g", "run_no").count().sort("g", "run_no").collect()
    assert [(r["g"], r["count"]) for r in got] == [("g", 3), ("g", 1), ("h", 128), ("h", 1)]
    assert folding.batched(df.limit(0), "g", ["i"], "bytes").count() == 0


def test_boundaries_cover_most(spark):
    t = turn_rows(spark, [1] * 4)
    bounds = spark.createDataFrame([("s", "short", "u1", "u2", 1, True), ("s", "long", "u1", "u3", 0, False), ("s", "tail", "u4", "u4", 0, False), ("s", "odd", "u3", "u2", 1, True), ("s", "gone", "u1", "x", 1, True)], "session_id string, id string, start_id string, end_id string, version int, eligible boolean")
    assert {r["id"] for r in conv.reconcile(t, bounds).collect()} == {"long", "tail"}
    back = {(r["start_id"], r["end_id"]): (r["turns"], r["problem"]) for r in conv.between(t, bounds).collect()}
    assert back == {("u1", "u2"): (2, None), ("u1", "u3"): (3, None), ("u4", "u4"): (1, None), ("u3", "u2"): (None, "reversed"), ("u1", "x"): (None, "missing")}


def test_turns_and_text(spark):
    part = "array<struct<type: string, text: string, tool: string, filename: string, mime: string, ignored: boolean>>"
    text = lambda t, ignored=None: ("text", t, None, None, None, ignored)
    rows = [
        ("u", "s", "user", None, None, [text("abc"), text("hidden", True), ("file", None, None, "a.png", "image/png", None)], T0, T0), ("a", "s", "assistant", "u", None, [text("de😀"), ("reasoning", "xy", None, None, None, None), ("tool", None, "read", None, None, None)], T0, T0),
        ("e", "s", "assistant", "u", "UnknownError", [text("zz")], T0, T0), ("o", "s", "assistant", "gone", None, [text("zz")], T0, T0), ("b", "s", "assistant", "u", "MessageAbortedError", [("step-start", None, None, None, None, None)], T0, T0),
    ]
    m = spark.createDataFrame(rows, f"message_id string, session_id string, role string, parent_id string, error_name string, parts {part}, time_created timestamp, time_updated timestamp")
    got = conv.turns(m).collect()
    assert [(r["user_message_id"], r["weight"], r["messages"]) for r in got] == [("u", 3 + 32_000 + 4 + 2 + 8, 2)]
    texts = {r["message_id"]: r["t"] for r in conv.latest(m).select("message_id", conv.text_of(F.col("role"), F.col("error_name"), F.col("parts")).alias("t")).collect()}
    assert texts == {"u": "abc[Attachment a.png (image/png)]", "a": "de😀", "e": "", "o": "zz", "b": ""}


def test_running_sum_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if n % 3 else f"g{n % 5}" if n % 2 else None, rng.randint(0, 10_000), n, rng.randint(0, 9)) for n in range(900)]
    df = spark.createDataFrame(rows, "g string, at int, i int, w int")
    got = {r["i"]: r["s"] for r in prefix.running_sum(df, ["g"], F.floor(F.col("at") / 500), [F.col("at"), F.col("i")], F.col("w"), "s").collect()}
    wanted, total = {}, {}
    for g, at, i, w in sorted(rows, key=lambda r: (r[1], r[2])):
        total[g] = total.get(g, 0) + w
        wanted[i] = total[g]
    assert got == wanted


def test_tables(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "x")], "k int, v string, made string")
    up = tables.upsert(base, spark.createDataFrame([(2, None, "y"), (4, "d", "y")], base.schema), ["k"], keep=("made",))
    assert {tuple(r) for r in up.collect()} == {(1, "a", "x"), (2, None, "x"), (3, None, "x"), (4, "d", "y")}
    fresh = spark.createDataFrame([(9, "z", "y")], base.schema)
    assert {tuple(r) for r in tables.replace_partitions(base.withColumn("v", F.coalesce("v", F.lit("z"))), fresh, "v").collect()} == {(1, "a", "x"), (2, "b", "x"), (9, "z", "y")}
    e, c = spark.createDataFrame([("e1",), ("e2",), ("e3",), (None,)], "id string"), spark.createDataFrame([("e1", None), (None, "e2")], "subject_entity_id string, object_entity_id string")
    assert [r["id"] for r in tables.orphans(e, c).collect()] == ["e3"] and tables.orphans(e, c, e.where("id = 'e1'")).count() == 0
    assert {tuple(r) for r in tables.violations(base, "k", {"named": F.col("v").isNotNull(), "early": F.col("k") < 2}).collect()} == {(3, "named"), (2, "early"), (3, "early")}
    want, have = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in tables.coverage(want, have, "k").collect()} == {("a", "missing"), ("b", "repeated"), ("c", "unknown")}
    kids = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, parent string")
    assert {r["id"] for r in tables.cascade(kids, spark.createDataFrame([("p",)], "id string"), "parent", "id").collect()} == {1, 3}


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.version == 0 and store.read("t") is None
    assert store.commit({"t": spark.range(3), "u": spark.range(1)}, base=0, mark=("w", "one")) == 1
    assert store.commit({"t": spark.range(5)}, mark=("w", "one")) == 1 and store.read("t").count() == 3
    assert store.commit({"t": store.read("t").where("id > 0")}, base=1) == 2
    assert (store.read("t").count(), store.read("u").count()) == (2, 1)
    with pytest.raises(Conflict):
        store.commit({"t": spark.range(9)}, base=1)


def test_extraction_and_commit(spark, tmp_path):
    said = lambda t: [("user", t), ("assistant", None)]
    requests = spark.createDataFrame([("s1", said("The queue worker drops stale leases. The alias table merges two names, twice.")), ("s2", said("The queue worker keeps one row.")), ("s3", None), (None, said("x"))], "segment_id string, messages array<struct<role: string, text: string>>")
    known = spark.createDataFrame([("known", "Queue  Worker"), ("x", "same"), ("y", "same")], "id string, name string")
    claims, entities = extraction.prepared(extraction.proposed(requests), known)
    rows = claims.collect()
    assert {(r["segment_id"], r["subject"], r["predicate"], r["object_value"]) for r in rows} == {("s1", "queue worker", "drops", "stale leases"), ("s1", "alias table", "merges", "two names"), ("s2", "queue worker", "keeps", "one row")}
    assert {r["subject_entity_id"] for r in rows if r["subject"] == "queue worker"} == {"known"} and all(len(r["embedding"]) == 64 and r["equivalence_key"] for r in rows)
    assert [r["canonical_name"] for r in entities.collect()] == ["alias table"]
    store = Snapshots(spark, str(tmp_path / "store"))
    segments = spark.createDataFrame([("s1", "one"), ("s2", "two")], "segment_id string, summary string")
    assert extraction.commit(store, segments, claims, entities) == 1
    again = segments.where("segment_id = 's1'").withColumn("summary", F.lit("new"))
    assert extraction.commit(store, again, claims.where("false"), entities.where("false"), base=1) == 2
    assert {tuple(r) for r in store.read("segments").collect()} == {("s1", "new"), ("s2", "two")}
    assert [r["segment_id"] for r in store.read("claims").collect()] == ["s2"] and store.read("entities").count() == 0
    with pytest.raises(Exception, match="bytes"):
        extraction.embedded(spark.createDataFrame([("é" * 15_001,)], "t string"), "t").collect()


def test_all_claims_of_a_large_segment_come_out(spark):
    verbs = ["reads", "keeps", "needs", "drops"]
    t = " ".join(f"The {'abcdefghijklmnopqrst'[n // 4]}x worker {verbs[n % 4]} row {n}." for n in range(80))
    requests = spark.createDataFrame([("s", [("user", t)])], "segment_id string, messages array<struct<role: string, text: string>>")
    proposed = extraction.proposed(requests)
    assert sorted((r["index"], r["object_value"]) for r in proposed.collect()) == [(n, f"row {n}") for n in range(80)]
    claims, entities = extraction.prepared(proposed, spark.createDataFrame([], "id string, name string"))
    assert len({r["id"] for r in claims.collect()}) == 80 and entities.count() == 20


def test_projection(spark):
    s = spark.createDataFrame([("a", n, f"u{n}", 400.0, n < 5) for n in range(1, 6)] + [("short", 1, "v", 4.0, False), ("open", 1, "w1", 4000.0, False), ("open", 2, "w2", 4.0, False)], "session_id string, segment_no long, start_id string, weight double, closed boolean")
    got = projection.tails(s, F.lit(600), F.lit(None).cast("long"), F.lit(100)).collect()
    assert [(r["session_id"], r["start_id"], r["archived"], r["tail_tokens"], r["fits"]) for r in got] == [("a", "u5", 4, 100.0, True)]
    e = spark.createDataFrame([("a", 1, "x" * 5), ("a", 2, "y" * 50), ("a", 3, "z" * 5), ("a", 4, "w" * 4)], "session_id string, place int, text string")
    r = projection.summaries(e, F.lit(10)).first()
    assert (r["text"], r["kept"], r["omitted"], r["lossy"]) == ("zzzzz\nwwww", 2, 2, True)
    m = spark.createDataFrame([("a", n, f"u{n}", f"t{n}") for n in range(1, 6)] + [("short", 1, "v", "t")], "session_id string, place int, message_id string, text string")
    chosen = projection.tails(s, F.lit(600), F.lit(None).cast("long"), F.lit(100))
    out = projection.projected(m, chosen, projection.summaries(e, F.lit(10))).sort("session_id", "place").collect()
    assert [(r["message_id"], r["text"]) for r in out] == [("a-history", "What happened so far?"), ("a-summary", "zzzzz\nwwww"), ("u5", "t5"), ("v", "t")]


def test_readers(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": "no number"}\n')
    rows, bad = readers.json_lines(spark, str(tmp_path / "x.json"), "a long, b string")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and bad.count() == 2
    m, p = spark.createDataFrame([("m1",), ("m2",)], "id string"), spark.createDataFrame([("m1", "2", "two"), ("m1", "1", "one"), ("m9", "1", "x")], "message_id string, id string, data string")
    assert {r["id"]: r["parts"] for r in readers.assembled(m, p).collect()} == {"m1": ["one", "two"], "m2": []}
    assert "\n" in readers.pretty(rows).first()["value"]


def test_upgrade_twice_is_once(spark):
    df = spark.createDataFrame([(1,)], "id int")
    rules = {"generation": F.lit(0).cast("long"), "fingerprint": F.lit(None).cast("string")}
    once = extraction.upgraded(df, rules)
    assert extraction.upgraded(once, rules).schema == once.schema == extraction.upgraded(once, {"generation": F.lit(9).cast("long")}).schema


def test_prior_texts(spark):
    df = spark.createDataFrame([("s", f"g{n}", T0 + dt.timedelta(hours=n), f"t{n}") for n in range(4)], "session_id string, segment_id string, at timestamp, summary string")
    assert {r["segment_id"]: r["prior"] for r in extraction.prior_texts(df, 2).collect()} == {"g0": [], "g1": ["t0"], "g2": ["t0", "t1"], "g3": ["t1", "t2"]}


def test_prior_texts_of_a_long_session_are_all_there(spark):
    df = spark.createDataFrame([("s", f"g{n:02}", T0 + dt.timedelta(hours=n), f"t{n}") for n in range(61)], "session_id string, segment_id string, at timestamp, summary string")
    assert {r["segment_id"]: len(r["prior"]) for r in extraction.prior_texts(df).collect()} == {f"g{n:02}": n for n in range(61)}


def test_two_writers_from_one_version(spark, tmp_path):
    """One wins, the other gets a Conflict and leaves nothing behind; what the first wrote is whole."""
    first, second = (Snapshots(spark, str(tmp_path / "store")) for _ in range(2))
    first.commit({"t": spark.range(3), "u": spark.range(9)})
    claim = second._claim

    def late(version, content):
        first.commit({"t": spark.range(4)}, mark=("a", "1"))
        claim(version, content)

    second._claim = late
    with pytest.raises(Conflict):
        second.commit({"t": spark.range(5)})
    assert first.version == 2 and first.read("t").count() == 4 and first.read("u").count() == 9 and first.read("t", version=1).count() == 3
    second._claim = claim
    assert second.commit({"u": spark.range(1)}, mark=("b", "1")) == 3 and first.commit({"t": spark.range(1)}, mark=("a", "1")) == 3
    assert len(list((tmp_path / "store" / "data").iterdir())) == 3
    assert first.tidy(keep=1) == 2 and first.read("t").count() == 4 and first.read("u").count() == 1


def test_buckets_that_are_not_touched_stay(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    every = spark.range(100).withColumn("_bucket", (F.col("id") % 4).cast("int"))
    store.commit({}, bucketed={"t": (every, 4)})
    before = store.tables()
    store.commit({}, bucketed={"t": (every.where("_bucket = 1 and id < 10"), 4)})
    assert {n for n, p in store.tables().items() if before[n] != p} == {"t/1"}
    assert store.read("t").count() == 78 and store.read("t", [1]).count() == 3


def test_numbers_of_a_group_that_spans_partitions(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(9)
    got = {(r["g"], r["i"]): r["n"] for r in prefix.numbered(df, "g", ["i"], "n").collect()}
    held: dict = {}
    for g, i in rows:
        held[g] = held.get(g, 0) + 1
        assert got[g, i] == held[g]
    assert prefix.numbered(df.limit(0), "g", ["i"], "n").count() == 0


def bound_rows(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "session_id string, id string, start_id string, end_id string, version int, eligible boolean")


def test_packing_goes_around_stored_bounds(spark):
    """A chosen bound is one closed segment however heavy; what lies between is packed and closed, only the end may be open."""
    t = turn_rows(spark, [4, 4, 9, 9, 4, 4, 4])
    got = conv.segments(t, 10, bound_rows(spark, [("b", "u3", "u4", 1, True)])).sort("segment_no").collect()
    assert [(r["start_id"], r["end_id"], r["weight"], r["closed"]) for r in got] == [("u1", "u2", 8.0, True), ("u3", "u4", 18.0, True), ("u5", "u6", 8.0, True), ("u7", "u7", 4.0, False)]
    end = conv.segments(t, 10, bound_rows(spark, [("b", "u6", "u7", 1, True), ("c", "u1", "u1", 0, False)])).sort("segment_no").collect()
    assert [(r["start_id"], r["end_id"], r["closed"]) for r in end] == [("u1", "u1", True), ("u2", "u2", True), ("u3", "u3", True), ("u4", "u4", True), ("u5", "u5", True), ("u6", "u7", True)]


@pytest.mark.parametrize(
    ("rows", "kept"),
    [
        ([("z", "u1", "u2", 0, False), ("a", "u2", "u3", 0, False)], {"z"}),  # equal but for the key, in which the earlier start comes first
        ([("z", "u1", "u2", 0, False), ("a", "u2", "u3", 0, True)], {"a"}), ([("z", "u1", "u2", 0, False), ("a", "u2", "u3", 1, False)], {"a"}),
        ([("x", "u1", "u4", 0, False), ("p", "u1", "u2", 9, True), ("q", "u3", "u4", 9, True)], {"p", "q"}), ([("m", "u1", "u2", 1, True), ("k", "u1", "u2", 1, True)], {"k"}), ([(None, "u1", "u2", 1, True)], {None}),
    ],
)
def test_ties_between_plans_of_bounds(spark, rows, kept):
    assert {r["id"] for r in conv.reconcile(turn_rows(spark, [1] * 4), bound_rows(spark, rows)).collect()} == kept


def test_plans_equal_trying_all(spark):
    rng = random.Random(6)
    rows = []
    for n in range(11):
        a, z = sorted((rng.randint(1, 9), rng.randint(1, 9)))
        rows.append((f"b{n}", f"u{a}", f"u{z}", rng.randint(0, 2), rng.random() < 0.5))
    best = None
    for mask in range(1 << len(rows)):
        plan = sorted((r for n, r in enumerate(rows) if mask >> n & 1), key=lambda r: r[1])
        if all(p[2] < q[1] for p, q in zip(plan, plan[1:])):
            value = (sum(int(r[2][1:]) - int(r[1][1:]) + 1 for r in plan), sum(r[4] for r in plan), sum(r[3] for r in plan))
            key = "|".join(f"{r[1]}:{r[2]}:{r[0]}" for r in plan)
            if best is None or value > best[0] or (value == best[0] and key < best[1]):
                best = (value, key, {r[0] for r in plan})
    assert {r["id"] for r in conv.reconcile(turn_rows(spark, [1] * 9), bound_rows(spark, rows)).collect()} == best[2]


PARTS = "array<struct<type: string, text: string, tool: string, filename: string, mime: string, ignored: boolean, synthetic: boolean, state: string, url: string, metadata: string>>"


def message(i, role, at, parent=None, error=None, parts=()):
    base = {"type": "text", "text": None, "tool": None, "filename": None, "mime": None, "ignored": None, "synthetic": None, "state": None, "url": None, "metadata": None}
    return (i, "s", role, parent, error, [base | p for p in parts], T0 + dt.timedelta(seconds=at), T0)


def message_rows(spark, rows):
    return spark.createDataFrame(rows, f"message_id string, session_id string, role string, parent_id string, error_name string, parts {PARTS}, time_created timestamp, time_updated timestamp")


def test_turns_weigh_tools_and_skip_notices_and_compactions(spark):
    notice = conv.Notice("content was lost", "memory", "loss", 1)
    mark = {"text": "content was lost", "synthetic": False, "ignored": False, "metadata": '{"memory": {"version": 1, "type": "loss"}}'}
    rows = [
        message("u1", "user", 0, parts=[{"text": "hi"}]), message("a1", "assistant", 1, "u1", parts=[{"type": "tool", "tool": "ls", "state": '{"status": "completed", "output": "ok", "time": {"compacted": 3}}'}]),
        message("c1", "user", 2, parts=[{"type": "compaction"}]), message("n1", "user", 3, parts=[mark]), message("n2", "user", 4, parts=[mark | {"metadata": '{"memory": {"version": 1, "type": "loss", "more": 1}}'}]),
        message("n3", "user", 5, parts=[mark, {"text": "and this"}]), message("a2", "assistant", 6, "n1", parts=[{"text": "dropped"}]), message("u2", "user", 7, parts=[{"type": "file", "mime": "a/b", "url": "data:a/b,x"}]),
    ]
    got = {r["user_message_id"]: (r["weight"], r["messages"]) for r in conv.turns(message_rows(spark, rows), notice).collect()}
    state = '{"status":"completed","output":"[Old tool result content cleared]","time":{"compacted":3}}'
    assert got == {"u1": (2.0 + 2 + len(state), 2), "n2": (16.0, 1), "n3": (24.0, 1), "u2": (32_000.0, 1)}


def test_messages_of_a_bound_come_back(spark):
    rows = [
        message("u1", "user", 0, parts=[{"text": "one"}]), message("u2", "user", 1, parts=[{"text": "two"}]), message("a1", "assistant", 2, "u1", parts=[{"text": "late answer"}]), message("a2", "assistant", 3, "u2", error="X", parts=[{"text": "failed"}]),
        message("u3", "user", 4, parts=[{"text": "three"}]), message("lost", "assistant", 5, "gone", parts=[{"text": "nowhere"}]),
    ]
    bounds = spark.createDataFrame([("s", "u1", "u2"), ("s", "u3", "u3"), ("s", "u3", "u1"), ("s", "u1", "x")], "session_id string, start_id string, end_id string")
    got = [(r["start_id"], r["end_id"], r["place"], r["message_id"], r["text"], r["problem"]) for r in conv.read_back(message_rows(spark, rows), bounds).collect()]
    assert sorted(got, key=str) == sorted([("u1", "u2", 1, "u1", "one", None), ("u1", "u2", 2, "u2", "two", None), ("u1", "u2", 3, "a1", "late answer", None), ("u3", "u3", 1, "u3", "three", None), ("u3", "u1", None, None, None, "reversed"), ("u1", "x", None, None, None, "missing")], key=str)
