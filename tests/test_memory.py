"""The library as one object, its SQL functions, keyed stream state, and what goes on around extraction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ids, scoring, sqlfunctions, text
from skeinwork.memory import Memory, viewed
from skeinwork.operators import backfill, candidates, changefeed, extraction, tables
from skeinwork.sources import readers
from skeinwork.sources.snapshots import Snapshots
from skeinwork.streaming import keyed

T0 = dt.datetime(2025, 1, 1)


def test_submit_search_and_read(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    memory = Memory(store)
    with pytest.raises(LookupError):
        memory.segment(["x"])
    said = lambda *ts: [("user" if n % 2 == 0 else "assistant", t) for n, t in enumerate(ts)]
    requests = spark.createDataFrame(
        [("s", "u1", "u2", said("The queue worker drops stale leases.", "The alias table merges two names."), "first", T0), ("s", "u3", "u3", said("The queue worker keeps one row."), "second", T0 + dt.timedelta(hours=1)), ("t", "v1", "v1", said("nothing"), "third", T0)],
        "session_id string, start_user_message_id string, end_user_message_id string, messages array<struct<role: string, text: string>>, summary string, created_at timestamp",
    )
    known = spark.createDataFrame([("known", "Queue  Worker")], "id string, name string")
    assert memory.submit(requests, known) == 1 and memory.submit(requests.where("session_id = 't'"), known) == 2
    listed = memory.session("s").collect()
    assert [(r["start_id"], r["end_id"], r["summary"]) for r in listed] == [("u1", "u2", "first"), ("u3", "u3", "second")]
    shown = {r["segment_id"]: [(c["subject"], c["predicate"], c["object_value"]) for c in r["claims"]] for r in memory.segment([r["segment_id"] for r in listed]).collect()}
    assert sorted(shown[listed[0]["segment_id"]]) == [("alias table", "merges", "two names"), ("queue worker", "drops", "stale leases")] and len(shown) == 2
    found = memory.search(spark.createDataFrame([(7, "alias table | merges | two names"), (8, None)], "query long, text string")).sort("place").collect()
    assert {r["query"] for r in found} == {7} and found[0]["subject"] == "alias table" and found[0]["is_direct"] and found[0]["support_count"] == 1
    # what touches the known entity comes along from the other segment
    assert {r["object_value"] for r in found} == {"two names", "stale leases", "one row"}
    assert memory.search_vector(extraction.hashed_grams(["queue worker | keeps | one row"])[0].tolist(), direct_k=1).sort("place").first()["similarity"] > 0.99
    assert [r["canonical_name"] for r in memory.candidates(spark.createDataFrame([(1, "the alias tables"), (2, None)], "query long, text string")).collect()] == ["alias table"]


def test_read_a_segment_from_the_store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    part = lambda t: [("text", t, None, None, None, None)]
    rows = [("u1", "s", "user", None, None, part("one"), T0, T0), ("a1", "s", "assistant", "u1", None, part("two"), T0 + dt.timedelta(seconds=1), T0), ("x", "other", "user", None, None, part("no"), T0, T0)]
    store.commit({"messages": spark.createDataFrame(rows, "message_id string, session_id string, role string, parent_id string, error_name string, parts array<struct<type: string, text: string, tool: string, filename: string, mime: string, ignored: boolean>>, time_created timestamp, time_updated timestamp")})
    memory = Memory(store)
    assert [(r["role"], r["text"]) for r in memory.read_segment("s", "u1", "u1").sort("place").collect()] == [("user", "one"), ("assistant", "two")]
    assert memory.read_segment("s", "u1", "x").first()["problem"] == "missing"


def test_view_of_segments_without_claims(spark):
    segments = spark.createDataFrame([("a",), ("b",)], "segment_id string")
    claims = spark.createDataFrame([("2", "a", "s", "p", None, "v", 0.5), ("1", "a", "s", "p", None, "w", 0.5), ("1", "a", "s", "p", None, "w", 0.5)], "id string, segment_id string, subject string, predicate string, object_entity string, object_value string, confidence double")
    assert {r["segment_id"]: [c["id"] for c in r["claims"]] for r in viewed(segments, claims).collect()} == {"a": ["1", "2"], "b": []}


def test_sql_functions_equal_columns(spark):
    sqlfunctions.register(spark)
    rows = [("word", "two words", [1.0, 2.0], [2.0, 1.0], [("user", "hé")]), ("", "", [0.0, 0.0], [1.0, 1.0], []), ("Ab c", None, None, [1.0], None), ("x", "x", [1.0], [1.0, 2.0], [("user", None)])]
    df = spark.createDataFrame(rows, "a string, b string, v array<float>, w array<float>, m array<struct<role: string, text: string>>")
    df.createOrReplaceTempView("given")
    got = spark.sql("SELECT projection_fingerprint(a, a, b, 1) p, source_fingerprint('s', a, 'e', m) s, name_similarity(a, b) n, cosine_distance(v, w) c FROM given").collect()
    want = df.select(
        ids.projection_fingerprint(F.col("a"), F.col("a"), F.col("b"), F.lit(1)), ids.source_fingerprint(F.lit("s"), F.col("a"), F.lit("e"), F.col("m")), text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b"))), 1 - scoring.cosine(F.col("v"), F.col("w"))
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert round(got[0]["n"], 4) == 0.3636


def test_keyed_state_survives_disorder_and_restarts(spark, tmp_path):
    """Batches of shuffled changes, the query stopped in between: the state is what folding all at once gives."""
    feed = [("a", 1, 0, "i", "x"), ("a", 2, 0, "u", None), ("a", 3, 0, "u", "y"), ("b", 1, 0, "i", "p"), ("b", 5, 0, "d", None), ("b", 4, 0, "u", "q"), ("c", None, 0, "u", "z"), ("d", 1, 0, "u", "w"), ("d", 1, 1, "d", None), ("d", 2, 0, "i", "v")]
    schema = "key string, g long, n long, op string, value string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.PROVIDER)
    rng, out = random.Random(4), []
    try:
        order = rng.sample(feed, len(feed))
        for n in range(2):
            spark.createDataFrame(order[n * 5 : n * 5 + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = keyed.latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", ["g", "n"], "value")
            q = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in out:
        if r["outcome"] != "late":
            last[r["key"]] = (r["first"], r["outcome"])
    folded = changefeed.fold(spark.createDataFrame(feed, schema), "key", ["g", "n"], ["value"])
    want = {r["key"]: (r["last"]["seq"]["s0"], "deleted" if r["last"]["kind"] == changefeed.DELETE else "set") for r in folded.collect()}
    assert last == want and all(r["first"] < last[r["key"]][0] or r["outcome"] != "late" for r in out if r["key"] != "d")


def test_trigram_candidates_equal_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    names = [(str(n), " ".join(word() for _ in range(rng.randint(1, 3)))) for n in range(80)]
    asked = [(n, " ".join(word() for _ in range(rng.randint(1, 3)))) for n in range(40)]
    got = {(r["query"], r["id"]): (round(r["similarity"], 9), r["place"]) for r in candidates.by_trigrams(spark.createDataFrame(asked, "query long, text string"), spark.createDataFrame(names, "id string, name string")).collect()}

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for q, t in asked:
        each = sorted(((len(grams(t) & grams(n)) / len(grams(t) | grams(n)), i) for i, n in names), key=lambda x: (-x[0], x[1]))
        want |= {(q, i): (round(s, 9), p) for p, (s, i) in enumerate([x for x in each if x[0] >= 0.3][:5], 1)}
    assert got == want


def test_backfill_plan(spark):
    part = lambda t: [("text", t, None, None, None, None)]
    rows = [(f"{s}{n}", s, "user", None, None, part("x" * 30), T0 + dt.timedelta(minutes=n), T0 + dt.timedelta(minutes=n)) for s in "pq" for n in range(3)] + [("q9", "q", "assistant", "q2", None, part("y"), T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "message_id string, session_id string, role string, parent_id string, error_name string, parts array<struct<type: string, text: string, tool: string, filename: string, mime: string, ignored: boolean>>, time_created timestamp, time_updated timestamp")
    none = spark.createDataFrame([], "segment_id string, fingerprint string, eligible boolean")
    made = {r["start_id"]: r for r in backfill.plan(df, none, "2025-01-01 02:05:00", limit=60).collect()}
    # the open segment of q waits: something was updated five minutes ago
    assert {k: (r["end_id"], r["closed"], r["status"]) for k, r in made.items()} == {"p0": ("p1", True, "new"), "p2": ("p2", False, "new"), "q0": ("q1", True, "new")}
    stored = spark.createDataFrame([(made["p0"]["segment_id"], made["p0"]["fingerprint"], True), (made["p2"]["segment_id"], "other", True), (made["q0"]["segment_id"], made["q0"]["fingerprint"], None)], none.schema)
    again = backfill.plan(df, stored, "2025-01-01 02:11:00", limit=60)
    assert {r["start_id"]: r["status"] for r in again.collect()} == {"p0": "eligible", "p2": "stale", "q0": "stale", "q2": "new"}
    assert {r["status"]: (r["sessions"], r["segments"], r["messages"]) for r in backfill.report(again).collect()} == {"eligible": (1, 1, 2), "stale": (2, 2, 3), "new": (1, 1, 2)}


def test_readers(spark, tmp_path):
    m = spark.createDataFrame([("m1", "s"), ("m2", "s")], "id string, session_id string")
    parts = spark.createDataFrame([("m1", "2", '{"type": "b"}'), ("m1", "1", '{"type": "a"}'), ("m1", "3", "{bad")], "message_id string, id string, data string")
    got = {r["id"]: r["parts"] for r in readers.assembled(m, parts, "type string").collect()}
    assert [p and p["type"] for p in got["m1"]] == ["a", "b", None] and got["m2"] == []
    assert {r["id"]: r["parts"] for r in readers.assembled(m, parts).collect()}["m1"] == ['{"type": "a"}', '{"type": "b"}', "{bad"]
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    few = readers.lookup(spark.read.parquet(str(tmp_path / "t")), "id", [3, 5, 2000])
    assert [r["id"] for r in few.sort("id").collect()] == [3, 5] and "PushedFilters: [In(id, [" in few._jdf.queryExecution().toString()
    s = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", None)], "id string, time_created long")
    assert [r["id"] for r in readers.newest_first(s).collect()] == ["c", "b", "a", "d"]
    assert [r["time_created"] for r in readers.in_order(s, "id", "time_created").where("id = 'b'").collect()] == [2]
    assert spark.range(1).select(text.iso_time(F.timestamp_millis(F.lit(1_735_689_600_123)))).first()[0] == "2025-01-01T00:00:00.123Z"


def test_valid_cache(spark):
    cache = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "k string, mark string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, mark string")
    assert {r["k"] for r in tables.still_valid(cache, now, ["k"], "mark").collect()} == {"a", "c", "d"}


def test_described_candidates(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (1, "z")], "query long, id string")
    e = spark.createDataFrame([("a", "A", None, ["zeta", "Beta", None]), ("b", "B", "d", None)], "id string, canonical_name string, description string, aliases array<string>")
    assert {r["id"]: (r["canonical_name"], r["aliases"]) for r in candidates.described(found, e).collect()} == {"a": ("A", ["Beta", "zeta"]), "b": ("B", []), "z": (None, [])}


def test_decisions_and_resolutions_by_number(spark):
    claims = spark.createDataFrame([("g", n, f"s{n}", "uses", 0.5, "o" if n == 2 else None, None if n == 2 else "v") for n in range(3)], "segment_id string, index int, subject string, predicate string, confidence double, object_entity string, object_value string")
    rows = extraction.mentions(claims).collect()
    assert sorted(r["mention_id"] for r in rows) == ["c0.subject", "c1.subject", "c2.object", "c2.subject"] and {r["embed_text"] for r in rows} >= {"o\ns2 | uses | o"}
    kept = extraction.decided(claims, spark.createDataFrame([("g", 2, "keep"), ("g", 1, "drop"), ("h", 0, "keep")], "segment_id string, index int, action string"))
    got = extraction.by_mention(kept, spark.createDataFrame([("g", "c2.subject", "e1"), ("g", "c2.object", "e2"), ("g", "c1.subject", "e3")], "segment_id string, mention_id string, entity_id string")).collect()
    assert [(r["index"], r["subject_entity_id"], r["object_entity_id"]) for r in got] == [(2, "e1", "e2")]
    made = spark.createDataFrame([("e", 2, "Other", "later", ["Pg", "PG "]), ("e", 1, "Postgres", "first", ["postgres", "pg"]), ("f", 3, "F", None, None)], "id string, seq int, canonical_name string, description string, aliases array<string>")
    assert {r["id"]: (r["canonical_name"], r["description"], r["aliases"]) for r in extraction.merged_entities(made).collect()} == {"e": ("Postgres", "first", ["pg"]), "f": ("F", None, [])}


def test_batches_for_an_embedder():
    assert [len(b) for b in extraction.batches_of(["x" * 30_000] * 4)] == [3, 1] and [len(b) for b in extraction.batches_of(["x"] * 129)] == [128, 1]
    assert list(extraction.batches_of([])) == []
    with pytest.raises(ValueError):
        list(extraction.batches_of(["é" * 15_001]))
