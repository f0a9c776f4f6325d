import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import ids, scoring, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("name", ["a", "", "session\0start", "Zoë 😀"])
def test_uuid5(spark, name):
    for space in (ids.SEGMENT_NAMESPACE, ids.ENTITY_NAMESPACE, ids.CLAIM_NAMESPACE):
        assert one(spark, name, lambda c, s=space: ids.uuid5(s, c)) == str(uuid.uuid5(uuid.UUID(space), name))


def test_made_ids(spark):
    r = spark.createDataFrame([("s", "m", 3)], "s string, m string, n int").select(ids.segment_id(F.col("s"), F.col("m")).alias("a"), ids.entity_id(F.col("s"), F.col("m")).alias("b"), ids.claim_id(F.col("s"), F.col("n")).alias("c")).first()
    assert tuple(r) == (str(uuid.uuid5(uuid.UUID(ids.SEGMENT_NAMESPACE), "s\0m")), str(uuid.uuid5(uuid.UUID(ids.ENTITY_NAMESPACE), "s\0m")), str(uuid.uuid5(uuid.UUID(ids.CLAIM_NAMESPACE), "s\x003")))


def test_source_fingerprint(spark):
    frame = lambda t: f"{len(t.encode())}:{t}"
    whole = "t1:" + frame("sess") + frame("start") + frame("énd") + "2:" + frame("user") + frame("hello") + frame("assistant") + frame("wörld 😀")
    df = spark.createDataFrame([([("user", "hello"), ("assistant", "wörld 😀")],), ([("user", None)],), (None,)], "m array<struct<role: string, text: string>>")
    got = [r[0] for r in df.select(ids.source_fingerprint(F.lit("sess"), F.lit("start"), F.lit("énd"), F.col("m"), "t1:")).collect()]
    assert got == [hashlib.sha256(whole.encode()).hexdigest(), None, None]


def test_projection_fingerprint_counts_code_points(spark):
    r = spark.range(1).select(ids.projection_fingerprint(F.lit("seg"), F.lit("é"), F.lit("😀x"), F.lit(1))).first()[0]
    assert r == hashlib.sha256("seg:1:é:2:😀x:1".encode()).hexdigest()


def test_equivalence_key_needs_one_object(spark):
    df = spark.createDataFrame([("s", "p", "e", None), ("s", "p", None, "v"), ("s", "p", None, None), ("s", "p", "e", "v")], "s string, p string, e string, v string")
    got = [r[0] for r in df.select(ids.equivalence_key(*(F.col(c) for c in "spev"))).collect()]
    assert got == [hashlib.sha256(b"s\0p\0entity:e").hexdigest(), hashlib.sha256(b"s\0p\0literal:v").hexdigest(), None, None]


@pytest.mark.parametrize("name", ["  DeepSeek\n V4  ", "Straße", "ΑΣ", "a b c", "İstanbul", "", " \t ", "ẞ", "x\x1cy"])
def test_normal_form(spark, name):
    wanted = " ".join(name.casefold().split())
    assert one(spark, name, text.normalize_name) == wanted
    assert one(spark, name, text.normalize_name_exact) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("has_storageBackend", "has storage backend"), ("usesHTTPClient", "uses http client"), ("opensPRs", "opens prs"), ("runs_e2e_tests", "runs e2e tests"), ("HTTPClient", "http client"), ("  two   words ", "two words"), ("setsSELinux labels", "sets selinux labels")],
)
def test_predicates(spark, given, wanted):
    got = one(spark, given, text.normalize_predicate)
    assert got == wanted and one(spark, got, text.natural_predicate)
    assert not one(spark, "has_backend", text.natural_predicate) and not one(spark, "hasBackend", text.natural_predicate)


def test_identifiers(spark):
    t = "tool_a1B used #42 in a.b.c and one_two_three at /usr/lib/x, Half-Done 1234abcd abcdef1 dead 0b0ab0bd-1ec9-5a28-96db-7b0816660771 one_two"
    assert one(spark, t, text.identifiers) == sorted(["tool_a1B", "#42", "a.b.c", "one_two_three", "/usr/lib/x,".rstrip(","), "Half-Done", "1234abcd", "abcdef1", "0b0ab0bd-1ec9-5a28-96db-7b0816660771"])


def test_unsupported_identifiers(spark):
    df = spark.createDataFrame([("see a.b.c, x.y and #7", "a and b and c and #7")], "o string, s string")
    assert df.select(text.unsupported(F.col("o"), F.col("s"))).first()[0] == ["x.y"]


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "two words"), ("", ""), ("Abc", "abc!")], "a string, b string")
    got = [round(r[0], 6) for r in df.select(text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).collect()]
    assert got == [0.363636, 0.0, 1.0]


@pytest.mark.parametrize("t", ["", "abc", "é", "😀😀x"])
def test_lengths(spark, t):
    df = spark.createDataFrame([(t,)], "x string").select(F.length("x"), text.utf8_length(F.col("x")), text.utf16_length(F.col("x"))).first()
    assert tuple(df) == (len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2)


def test_json_helpers(spark):
    assert one(spark, ' {"a": [1, 2]} trailing', text.first_json) == '{"a":[1,2]}'
    assert one(spark, "no json", text.first_json) is None
    assert one(spark, '{"u": "data:image/png;base64,AA", "k": "v"}', text.sanitized_json) == '{"u":"[data URL omitted]","k":"v"}'
    deep = "1"
    for _ in range(12):
        deep = f"[{deep}]"
    assert "nested value omitted" in one(spark, deep, text.sanitized_json)
    assert one(spark, "the key\n k3y failed", lambda c: text.redacted(c, F.lit("k3y"))) == "the key [REDACTED] failed"


def test_scores(spark):
    rows = [(True, -0.2, None, 0.5, None), (False, 1.0, 1.0, 1.0, None), (False, 0.5, None, 0.5, 3), (True, 1.0, None, 1.7, 20), (False, None, None, None, 2)]
    df = spark.createDataFrame(rows, "d boolean, s double, e double, c double, n long")
    got = [round(r[0], 6) for r in df.select(scoring.recall_score(*(F.col(c) for c in "dsecn"))).collect()]
    assert got == [1.1, 0.8, 0.32, 2.1, 0.02]


def test_limits_and_waits(spark):
    df = spark.createDataFrame([(80_000, None, 20_000), (200_000, 150_000, 0), (10_000, None, 50_000)], "c long, i long, o long")
    got = [tuple(r["l"]) for r in df.select(scoring.context_limits(F.col("c"), F.col("i"), F.col("o")).alias("l")).collect()]
    assert got[0] == (60_000, 60_000, 60_000, 20_000, 16_000) and got[1] == (130_000, 150_000, 130_000, 50_000, 40_000) and got[2][1] == 0
    t = spark.range(1).select(scoring.retry_at(F.lit("2025-01-01 00:00:00"), F.lit(3)).cast("string"), scoring.retry_at(F.lit("2025-01-01 00:00:00"), F.lit(3), 2.0, True).cast("string")).first()
    assert tuple(t) == ("2025-01-01 00:00:02", "2025-01-01 00:00:08")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None, None]


def test_what_a_model_sees_of_a_tool():
    deep = {"k": {"k": {"k": {"k": {"k": {"k": {"k": {"k": {"k": {"k": 1}}}}}}}}}}
    shown = text.trimmed_value(deep)
    for _ in range(8):
        shown = shown["k"]
    assert shown == {"k": text.NESTED_MARK} and deep["k"]["k"]["k"]["k"]["k"]["k"]["k"]["k"]["k"] == {"k": 1}
    assert text.trimmed_value(["data:x", {"u": "data:,y"}, "plain", None, 1.5]) == [text.DATA_URL_MARK, {"u": text.DATA_URL_MARK}, "plain", None, 1.5]
    nested = 1
    for _ in range(5_000):
        nested = [nested]
    assert text.compact_json(text.trimmed_value(nested)) == "[" * 9 + '"' + text.NESTED_MARK + '"' + "]" * 9
    assert text.shown_state({"output": "long", "time": {"compacted": 5}})["output"] == text.CLEARED_MARK
    assert text.shown_state({"output": "long", "time": {"compacted": True}})["output"] == "long"
    assert text.compact_json({"a": 1.0, "b": [2.5]}) == '{"a":1,"b":[2.5]}'


def test_weights_of_tools_and_files():
    assert text.tool_weight_of(None) == text.tool_weight_of("{not json") == 4
    assert text.tool_weight_of('{"status": "completed", "attachments": [{"mime": "image/png"}]}') == len('{"status":"completed","attachments":[{"mime":"image/png"}]}') + 32_000
    assert text.tool_weight_of('{"status": "running", "attachments": [{"mime": "image/png"}]}') == len('{"status":"running","attachments":[{"mime":"image/png"}]}')
    assert text.tool_weight_of('{"status": "completed", "attachments": [7]}') == float("inf")
    assert text.tool_weight_of('"\U0001f600"') == 4


@pytest.mark.parametrize(
    ("mime", "url", "size", "tokens"),
    [("image/png", None, None, 8000.0), ("text/plain", None, None, float("inf")), ("text/plain", "https://x.example/,y", None, float("inf")), (None, "data:text/plain,ä€", 5, 8000.0), ("a/b", "data:a/b;base64," + "A" * 40_001, 30_001, 15_001.0), ("a/b", "data:nothing", None, float("inf"))],
)
def test_media(spark, mime, url, size, tokens):
    df = spark.createDataFrame([(mime, url)], "m string, u string")
    r = df.select(text.data_url_bytes(F.col("u")).alias("size"), text.media_tokens(F.col("m"), F.col("u")).alias("tokens")).first()
    assert (r["size"], r["tokens"]) == (size, tokens) and text.media_tokens_of({"mime": mime, "url": url}) == tokens


def test_json_of_a_kind(spark):
    df = spark.createDataFrame([("[1]",), ('{"a": 1}',), ('"x"',), ("3",), ("true",), ("{bad",), (None,)], "t string")
    for kind, at in (("array", 0), ("object", 1), ("string", 2), ("number", 3), ("boolean", 4)):
        assert [n for n, r in enumerate(df.select(text.typed_json(F.col("t"), kind).alias("v")).collect()) if r["v"] is not None] == [at], kind
