import pytest

from skeinwork.llm import names

ENTITIES = [
    ("p1", "Wilhelmina Wenaelholm", ["Mina Wenaelholm"]), ("p2", "Daniel Ilmdiley", []), ("p3", "José Fencequist", ["Pepe Fencequist", "J. Fencequist"]), ("p4", "Matthew Zelomazak", []), ("p5", "Margaret Zelomazak", None),
    ("p6", "Zoë Dornurath", []), ("p7", "Wilhelmina Solbazak", []), ("o1", "Ostcetti Software Ltd", ["Ostcetti Software"]), ("o2", "Fensithal Systems GmbH", []), ("o3", "Dorredez Logistics S.A.", []), ("x1", "Kelextan Ledger Console", []), ("n", None, None), (None, "Nobody Known", []),
]


#: Short forms that the entities' aliases do not teach.
SHORT = [("daniel", "dan"), ("matthew", "matt"), ("margaret", "peggy")]


def link(spark, texts):
    m = spark.createDataFrame([(n, t, "id", "cost") for n, t in enumerate(texts)], "mention_key long, text string, id string, cost string")
    e = spark.createDataFrame(ENTITIES, "id string, canonical_name string, aliases array<string>")
    got = {r["mention_key"]: r["entity_id"] for r in names.link(m, e, nicknames=spark.createDataFrame(SHORT, "full string, nick string")).collect()}
    return [got.get(n) for n in range(len(texts))]


CASES = [
    ("Wilhelmina Wenaelholm", "p1"), ("WENAELHOLM, MINA", "p1"), ("Mina Solbazak", "p7"), ("W. Wenaelholm", "p1"), ("Wenaelholm  W.", "p1"), ("wilhelmina.wenaelholm", "p1"), ("@wwenaelholm", "p1"), ("Dr Daniel K. Ilmdiley", "p2"),
    ("Daniel Ilmdliey", "p2"), ("Dan Ilmdiley", "p2"), ("Jose Fencequist", "p3"), ("Fencequist, Pepe", "p3"), ("Matt Zelomazak", "p4"), ("Peggy Zelomazak", "p5"), ("M. Zelomazak", None), ("Zelomazak", None), ("Zoe\xa0Dornurath", "p6"),
    ("ostcetti-software", "o1"), ("OstcettiSoftware", "o1"), ("Ostcetti Soft. Ltd.", "o1"), ("Fensithal Systems", "o2"), ("the Fensithal people", "o2"), ("Dorredez Logi. S.A.", "o3"), ("DORREDEZ LOGISTICCS SA", "o3"), ("our Kelextan console", "x1"),
    ("Daniel", None), ("the Software vendor", None), ("Daniel Unheardof", None), ("Fensithal Foods AG", None), ("jorre-queue", None), ("", None), ("   ", None), (None, None), ("…", None), ("Nobody Known", None), ("D. I.", None),
]


def test_spellings(spark):
    texts, wanted = zip(*CASES, strict=True)
    got = link(spark, texts)
    assert [(t, g) for t, g, w in zip(texts, got, wanted, strict=True) if g != w] == []


def test_long_text_and_empty_tables(spark):
    assert link(spark, ["Daniel Ilmdiley " + "word " * 20_000]) == [None]
    m = spark.createDataFrame([], "mention_key long, text string")
    e = spark.createDataFrame([], "id string, canonical_name string, aliases array<string>")
    assert names.link(m, e).count() == 0
    assert names.link(spark.createDataFrame([(1, "Daniel Ilmdiley")], m.schema), e).count() == 0


def test_many_titles_around_a_name(spark):
    assert link(spark, ["Daniel Ilmdiley", "Dr. " * 12 + "Daniel Ilmdiley", "x y z " * 4 + "Daniel Ilmdiley", "word " * 12 + "Daniel Ilmdiley"]) == ["p2", "p2", "p2", None]


def test_a_key_with_two_texts(spark):
    e = spark.createDataFrame(ENTITIES, "id string, canonical_name string, aliases array<string>")
    m = spark.createDataFrame([(1, "Daniel Ilmdiley"), (1, "Dan Ilmdiley"), (2, "Daniel Ilmdiley"), (2, "Zoe Dornurath"), (None, "Zoe Dornurath"), (3, "Zoe Dornurath"), (3, "Zoe Dornurath")], "mention_key long, text string")
    assert {(r["mention_key"], r["entity_id"]) for r in names.link(m, e).collect()} == {(1, "p2"), (3, "p6")}


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "abcd", 1), ("abc", "axc", 1), ("abcd", "badc", 2), ("abc", "xyz", 3), ("", "ab", 2)])
def test_distance(a, b, d):
    assert names.distance(a, b) == d


def test_deletions_meet_within_one_edit():
    for a, b in (("wenford", "wneford"), ("wenford", "wenfrd"), ("wenford", "wenfoord"), ("wenford", "wenfxrd")):
        assert {*names.deletions(a)} & {*names.deletions(b)}


def test_a_wider_limit_is_honoured(spark):
    """Three words too many cost 1.5, beyond what the standard limit lets an alignment follow to its end."""
    e = spark.createDataFrame(ENTITIES, "id string, canonical_name string, aliases array<string>")
    m = spark.createDataFrame([(1, "one two three four Daniel Ilmdiley")], "mention_key long, text string")
    assert names.link(m, e).count() == 0 and [r["entity_id"] for r in names.link(m, e, limit=2.5).collect()] == ["p2"]
