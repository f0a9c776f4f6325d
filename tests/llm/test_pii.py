import random

import pytest

from skeinwork.llm import pii

SCHEMA = "segment_id string, messages array<struct<role: string, text: string>>, item string, start int, seed string, n int"


def table(spark, texts):
    return spark.createDataFrame([(f"s{i:03}", [("user", t)], "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)


def found(df):
    return {(r["id"], r["message_no"], r["pii_type"], r["pii_text"]) for r in pii.found(df).collect()}


SURNAMES = ["Brenkowa", "Halmedi", "Torvik", "Quessard", "Lindero", "Maskule", "Ferrano", "Ostrello"]
GIVEN = ["Anna", "Peter", "Maria", "Robert", "Natalia", "Samuel", "Thomas", "Sarah"]


def corpus():
    texts = []
    for n, (g, s) in enumerate(zip(GIVEN, SURNAMES, strict=True)):
        texts += [
            f"Please forward this to {g} {s} before noon.",
            f"You can mail {g.lower()}.{s.lower()}@mail{n}.example any time.",
            f"My number is +49 30 23125 {n}0{n}, thanks.",
            f"The permit no. 9{n}1-1{n}-20{n}7 was rejected.",
            f"Deliver it to {n + 3} Lower {s} Road, Flat {n}, Norwick.",
            f"Build 2024{n}187-664{n} took 9{n}7 ms.",
            f"The Upper {s} service logged 7{n}004 rows.",
        ]
    return texts


def test_types_and_discovery(spark):
    unseen = ["Please forward this to Zuvanka Threll before noon.", "My number is 0712 553 8{0}1, thanks.".replace("{0}", "8"), "The permit no. 42 553 218 701 was rejected.", "Write to jo.doe (at) desk dot example any time."]
    texts = corpus() + unseen * 2
    got = found(table(spark, texts))
    by = lambda t: {x[3] for x in got if x[2] == t}
    assert by("person") == {f"{g} {s}" for g, s in zip(GIVEN, SURNAMES, strict=True)} | {"Zuvanka Threll"}
    assert by("phone") == {f"+49 30 23125 {n}0{n}" for n in range(8)} | {"0712 553 881"}
    assert by("id_number") == {f"9{n}1-1{n}-20{n}7" for n in range(8)} | {"42 553 218 701"}
    assert by("address") == {f"{n + 3} Lower {s} Road, Flat {n}, Norwick" for n, s in enumerate(SURNAMES)}
    assert {f"{g.lower()}.{s.lower()}@mail{n}.example" for n, (g, s) in enumerate(zip(GIVEN, SURNAMES, strict=True))} <= by("email")


def test_masked_text_stays_readable(spark):
    df = table(spark, [*corpus(), "no item here"])
    out = {r["id"]: r["text"] for r in pii.masked(df, pii.found(df)).collect()}
    assert out["s000"] == "Please forward this to [PERSON] before noon."
    assert out["s001"] == "You can mail [EMAIL] any time."
    assert out["s002"] == "My number is [PHONE], thanks."
    assert out["s005"] == corpus()[5] and out[f"s{len(corpus()):03}"] == "no item here"


def test_nulls_empty_repeats_and_long(spark):
    long = "x" * 200_000 + " a.b@c.example " + "12 " * 20_000
    rows = [("a", [("user", "Mail a.b@c.example."), ("user", None), ("user", "")], None, None, None, None)] * 2 + [("b", None, None, None, None, None), (None, [("user", "a@b.example")], None, None, None, None), ("c", [("user", long)], None, None, None, None), ("d", [], None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {x for x in found(df) if x[2] == "email"} == {("a", 1, "email", "a.b@c.example"), ("c", 1, "email", "a.b@c.example")}
    assert pii.masked(df, pii.found(df)).count() == 2
    assert found(df.limit(0)) == set()


@pytest.mark.parametrize(
    ("text", "item"),
    [
        ("at ul. Quillen 178/13, 37-931 Lipno today", "ul. Quillen 178/13, 37-931 Lipno"), ("at PO Box 231, Eskerby 91852 today", "PO Box 231, Eskerby 91852"), ("at Calle Mayor 138, 3º B, 90583 Kaltenau.", "Calle Mayor 138, 3º B, 90583 Kaltenau"),
        ("at 139 chemin de Tambre, 65646 Luna The next", "139 chemin de Tambre, 65646 Luna"), ("at Gartenweg 72, 45101 Luna last", "Gartenweg 72, 45101 Luna"),
    ],
)
def test_address_forms(text, item):
    assert item in {text[a:b] for cls, a, b, *_ in pii.candidates(text) if cls == "address"}


@pytest.mark.parametrize("text", ["node 192.0.2.175:7093 answered", "Installed @a/gate@8.15.9 fine", "at 2025-08-12T01:37:00Z", "run 9802569e-497c-521b-a473-e214a7baec9f", "batch 824 502 of 81"])
def test_what_is_no_candidate(text):
    assert [c for c in pii.candidates(text) if c[0] != "part"] == []


def test_names_cities_and_domains_in_no_list(spark):
    """Made-up names are learned from titles, greetings, closings and labels, and found where nothing but the wording says so."""
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)).capitalize()
    given, texts, want = [make(3) for _ in range(12)], [], set()
    frames = ["Hallo {}, der Bericht fehlt.", "Thanks for all.\nCheers,\n{}", "Autor: {}", "Bonjour {}, voici la suite.", "The visit was booked by {} for the night shift.", "We handed the keys over to {} at the gate.", "Ask {} about the lift.", "Es wurde von {} gemeldet."]
    for n in range(240):
        who = f"{rng.choice(given)} {make(4)}" if n % 7 else f"{rng.choice(given)} van {make(3)}"
        box = f"{make(2).lower()}{n}@{make(3).lower()}.test"
        street = f"{rng.randint(1, 90)} {make(3)} Lane, {make(3)}"
        i = f"s{n:03}"
        texts.append(f"{frames[n % 8].format(who)}\nMail goes to {box} now. Send it to {street}.\nThe {make(3)} {make(2)} module restarted.")
        want |= {(i, 1, "person", who), (i, 1, "email", box), (i, 1, "address", street)}
    got = found(table(spark, texts))
    for kind in ("person", "email", "address"):
        true, said = ({x for x in s if x[2] == kind} for s in (want, got))
        assert len(true & said) >= 0.9 * len(true) and len(true & said) >= 0.9 * len(said), kind


def test_titles_particles_and_long_tokens():
    spans = lambda t: {(t[a:b], seed) for cls, a, b, _, seed, *_ in pii.candidates(t) if cls == "person"}
    assert ("Threll", "person") in spans("we met Dr. Threll there")
    assert ("Ludo van der Meeren", "person") in spans("Dear Ludo van der Meeren, hello")
    assert ("Ανδρέας Παπάς", "person") in spans("Author: Ανδρέας Παπάς")
    assert ("Otto Brams", "person") in spans("otto.brams@x.example is what Otto Brams uses")
    text = "z" * 5_000 + " Otto Brams " + "y" * 5_000
    left, one, *_ = pii.contexts(text, 5_001, 5_011)
    assert one.startswith("#") and len(left) < 40
