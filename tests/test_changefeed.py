import random

from skeinwork.operators import changefeed as cf

SCHEMA = "segment_id string, op string, source_generation long, attempts int, source_fingerprint string, key string, kind string, seq int, last string"
ORDER, PAYLOAD = ["source_generation", "attempts"], ["source_fingerprint"]


def row(s, op, g, a, f=None):
    return (s, op, g, a, f, "k", "x", 1, "l")


def brute(rows):
    changes = {}
    names = {n: k for k, ns in cf.SPELLINGS.items() for n in ns}
    for s, op, g, a, f, *_ in rows:
        kind = names.get((op or "").strip().lower())
        if s is None or g is None or kind is None:
            continue
        k, old = changes.setdefault(s, {}).get((g, a or 0), (-1, None))
        f = None if kind == cf.DELETE else f
        changes[s][g, a or 0] = (max(kind, k), max((x for x in (f, old) if x is not None), default=None))
    out = {}
    for s, by in changes.items():
        state = None
        for (g, a), (kind, f) in sorted(by.items()):
            if kind == cf.DELETE:
                state = None
            elif kind == cf.INSERT or state is None:
                state = (g, f)
            else:
                state = (g, f if f is not None else state[1])
        if state:
            out[s] = state
    return out


def run(spark, rows):
    state = cf.fold(spark.createDataFrame(rows, SCHEMA), "segment_id", ORDER, PAYLOAD)
    return {r["segment_id"]: (r["source_generation"], r["source_fingerprint"]) for r in cf.current(state, "segment_id", ORDER, PAYLOAD).collect()}


def test_cases(spark):
    rows = [
        row("new", "INSERT ", 1, 0, "a"), row("late", "u", 3, 0, "c"), row("late", "I", 1, 0, "a"), row("gone", "c", 1, 0, "a"), row("gone", "D", 2, 0), row("gone", "update", 1, 1, "z"), row("back", "insert", 1, 0, "a"), row("back", "delete", 2, 0), row("back", "update", 3, 0),
        row("kept", "insert", 1, 0, "a"), row("kept", "update", 2, 0), row("only", "update", 5, 2, "u"), row("void", "insert", None, 0, "a"), row("odd", "truncate", 1, 0, "a"), row(None, "insert", 1, 0, "a"), row("nulls", "insert", 1, None, "a"), row("nulls", "u", 1, 1, "b"),
    ]
    got = run(spark, rows)
    assert got == brute(rows) == {"new": (1, "a"), "late": (3, "c"), "back": (3, None), "kept": (2, "a"), "only": (5, "u"), "nulls": (1, "b")}


def test_any_order_any_repeats_in_parts(spark):
    rng = random.Random(1)
    for _ in range(3):
        rows = [row(f"s{rng.randint(0, 8)}", rng.choice(["I", "update", "U", "d", "x", None]), rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 2), rng.choice([None, "a", "b", "c"])) for _ in range(120)]
        wanted = brute(rows)
        mixed = rows + rng.sample(rows, 40)
        rng.shuffle(mixed)
        assert run(spark, mixed) == wanted
        feeds = [spark.createDataFrame(mixed[i::3], SCHEMA) for i in range(3)]
        state = cf.apply_feeds(feeds, "segment_id", ORDER, PAYLOAD)
        assert {r["segment_id"]: (r["source_generation"], r["source_fingerprint"]) for r in cf.current(state, "segment_id", ORDER, PAYLOAD).collect()} == wanted


def test_a_tombstone_stops_late_changes(spark):
    first = cf.fold(spark.createDataFrame([row("s", "insert", 1, 0, "a"), row("s", "delete", 5, 0)], SCHEMA), "segment_id", ORDER, PAYLOAD)
    after = cf.fold(spark.createDataFrame([row("s", "update", 3, 0, "b")], SCHEMA), "segment_id", ORDER, PAYLOAD, base=first)
    assert cf.current(after, "segment_id", ORDER, PAYLOAD).count() == 0 and after.count() == 1


def test_empty(spark):
    assert run(spark, []) == {}


def test_long_values(spark):
    assert run(spark, [row("s", "insert", 1, 0, "f" * 1_000_000)])["s"][1] == "f" * 1_000_000
