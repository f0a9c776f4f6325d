import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.llm import packing, tokens


def best_fit(sizes, capacity):
    """Best-fit decreasing, to compare with."""
    free = []
    for w in sorted(sizes, reverse=True):
        fits = [r for r in free if r >= w]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else capacity) - w)
    return len(free)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_every_item_once_and_none_over(sizes):
    bins, _ = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(packing.next_fit(sizes, 100))


def test_search_beats_the_start_and_best_fit():
    sizes = [51] * 6 + [27] * 6 + [26] * 6 + [23] * 12
    bins, exchanges = packing.pack(sizes, 100)
    assert len(packing.next_fit(sizes, 100)) == 13 and best_fit(sizes, 100) == 11
    assert len(bins) == 9 and exchanges > 0
    rng = random.Random(4)
    cases = [[rng.randint(low, high) for _ in range(rng.randint(30, 200))] for low, high in [(1, 100), (10, 60), (24, 54), (1, 30)] * 8]
    assert sum(len(packing.pack(c, 100)[0]) for c in cases) < sum(best_fit(c, 100) for c in cases)


def test_an_exchange_raises_the_squared_fill():
    rng = random.Random(3)
    made = 0
    for _ in range(300):
        a, b, c = ([rng.randint(1, 40) for _ in range(rng.randint(1, 4))] for _ in range(3))
        sizes, at = a + b + c, [[*range(len(a))], [*range(len(a), len(a) + len(b))], [*range(len(a) + len(b), len(a) + len(b) + len(c))]]
        if all(sum(x) <= 100 for x in (a, b, c)):
            shelf = packing.Shelf(sizes, at, 100)
            before = int((shelf.fill**2).sum())
            if shelf.step(0):
                made += 1
                assert (shelf.fill**2).sum() > before and shelf.fill.max() <= 100
                assert sorted(i for x in shelf.items for i in x) == list(range(len(sizes)))
                assert shelf.fill.tolist() == [sum(sizes[i] for i in x) for x in shelf.items]
    assert made > 100


SCHEMA = "id long, n_tokens long, shard long, n long, part int"


def test_table(spark):
    rng = random.Random(2)
    sizes = [rng.choice([3, 50, 400, 1900, 2048, 2049, 9000]) for _ in range(400)]
    rows = [(n, s, 1, 1, 1) for n, s in enumerate(sizes)] + [(900, 0, 1, 1, 1), (901, None, 1, 1, 1), (None, 5, 1, 1, 1)]
    got = packing.fill(spark.createDataFrame(rows, SCHEMA), shard=100).collect()
    spans, load, places = {}, {}, {}
    for r in got:
        spans.setdefault(r["id"], []).append((r["token_start"], r["token_end"]))
        load[r["container_no"]] = load.get(r["container_no"], 0) + r["token_end"] - r["token_start"]
        places.setdefault(r["container_no"], []).append(r["place"])
    assert max(load.values()) <= 2048
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    for n, s in enumerate(sizes):
        assert sorted(spans[n])[0][0] == 0 and sorted(spans[n])[-1][1] == s and (s > 2048 or len(spans[n]) == 1)
        assert sum(b - a for a, b in spans[n]) == s
    assert {*spans} == {*range(400)} and {*load} == {*range(len(load))}
    assert packing.fill(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("text", ["", "plain words", "ä€😀 mixed\n\n  spaces", "<|endoftext|>", "x" * 20_000])
def test_tokens_round_trip(text):
    assert tokens.decode(tokens.encode(text)) == text.encode()


def test_counted(spark):
    df = spark.createDataFrame([(1, "one two", "a", 9), (1, "one two", "a", 9), (2, None, None, 9), (None, "x", "a", 9), (3, "word " * 30_000, "b", 9)], "doc_id long, text string, source string, id int")
    got = {r["id"]: (r["source"], r["n_tokens"]) for r in tokens.counted(df, "doc_id", "text", {"source": "source"}).collect()}
    assert got == {1: ("a", 2), 2: (None, 0), 3: ("b", len(tokens.encode("word " * 30_000)))}
