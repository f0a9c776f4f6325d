import random

import pytest

from skeinwork.llm import mixing

SIZED, TARGETS = "id long, source string, n_tokens long, weight double, pass_no int", "source string, target_share double, max_repeats int"


def build(spark, rows, goals):
    return spark.createDataFrame([(*r, 1.0, 1) for r in rows], SIZED), spark.createDataFrame(goals, TARGETS)


def test_shares_repeats_and_order(spark):
    rng = random.Random(1)
    rows = [(n, "big" if n % 10 < 6 else "mid" if n % 10 < 9 else "rare", rng.randint(1, 200)) for n in range(3000)]
    sized, targets = build(spark, rows, [("big", 0.3, 1), ("mid", 0.3, 2), ("rare", 0.4, 3)])
    mixed = mixing.mixture(sized, targets)
    got = mixed.collect()
    total = sum(r["n_tokens"] for r in got)
    share = {s: sum(r["n_tokens"] for r in got if r["source"] == s) / total for s in ("big", "mid", "rare")}
    assert share == pytest.approx({"big": 0.3, "mid": 0.3, "rare": 0.4}, abs=0.01)
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    uses = {}
    for r in got:
        uses[r["id"], r["source"]] = uses.get((r["id"], r["source"]), 0) + 1
    assert max(v for (_, s), v in uses.items() if s == "rare") == 3 and max(v for (_, s), v in uses.items() if s == "big") == 1
    half = got[: len(got) // 2]
    at = sum(r["n_tokens"] for r in half)
    assert sum(r["n_tokens"] for r in half if r["source"] == "rare") / at == pytest.approx(0.4, abs=0.02)
    assert {r["source"]: r["share"] for r in mixing.shares(mixed, targets).collect()} == pytest.approx(share)


def test_brute_force(spark):
    rows = [(n, f"s{n % 3}", 1 + n * 7 % 13) for n in range(90)]
    sized, targets = build(spark, rows, [("s0", 0.5, 1), ("s1", 0.25, 2), ("s2", 0.25, 1)])
    got = mixing.mixture(sized, targets, budget=300).collect()
    for s, w in (("s0", 0.5), ("s1", 0.25), ("s2", 0.25)):
        cumulative = 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: r["finish"]):
            cumulative += r["n_tokens"]
            assert r["finish"] == pytest.approx(cumulative / w)
        assert cumulative <= 300 * w


def test_nulls_unknown_and_empty(spark):
    rows = [(1, "a", 10), (2, None, 10), (3, "unknown", 10), (4, "a", 0), (5, "a", None), (None, "a", 5)]
    sized, targets = build(spark, rows, [("a", 1.0, 2), (None, 0.5, 1), ("z", 0.0, 3), ("y", 0.5, 0)])
    assert [(r["id"], r["pass_no"]) for r in mixing.mixture(sized, targets).collect()] == [(1, 1), (1, 2)]
    assert mixing.mixture(sized.limit(0), targets).count() == 0
    assert mixing.mixture(sized, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mixture(sized.limit(0), targets), targets).count() == 3
