import numpy as np
import pytest

from skeinwork.llm import knn
from skeinwork.llm.keys import pack, unpack

SCHEMA = "id string, embedding array<float>, cell int, v string, vec string"


def rows(ids, x):
    return [(i, [float(a) for a in v], 1, "x", None) for i, v in zip(ids, x, strict=True)]


def brute(ids, x, k):
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i, me in enumerate(ids):
        out[me] = [ids[j] for j in sorted((j for j in range(len(ids)) if ids[j] != me), key=lambda j: (-s[i, j], ids[j]))[:k]]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["place"])):
        out.setdefault(r["id"], []).append(r["other"])
    return out


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    ids = [f"i{n:03}" for n in range(60)]
    df = spark.createDataFrame(rows(ids, x), SCHEMA)
    assert got(knn.neighbours(df, 8)) == brute(ids, x, 5)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((200, 32))
    x = (centers[:, None, :] + 0.25 * rng.standard_normal((200, 20, 32))).reshape(-1, 32)
    ids = [f"{n:05}" for n in range(len(x))]
    found = got(knn.neighbours(spark.createDataFrame(rows(ids, x), SCHEMA), 32))
    true = brute(ids, x, 5)
    hit = sum(len({*found.get(i, [])} & {*true[i]}) for i in ids)
    assert hit / (5 * len(ids)) >= 0.97


def test_unusable_vectors_repeats_and_nulls(spark):
    x = [[1, 0, 0, 0], [0.9, 0.1, 0, 0], [0, 1, 0, 0]]
    data = rows(["a", "b", "c"], x) + rows(["a"], [[1, 0, 0, 0]])
    data += [("d", None, 1, None, None), ("e", [], 1, None, None), ("f", [1.0], 1, None, None), ("g", [0.0] * 4, 1, None, None), ("h", [1.0, None, 0.0, 0.0], 1, None, None), (None, [1.0, 0.0, 0.0, 0.0], 1, None, None), ("n", [float("nan")] * 4, 1, None, None)]
    found = got(knn.neighbours(spark.createDataFrame(data, SCHEMA), 4))
    assert found == {"a": ["b", "c"], "b": ["a", "c"], "c": ["b", "a"]}


def test_many_copies_tie_to_the_smallest_ids(spark):
    ids = [f"{n:04}" for n in range(300)]
    x = [[3.0, 4.0, 0, 0]] * 200 + [[0, 0, 1.0, n / 1000] for n in range(100)]
    found = got(knn.neighbours(spark.createDataFrame(rows(ids, x), SCHEMA), 4))
    assert found["0150"] == ids[:5]
    assert found["0002"] == ["0000", "0001", "0003", "0004", "0005"]
    assert len(found) == 300 and all(len(v) == 5 for v in found.values())


def test_empty_table(spark):
    assert knn.neighbours(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_a_hot_list_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "PORTION", 128)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 8))
    ids = [f"{n:04}" for n in range(400)]
    found, true = got(knn.neighbours(spark.createDataFrame(rows(ids, x), SCHEMA), 8, probes=22, margin=3.0)), brute(ids, x, 5)
    assert sum({*found[i]} == {*true[i]} for i in ids) >= 398


def test_scan_agrees_with_all_pairs():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((50, 64))
    x = (centers[:, None] + 0.3 * rng.standard_normal((50, 30, 64))).reshape(-1, 64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) @ knn.rotation(64)
    row, col, _ = knn.scan(x, x[:300], 5)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    hit = sum(len({*col[row == q]} & {*true[q]}) for q in range(300))
    assert hit / (6 * 300) > 0.98


@pytest.mark.parametrize("key", ["0b0ab0bd-1ec9-5a28-96db-7b0816660771", "short", "", "fifteen letters", "Äö" * 9, "0B0AB0BD-1EC9-5A28-96DB-7B0816660771"])
def test_keys_round_trip(spark, key):
    df = spark.createDataFrame([(key,)], "k string")
    r = df.select(pack(df.k).alias("p")).select("p", unpack(__import__("pyspark").sql.functions.col("p")).alias("k")).first()
    assert r["k"] == key
