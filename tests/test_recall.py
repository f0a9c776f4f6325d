import numpy as np
from pyspark.sql import functions as F

from skeinwork.operators import candidates, recall


def claims(spark, n=120, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i:03}", [float(x) for x in rng.standard_normal(dim)], f"e{i % 7}", f"e{i % 5 + 7}" if i % 3 else None, float(rng.random()), f"k{i % 50}", f"s{i % 9}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, vector array<float>, subject_entity_id string, object_entity_id string, confidence double, equivalence_key string, segment_id string")


def queries(spark, n=5, dim=8):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "query long, vector array<float>")


def brute(q, rows):
    unit = lambda v: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))
    return {i: sorted(((float(unit(v) @ unit(r[1])), r[0]) for r in rows), key=lambda x: (-x[0], x[1])) for i, v in q}


def test_nearest_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK", 2)
    (rows, c), (qs, q) = claims(spark), queries(spark)
    got = {}
    for r in recall.nearest(q, c, 8, 10).collect():
        got.setdefault(r["query"], {})[r["place"]] = r["id"]
    assert {k: [v[p] for p in sorted(v)] for k, v in got.items()} == {k: [i for _, i in v[:10]] for k, v in brute(qs, rows).items()}
    assert recall.nearest(q.limit(0), c, 8, 10).count() == 0 and recall.nearest(q, c.limit(0), 8, 10).count() == 0


def test_neighbours(spark):
    (rows, c), (qs, q) = claims(spark), queries(spark)
    seeded = spark.createDataFrame([(0, "e1", 0.5), (0, "e9", 0.1), (3, "e1", 0.2), (4, "none", 0.9)], "query long, entity string, seed double")
    got = {(r["query"], r["entity"], r["id"], r["seed"]) for r in recall.neighbours(q, seeded, c, 8, 4).collect()}
    ends, order = {r[0]: {r[2], r[3]} for r in rows}, brute(qs, rows)
    assert got == {(n, e, i, s) for n, e, s in ((0, "e1", 0.5), (0, "e9", 0.1), (3, "e1", 0.2)) for _, i in [x for x in order[n] if e in ends[x[1]]][:4]}


def test_recall_prefers_direct_and_counts_support(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0], "x", None, 0.5, "k1", "s1"), ("b", [0.9, 0.1], "x", "y", 0.9, "k1", "s2"), ("c", [-1.0, 0.1], "y", None, None, "k2", "s3"), ("d", [0.0, 1.0], "y", None, 1.4, "k3", None)], "id string, vector array<float>, subject_entity_id string, object_entity_id string, confidence double, equivalence_key string, segment_id string")
    segments = spark.createDataFrame([("s1", "p"), ("s2", "q"), ("s2", "q"), ("s3", "p")], "segment_id string, session_id string")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query long, vector array<float>")
    got = recall.recall(q, c, segments, 2, direct_k=2).sort("place").collect()
    assert [(r["id"], r["equivalence_key"], r["is_direct"], r["support_count"], r["session_count"]) for r in got] == [("b", "k1", True, 2, 2), ("d", "k3", False, 1, 1), ("c", "k2", False, 1, 1)]
    assert abs(got[0]["score"] - (1 + 0.8 * got[0]["similarity"] + 0.2 * 0.9 + 0.02)) < 1e-9


def test_usable_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("b", None, 1), ("c", [1.0], 1), (None, [1.0, 2.0], 1), ("d", [0.0, 0.0], 1), ("e", [1.0, None], 1), ("f", [float("nan"), 1.0], 1)], "id string, v array<float>, vector int")
    assert [r["id"] for r in recall.usable(df, 2, "id", "v", []).collect()] == ["a"]


def test_candidates(spark):
    names = spark.createDataFrame([("1", "PostgreSQL"), ("1", "Postgres"), ("2", "SQLite"), ("3", "MySQL"), (None, "x")], "id string, name string")
    q = spark.createDataFrame([(1, "postgres"), (2, "my sql"), (3, ""), (4, None), (5, "postgres")], "query long, text string")
    got = {(r["query"], r["id"], r["place"]): round(r["similarity"], 3) for r in candidates.by_trigrams(q, names).collect()}
    assert got[1, "1", 1] == 1.0 and got[5, "1", 1] == 1.0 and not any(k[0] in (3, 4) for k in got)


def test_union_keeps_the_first(spark):
    trigram = spark.createDataFrame([(1, f"t{i}", i) for i in range(1, 8)], "query long, id string, place int")
    vector = spark.createDataFrame([(1, i, p) for p, i in enumerate(["t2", "v1", "v2", "v3", "v4", "v5"], 1)], "query long, id string, place int")
    got = candidates.union(trigram, vector).sort("place")
    assert [r["id"] for r in got.collect()] == ["t1", "t2", "t3", "t4", "t5", "v1", "v2", "v3", "v4"]
    assert got.where(F.col("source") == "vector").count() == 4
