import itertools
import random

import pytest
from pyspark.sql import functions as F

from skeinwork.llm import neardup


def texts(seed, families=60, size=4, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(3000)]
    out = []
    for f in range(families):
        base = rng.sample(vocabulary, words)
        for n in range(size):
            w = list(base)
            for i in rng.sample(range(words), rng.choice([0, 1, 2, 4, 6])):
                w[i] = rng.choice(vocabulary)
            rng.shuffle(w)
            out.append((f"id{f:03}-{n}", " ".join(w)))
    return out


def brute(rows, threshold):
    sets = {i: {*t.lower().split()} for i, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def run(spark, rows, threshold=0.6):
    df = spark.createDataFrame(rows, "id string, t string, key string, rep string, bucket long") if rows and len(rows[0]) > 2 else spark.createDataFrame(rows, "id string, t string")
    return neardup.similar(df.withColumn("words", neardup.words(F.col("t"))), threshold)


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_pairs_equal_all_pairs(spark, threshold):
    rows = texts(1)
    classes, links = run(spark, rows, threshold)
    found = {(r["id_a"], r["id_b"]) for r in neardup.expand(classes, links).collect()}
    assert found == brute(rows, threshold)


def test_copies_nulls_empty_and_clashing_columns(spark):
    t = "one two three four five six seven"
    rows = [("a", t, "k", "r", 1), ("b", t.upper(), "k", "r", 1), ("c", "seven six five four three two one.", None, None, None), ("a", t, "k", "r", 1), ("d", None, "k", "r", 1), ("e", "", "k", "r", 1), (None, t, "k", "r", 1), ("f", "...!", "k", "r", 1), ("g", t + " eight", "k", "r", 1), ("h", "unlike any of it", "k", "r", 1)]
    classes, links = run(spark, rows)
    assert {(r["id"], r["rep"]) for r in classes.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("g", "g"), ("h", "h")}
    assert [(r["rep_a"], r["rep_b"], round(r["similarity"], 3)) for r in links.collect()] == [("a", "g", 0.875)]
    assert {(r["id_a"], r["id_b"]) for r in neardup.expand(classes, links).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "g"), ("b", "g"), ("c", "g")}
    grouped = {r["id"]: (r["group"], r["links"]) for r in neardup.grouped(classes, links).collect()}
    assert grouped == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "g": ("a", 1), "h": ("h", 0)}


def test_very_long_text(spark):
    long = " ".join(f"x{n}" for n in range(50_000))
    classes, links = run(spark, [("a", long), ("b", long + " more words here")])
    assert links.count() == 1


def test_empty_table(spark):
    classes, links = run(spark, [])
    assert classes.count() == 0 and links.count() == 0 and neardup.expand(classes, links).count() == 0
    assert neardup.grouped(classes, links).count() == 0


def test_groups_along_chains(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20) if i != 9] + [("x", "y")], "rep_a string, rep_b string")
    found = {r["id"]: r["group"] for r in neardup.components(chain).collect()}
    assert found == {f"n{i:02}": "n00" if i < 10 else "n10" for i in range(21)} | {"x": "x", "y": "x"}


def test_pruning_bounds_grow_with_evidence():
    one, two = neardup.most_differing(0.6)
    assert 64 * 0.2 < one < 32 and one < two < 64
    assert neardup.most_differing(0.9)[0] < one


def test_a_hot_bucket_loses_no_pair(spark):
    """Buckets cut into blocks, and rows that stretch over Arrow batches, give what small buckets give."""
    rng = random.Random(9)
    base = [f"t{n}" for n in range(40)]
    rows = [(f"id{n:04}", " ".join(base[:38] + [f"u{rng.randint(0, 30)}", f"v{rng.randint(0, 30)}"])) for n in range(400)] + texts(2, families=20)
    df = spark.createDataFrame(rows, "id string, t string").withColumn("words", neardup.words(F.col("t")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        cut_up = {(r["rep_a"], r["rep_b"]) for r in neardup.similar(df, hot=50)[1].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    classes, links = neardup.similar(df)
    assert cut_up == {(r["rep_a"], r["rep_b"]) for r in links.collect()}
    assert {(r["id_a"], r["id_b"]) for r in neardup.expand(classes, links).collect()} == brute(rows, 0.6)
