from skeinwork.plans import tables


def test_stale_is_what_ends_in_a_delete(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    said = [("user", "x"), ("assistant", "y")]
    save("segment_requests", [(s, said) for s in ("again", "gone", "late", "spelt", "void", "none")], "segment_id string, messages array<struct<role: string, text: string>>")
    save("claims", [("again",), ("gone",)], "segment_id string")
    changes = [
        ("again", "d", 1, 0), ("again", "i", 2, 0), ("gone", "i", 1, 0), ("gone", "d", 2, 0), ("late", "delete", 3, 1), ("late", "u", 3, 0),
        ("spelt", "i", 1, 0), ("spelt", " Removed ", 1, 1), ("void", "u", 1, 0), ("void", "d", None, 0),
    ]
    save("job_changes", [(n, op, s, g, f"f{n}", a) for n, (s, op, g, a) in enumerate(changes)], "change_no long, op string, segment_id string, source_generation long, source_fingerprint string, attempts int")
    found = {r["status"]: (r["segments"], r["messages"]) for r in tables.segment_status_counts(spark, str(tmp_path)).collect()}
    assert found == {"stale": (3, 6), "known": (1, 2), "new": (2, 4)}
