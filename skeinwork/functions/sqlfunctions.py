"""The identifiers, fingerprints and similarities as functions that SQL text can call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skeinwork.functions import ids

_FRAME = "concat(octet_length({0}), ':', {0})"
_GRAMS = r"array_distinct(flatten(transform(filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0.0D, (s, x) -> s + x)"


def definitions(tag: str = ids.SOURCE_TAG) -> dict[str, str]:
    """Name: parameters, result type and body of each function."""
    m = _FRAME.format("m.role"), _FRAME.format("m.text")
    frames = f"transform(messages, m -> concat({m[0]}, {m[1]}))"
    head = ", ".join(_FRAME.format(c) for c in ("session_id", "start_id", "end_id"))
    a, b = _GRAMS.format("a"), _GRAMS.format("b")
    common = f"size(array_intersect({a}, {b}))"
    return {
        "projection_fingerprint": "(segment STRING, end_id STRING, summary STRING, version INT) RETURNS STRING RETURN sha2(concat(segment, ':', length(end_id), ':', end_id, ':', length(summary), ':', summary, ':', version), 256)",
        "source_fingerprint": "(session_id STRING, start_id STRING, end_id STRING, messages ARRAY<STRUCT<role: STRING, text: STRING>>) RETURNS STRING RETURN "
        f"CASE WHEN NOT exists({frames}, f -> f IS NULL) THEN sha2(concat('{tag}', {head}, size(messages), ':', array_join({frames}, '')), 256) END",
        "name_similarity": f"(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce({common} / nullif(size({a}) + size({b}) - {common}, 0), 0.0D)",
        "cosine_distance": f"(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN CASE WHEN size(a) = size(b) THEN 1.0D - {_DOT.format('a', 'b')} / nullif(sqrt({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')}), 0.0D) END",
    }


def register(spark: SparkSession, tag: str = ids.SOURCE_TAG) -> list[str]:
    """Creates the functions for the session, in place of any of the same names; returns the names."""
    made = definitions(tag)
    for name, rest in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(made)
