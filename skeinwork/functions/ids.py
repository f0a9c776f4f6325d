"""Deterministic identifiers and fingerprints, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The name spaces of the identifiers.
SEGMENT_NAMESPACE = "b14d5f2c-4cce-4f37-9e32-ea30c1fd1b42"
ENTITY_NAMESPACE = "966769b5-ab08-4b02-8948-7db052586124"
CLAIM_NAMESPACE = "194eb982-5e16-4011-bdcb-f13a86934da4"
#: Put before what a source fingerprint covers; pass the tag of a running installation to get its digests.
SOURCE_TAG = "source-v1:"


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID text of a name in a name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(h.substr(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.char(F.lit(0)), b)


def segment_id(session_id: Column, start_user_message_id: Column) -> Column:
    return uuid5(SEGMENT_NAMESPACE, _pair(session_id, start_user_message_id))


def entity_id(segment: Column, normalized_name: Column) -> Column:
    return uuid5(ENTITY_NAMESPACE, _pair(segment, normalized_name))


def claim_id(segment: Column, index: Column) -> Column:
    """index counts all proposed claims, dropped ones included."""
    return uuid5(CLAIM_NAMESPACE, _pair(segment, index.cast("string")))


def framed(text: Column) -> Column:
    """A text after its length in bytes."""
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def source_fingerprint(session_id: Column, start: Column, end: Column, messages: Column, tag: str = SOURCE_TAG) -> Column:
    """SHA-256 of a segment's source; null if any part of it is null."""
    frames = F.transform(messages, lambda m: F.concat(framed(m["role"]), framed(m["text"])))
    whole = ~F.exists(frames, lambda f: f.isNull())
    return F.when(whole, F.sha2(F.concat(F.lit(tag), framed(session_id), framed(start), framed(end), F.size(messages).cast("string"), F.lit(":"), F.array_join(frames, "")), 256))


def projection_fingerprint(segment: Column, end: Column, summary: Column, version: Column) -> Column:
    """SHA-256 of a committed summary; lengths in code points."""
    colon = F.lit(":")
    return F.sha2(F.concat(segment, colon, F.length(end).cast("string"), colon, end, colon, F.length(summary).cast("string"), colon, summary, colon, version.cast("string")), 256)


def equivalence_key(subject_id: Column, predicate: Column, object_entity_id: Column, object_value: Column) -> Column:
    """SHA-256 of normalised subject, predicate and object; null unless exactly one kind of object is there.

    predicate and object_value must be normalised (`text.normalize_name`).
    """
    one = object_entity_id.isNull() != object_value.isNull()
    other = F.when(object_value.isNull(), F.concat(F.lit("entity:"), object_entity_id)).otherwise(F.concat(F.lit("literal:"), object_value))
    return F.when(one, F.sha2(F.concat(subject_id, F.char(F.lit(0)), predicate, F.char(F.lit(0)), other), 256))
