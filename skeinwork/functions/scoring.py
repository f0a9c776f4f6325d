"""Vector similarity, recall scores, size estimates and limits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How recall weighs similarity, seed, confidence and support.
DIRECT_BASE, DIRECT_SIMILARITY, DIRECT_CONFIDENCE = 1.0, 0.8, 0.2
GRAPH_WEIGHT, GRAPH_SIMILARITY, GRAPH_SEED, GRAPH_CONFIDENCE = 0.8, 0.5, 0.3, 0.2
BOOST_STEP, BOOST_MOST = 0.02, 0.1
# What a context is laid out for.
OUTPUT_TOKENS, RESERVED_TOKENS, START, TAIL, SUMMARY, HARD, CHARS_PER_TOKEN, MEDIA_TOKENS = 32_000, 20_000, 0.75, 0.25, 0.05, 0.9, 4, 8_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null, has no length, or the dimensions differ."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def unit_interval(x: Column) -> Column:
    """Clamped to [0, 1]; null counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))


def support_boost(sessions: Column) -> Column:
    """What further sessions add; unknown support is one session."""
    return F.least(F.lit(BOOST_MOST), F.lit(BOOST_STEP) * F.greatest(F.lit(0), F.coalesce(sessions, F.lit(1)) - 1))


def recall_score(direct: Column, similarity: Column, seed: Column, confidence: Column, sessions: Column) -> Column:
    s, c, b = unit_interval(similarity), unit_interval(confidence), support_boost(sessions)
    near = F.lit(DIRECT_BASE) + DIRECT_SIMILARITY * s + DIRECT_CONFIDENCE * c + b
    far = GRAPH_WEIGHT * (GRAPH_SIMILARITY * s + GRAPH_SEED * unit_interval(seed) + GRAPH_CONFIDENCE * c) + b
    return F.when(direct, near).otherwise(far)


def estimated_tokens(text: Column) -> Column:
    """A fourth of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / CHARS_PER_TOKEN)


def context_limits(context: Column, given_input: Column, given_output: Column) -> Column:
    """struct(usable, hard, threshold, target, summary_chars) of a model's context, input and output limits in tokens."""
    output = F.when(F.coalesce(given_output, F.lit(0)) > 0, given_output).otherwise(F.lit(OUTPUT_TOKENS))
    usable = F.when(given_input.isNotNull(), given_input - F.least(F.lit(RESERVED_TOKENS), output)).otherwise(context - output)
    share = lambda part: F.floor(context * part)
    hard = F.greatest(F.lit(0), F.least(share(HARD), F.least(F.coalesce(given_input, context), context - output)))
    threshold = F.greatest(F.lit(0), F.least(share(START), usable, hard))
    return F.struct(usable.cast("long").alias("usable"), hard.cast("long").alias("hard"), threshold.cast("long").alias("threshold"), share(TAIL).cast("long").alias("target"), F.floor(context * SUMMARY * CHARS_PER_TOKEN).cast("long").alias("summary_chars"))


def retry_at(at: Column, attempt: Column, seconds: float = 2.0, exponential: bool = False) -> Column:
    """When a failed attempt may run again."""
    wait = F.lit(seconds) * F.pow(F.lit(2.0), attempt - 1) if exponential else F.lit(seconds)
    return F.timestamp_micros((F.unix_micros(at.cast("timestamp")) + wait * 1_000_000).cast("long"))
