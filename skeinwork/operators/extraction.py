"""From requests to claims and entities that can be committed: models are pluggable, the dataflow around them is not.

A model is any function from a list of texts to a list of results; it runs inside Arrow batches on the executors. The
defaults need no network and are deterministic; what they find is not comparable with a language model's findings.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import TypedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import ids, text
from skeinwork.operators import tables
from skeinwork.session import small
from skeinwork.sources.snapshots import Snapshots


class Claim(TypedDict):
    subject: str
    predicate: str
    confidence: float
    object_entity: str | None
    object_value: str | None


Extractor = Callable[[list[str]], list[list[Claim]]]
Embedder = Callable[[list[str]], np.ndarray]
#: Bytes of one text to embed, at most.
INPUT_BYTES = 30_000

#: Items and bytes of one call of an embedder, at most.
BATCH_ITEMS, BATCH_BYTES = 128, 100_000

_CLAUSE = re.compile(r"\b(?:[Tt]he|[Oo]ur|[Tt]his|[Tt]hat|[Ee]very|[Aa]n?) ((?:[a-z][a-z-]+ ){1,3}?)([a-z]{2,}(?:s|ed)) ((?:[^\s.,;!?]+ ?){1,14})(?=[.,;!?\n]|$)")


def clauses(texts: list[str]) -> list[list[Claim]]:
    """Default extractor: "<article> <one to three words> <word in -s or -ed> <rest of the clause>", by shape alone."""
    return [[{"subject": s.strip(), "predicate": p, "confidence": 0.5, "object_entity": None, "object_value": o.strip()} for s, p, o in _CLAUSE.findall(t)] for t in texts]


def hashed_grams(texts: list[str], dim: int = 64) -> np.ndarray:
    """Default embedder: signed hashed character trigrams, unit length."""
    out = np.zeros((len(texts), dim), np.float32)
    for row, t in zip(out, texts, strict=True):
        t = f"  {t.lower()} "
        for i in range(len(t) - 2):
            h = zlib.crc32(t[i : i + 3].encode())
            row[h % dim] += 1 if h & 0x8000_0000 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def batches_of(texts: list[str], items: int = BATCH_ITEMS, most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Texts in order in lists that one call of an embedder may hold."""
    held: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode())
        if n > INPUT_BYTES:
            raise ValueError(f"a text to embed has more than {INPUT_BYTES} bytes")
        if held and (len(held) == items or size + n > most):
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def embedded(df: DataFrame, column: str, embedder: Embedder = hashed_grams, name: str = "embedding") -> DataFrame:
    """df with a vector of each text; null texts get none, texts over the input limit are an error."""
    at = df.columns.index(column)
    schema = df.schema.simpleString()[len("struct<") : -1] + f",{name}:array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            vectors = iter([v for part in batches_of([v for v in values if v is not None]) for v in embedder(part).tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if v is None else next(vectors) for v in values], pa.list_(pa.float32()))], [*batch.schema.names, name])

    return df.mapInArrow(run, "struct<" + schema + ">")


def proposed(requests: DataFrame, extractor: Extractor = clauses) -> DataFrame:
    """(segment_id, index, claim columns): all that the extractor proposes for each segment, in order."""
    joined = requests.where("segment_id is not null").select("segment_id", F.coalesce(F.array_join("messages.text", "\n", ""), F.lit("")).alias("t")).groupBy("segment_id").agg(F.max("t").alias("t"))
    schema = "segment_id string, index int, subject string, predicate string, confidence double, object_entity string, object_value string"
    arrow = pa.schema([("segment_id", pa.string()), ("index", pa.int32()), ("subject", pa.string()), ("predicate", pa.string()), ("confidence", pa.float64()), ("object_entity", pa.string()), ("object_value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = extractor(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pylist([{"segment_id": s, "index": i, **c} for s, cs in zip(batch.column(0).to_pylist(), found, strict=True) for i, c in enumerate(cs)], arrow)

    return joined.mapInArrow(run, schema)


def mentions(claims: DataFrame) -> DataFrame:
    """(segment_id, index, mention_id, role, text, supporting_claim, embed_text) of each claim's subject, and its object if that is an entity.

    mention_id is `c<index>.subject` or `c<index>.object`; embed_text is the name with the claim it stands in.
    """
    shown = F.concat_ws(" | ", "subject", "predicate", F.coalesce("object_entity", "object_value"))
    ends = F.array_compact(F.array(F.struct(F.lit("subject").alias("role"), F.col("subject").alias("text")), F.when(F.col("object_entity").isNotNull(), F.struct(F.lit("object").alias("role"), F.col("object_entity").alias("text")))))
    rows = claims.select("segment_id", "index", shown.alias("supporting_claim"), F.explode(ends).alias("e"))
    return rows.select("segment_id", "index", F.concat(F.lit("c"), "index", F.lit("."), "e.role").alias("mention_id"), "e.role", "e.text", "supporting_claim", F.concat("e.text", F.lit("\n"), "supporting_claim").alias("embed_text"))


def decided(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """The claims (segment_id, index, ...) that decisions (segment_id, index, action) say to keep, under the number they were proposed with."""
    kept = decisions.where("action = 'keep'").select("segment_id", "index").distinct()
    return claims.join(kept, ["segment_id", "index"], "left_semi")


def by_mention(claims: DataFrame, resolutions: DataFrame) -> DataFrame:
    """claims with subject_entity_id and object_entity_id as resolved for their mentions: resolutions (segment_id, mention_id, entity_id)."""
    one = resolutions.groupBy("segment_id", "mention_id").agg(F.min("entity_id").alias("entity_id"))
    for role in ("subject", "object"):
        side = one.where(F.col("mention_id").endswith(f".{role}")).select("segment_id", F.regexp_extract("mention_id", r"^c(\d+)\.", 1).cast("int").alias("index"), F.col("entity_id").alias(f"{role}_entity_id"))
        claims = claims.join(side, ["segment_id", "index"], "left")
    return claims


def merged_entities(made: DataFrame) -> DataFrame:
    """(id, canonical_name, description, aliases): new entities (id, seq, canonical_name, description, aliases), each once.

    The first by seq gives name and description; aliases of all are joined, of one normal form the first spelling, and none
    that is the name itself.
    """
    first = made.groupBy("id").agg(F.min(F.struct("seq", "canonical_name", "description")).alias("f")).select("id", "f.canonical_name", "f.description")
    each = made.select("id", "seq", F.posexplode("aliases").alias("n", "alias")).where("alias is not null").withColumn("order", F.struct("seq", "n"))
    once = tables.first_spelling(each, "id", "alias", text.normalize_name(F.col("alias")), ["order", "alias"]).join(first.select("id", text.normalize_name(F.col("canonical_name")).alias("own")), "id").where("normal <> own")
    lists = once.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("normal", "alias"))).alias("l")).select("id", F.col("l.alias").alias("aliases"))
    return first.join(lists, "id", "left").select("id", "canonical_name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def prepared(claims: DataFrame, known: DataFrame, embedder: Embedder = hashed_grams) -> tuple[DataFrame, DataFrame]:
    """(claims, entities) ready for a commit.

    known: (id, name) of established entities. A mention whose normal form is a known name, of one entity alone, is that
    entity; any other becomes a new entity of its segment. Claims keep the number they were proposed under.
    """
    fine = claims.where(text.natural_predicate(F.col("predicate")) & (F.col("object_entity").isNull() != F.col("object_value").isNull()) & F.col("confidence").between(0, 1))
    names = known.select("id", text.normalize_name(F.col("name")).alias("norm")).groupBy("norm").agg(F.min("id").alias("known_id"), F.max("id").alias("other_id")).where("known_id = other_id").drop("other_id")

    def resolved(df: DataFrame, column: str, name: str) -> DataFrame:
        norm = text.normalize_name(F.col(column))
        met = df.withColumn("norm", norm).join(small(names), "norm", "left")
        made = F.when(F.col(column).isNotNull(), F.coalesce("known_id", ids.entity_id(F.col("segment_id"), F.col("norm"))))
        return met.withColumn(name, made).withColumn(name + "_new", F.col(column).isNotNull() & F.col("known_id").isNull()).drop("norm", "known_id")

    both = resolved(resolved(fine, "subject", "subject_entity_id"), "object_entity", "object_entity_id")
    key = ids.equivalence_key(F.col("subject_entity_id"), text.normalize_name(F.col("predicate")), F.col("object_entity_id"), text.normalize_name(F.col("object_value")))
    shown = F.concat_ws(" | ", "subject", "predicate", F.coalesce("object_entity", "object_value"))
    done = both.select(ids.claim_id(F.col("segment_id"), F.col("index")).alias("id"), "segment_id", "subject", "subject_entity_id", "predicate", "confidence", "object_entity", "object_entity_id", "object_value", key.alias("equivalence_key"), shown.alias("shown"))
    made = both.select("segment_id", F.explode(F.array(F.struct(F.col("subject").alias("name"), F.col("subject_entity_id").alias("id"), F.col("subject_entity_id_new").alias("new")), F.struct(F.col("object_entity").alias("name"), F.col("object_entity_id").alias("id"), F.col("object_entity_id_new").alias("new")))).alias("e")).where("e.new")
    first = made.select("e.id", "e.name").groupBy("id").agg(F.min("name").alias("canonical_name"))
    entities = first.select("id", "canonical_name", text.normalize_name(F.col("canonical_name")).alias("normalized_name"), F.concat(F.lit("Entity named "), "canonical_name").alias("description"))
    return embedded(done, "shown", embedder).drop("shown"), embedded(entities, "canonical_name", embedder)


def commit(store: Snapshots, segments: DataFrame, claims: DataFrame, entities: DataFrame, base: int | None = None, mark: tuple[str, str] | None = None) -> int:
    """Puts segments with all their claims and entities in place of what was stored of them, as one new version.

    Claims of a segment are replaced, segments and entities updated by id, and entities that only replaced claims named are
    removed. Returns the version; a Conflict leaves the old version current.
    """
    old_segments, old_claims, old_entities = (store.read(t) for t in ("segments", "claims", "entities"))
    if old_segments is None:
        return store.commit({"segments": segments, "claims": claims, "entities": entities}, base, mark)
    kept_claims = tables.delete(old_claims, segments, ["segment_id"]).unionByName(claims.select(*old_claims.columns))
    replaced = old_claims.join(small(segments.select("segment_id").distinct()), "segment_id", "left_semi")
    touched = replaced.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id")).where("id is not null").distinct()
    every = tables.upsert(old_entities, entities, ["id"])
    lost = tables.orphans(every, kept_claims, touched)
    return store.commit({"segments": tables.upsert(old_segments, segments, ["segment_id"]), "claims": kept_claims, "entities": tables.delete(every, lost, ["id"])}, base, mark)


def upgraded(claims: DataFrame, columns: dict[str, object]) -> DataFrame:
    """A table of an older form with the columns it lacks, each by its rule; columns it has stay as they are, so it may run twice."""
    for name, rule in columns.items():
        if name not in claims.columns:
            claims = claims.withColumn(name, rule)
    return claims


def prior_texts(summaries: DataFrame, most: int | None = None) -> DataFrame:
    """(segment_id, prior): for each segment (session_id, segment_id, at, summary) all summaries of its session before it, or the last `most` of them, oldest first."""
    before = Window.partitionBy("session_id").orderBy("at", "segment_id").rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return summaries.select("segment_id", F.collect_list("summary").over(before).alias("prior"))
