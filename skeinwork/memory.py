"""The library as one object over a store of snapshots: put segments in, search claims, read segments and sessions back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import ids
from skeinwork.operators import candidates, conversation, extraction, recall
from skeinwork.session import small
from skeinwork.sources.readers import lookup
from skeinwork.sources.snapshots import Snapshots


class Memory:
    """Tables of the store: segments (segment_id, session_id, start_id, end_id, summary, created_at, fingerprint), claims, entities, messages."""

    def __init__(self, store: Snapshots, embedder: extraction.Embedder = extraction.hashed_grams, dim: int = 64):
        self.store, self.embedder, self.dim = store, embedder, dim

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError(f"the store holds no {name}")
        return df

    def submit(self, requests: DataFrame, known: DataFrame, extractor: extraction.Extractor = extraction.clauses) -> int:
        """Extracts, resolves and commits requests (session_id, start_user_message_id, end_user_message_id, messages, summary, created_at); returns the version.

        Each segment gets its identifier and the fingerprint of its source; one that is stored is replaced with all its claims.
        """
        named = requests.withColumn("segment_id", ids.segment_id(F.col("session_id"), F.col("start_user_message_id")))
        mark = ids.source_fingerprint(F.col("session_id"), F.col("start_user_message_id"), F.col("end_user_message_id"), F.col("messages"))
        state = F.struct("created_at", "session_id", F.col("start_user_message_id").alias("start_id"), F.col("end_user_message_id").alias("end_id"), "summary", mark.alias("fingerprint"))
        segments = named.groupBy("segment_id").agg(F.max(state).alias("s")).select("segment_id", "s.session_id", "s.start_id", "s.end_id", "s.summary", "s.created_at", "s.fingerprint")
        claims, entities = extraction.prepared(extraction.proposed(named, extractor), known, self.embedder)
        return extraction.commit(self.store, segments, claims, entities, self.store.version)

    def search(self, queries: DataFrame, direct_k: int = 10, neighbour_k: int = 10, limit: int = 20) -> DataFrame:
        """The claims that answer texts (query, text), grouped by meaning and scored: see `recall.recall`; with the claim itself."""
        asked = extraction.embedded(queries.select("query", "text"), "text", self.embedder, "vector").where("text is not null")
        claims = recall.usable(self._table("claims"), self.dim, "id", "embedding", ["subject_entity_id", "object_entity_id", "confidence", "equivalence_key", "segment_id", "subject", "predicate", "object_entity", "object_value"])
        found = recall.recall(asked, claims, self._table("segments"), self.dim, direct_k, neighbour_k, limit)
        told = claims.select("id", "subject", "predicate", "object_entity", "object_value", "confidence")
        return found.join(told, "id").select(*found.columns, *told.columns[1:])

    def search_vector(self, vector: list[float], **limits: int) -> DataFrame:
        """The same for one vector."""
        spark = self.store.spark
        claims = recall.usable(self._table("claims"), self.dim, "id", "embedding", ["subject_entity_id", "object_entity_id", "confidence", "equivalence_key", "segment_id"])
        return recall.recall(spark.createDataFrame([(0, np.asarray(vector, float).tolist())], "query long, vector array<float>"), claims, self._table("segments"), self.dim, **limits)

    def read_segment(self, session_id: str, start_id: str, end_id: str) -> DataFrame:
        """The messages from one turn to another, in order, of the session's table `messages`; one row with a problem if there are no such turns."""
        rows = lookup(self._table("messages"), "session_id", [session_id])
        bounds = self.store.spark.createDataFrame([(session_id, start_id, end_id)], "session_id string, start_id string, end_id string")
        return conversation.read_back(rows, bounds)

    def segment(self, segment_ids: list[str]) -> DataFrame:
        """The stored segments of these ids, each with the list of its claims in order of id, as many as it has; unknown ids have no row."""
        return viewed(lookup(self._table("segments"), "segment_id", segment_ids), lookup(self._table("claims"), "segment_id", segment_ids))

    def session(self, session_id: str) -> DataFrame:
        """The stored segments of a session in order, with their bounds and summaries."""
        return lookup(self._table("segments"), "session_id", [session_id]).orderBy("created_at", "segment_id")

    def candidates(self, mentions: DataFrame) -> DataFrame:
        """Up to ten entities for each mention (query, text): by name, then by vector, with names and aliases."""
        entities = self._table("entities")
        named = entities if "aliases" in entities.columns else entities.withColumn("aliases", F.array().cast("array<string>"))
        near = candidates.by_trigrams(mentions, candidates.entity_names(named))
        vectors = recall.nearest(extraction.embedded(mentions.where("text is not null").select("query", "text"), "text", self.embedder, "vector"), recall.usable(entities, self.dim, "id", "embedding", []), self.dim, candidates.EACH)
        return candidates.described(candidates.union(near, vectors), named)


def viewed(segments: DataFrame, claims: DataFrame) -> DataFrame:
    """segments with `claims`, the list of each one's (id, subject, predicate, object_entity, object_value, confidence) in order of id, empty if it has none."""
    item = F.struct("id", "subject", "predicate", "object_entity", "object_value", "confidence")
    lists = claims.groupBy("segment_id").agg(F.array_sort(F.collect_set(item)).alias("claims"))
    return segments.join(small(lists), "segment_id", "left").select(*segments.columns, F.coalesce("claims", F.array().cast(lists.schema["claims"].dataType)).alias("claims"))
