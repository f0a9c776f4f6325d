"""Recall: the claims nearest to query vectors, what touches the same entities, and both grouped by meaning and scored.

Queries are a stated set; they are taken in blocks of bounded size, each block one broadcast and one pass over the claims. A
claim meets all queries of the block in one matrix product inside an Arrow batch; a task keeps the k best per query over all
its batches. Neighbours are found in the same way: a claim meets just those queries that have one of its entities as a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.scoring import recall_score
from skeinwork.session import cut, small

#: Queries of one pass: of nearest claims, and of neighbours (each has up to two seeds per direct claim).
BLOCK, SEEDED = 32_768, 4_096


def usable(items: DataFrame, dim: int, id_col: str, vector_col: str, keep: list[str]) -> DataFrame:
    """(id, vector, kept columns) of the rows with an id and a vector of `dim` finite values and some length, one per id: of
    rows that differ the greatest."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e18)) & F.exists(v, lambda x: x != 0)
    rows = items.where(fine).select(F.col(id_col).alias("id"), F.struct(v.cast("array<float>").alias("vector"), *keep).alias("s"))
    return rows.groupBy("id").agg(F.max("s").alias("s")).select("id", "s.vector", *(F.col(f"s.{c}").alias(c) for c in keep))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def blocks(queries: DataFrame, dim: int, block: int) -> Iterator[tuple[list, np.ndarray]]:
    """The queries (query, vector) in blocks: names and unit vectors. Reads a block at a time."""
    rows = queries.select("query", "vector").sort("query").toLocalIterator(prefetchPartitions=False)
    names, vectors = [], []
    for r in rows:
        names.append(r["query"])
        vectors.append(r["vector"])
        if len(names) == block:
            yield names, _unit(np.array(vectors, float))
            names, vectors = [], []
    if names:
        yield names, _unit(np.array(vectors, float))


class Best:
    """The k highest similarities of each of `n` numbered places seen so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.place, self.similarity, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, "S1")
        #: What a place's similarity must reach to be among its k highest.
        self.least = np.full(n, -np.inf)

    def offer(self, place: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        if not len(place):
            return
        place, similarity, ids = np.concatenate([self.place, place]), np.concatenate([self.similarity, similarity]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -similarity, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        keep = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.least[place[rank == self.k - 1]] = similarity[last]
        self.place, self.similarity, self.id = place[rank < self.k], similarity[keep], ids[keep]

    def scores(self, first: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Offers a matrix of similarities, a row for each place from `first` on."""
        bound = self.least[first : first + len(s)]
        if s.shape[1] > self.k:
            bound = np.maximum(bound, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        row, col = np.nonzero(s >= bound[:, None])
        self.offer(row + first, s[row, col], ids[col])


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as bytes, whose order is that of the texts."""
    return np.array([i.encode() for i in column.to_pylist()])


def nearest(queries: DataFrame, items: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, id, similarity, place): for each query (query, vector) the k items (id, vector) of highest cosine similarity.

    One pass over the items for every BLOCK queries. A task keeps the k best of each query over all its rows and yields them
    at its end, so no more than partitions x queries x k rows are shuffled.
    """
    name_type = queries.schema["query"].dataType.simpleString()
    sc = queries.sparkSession.sparkContext
    parts = []
    for names, q in blocks(queries, dim, BLOCK):
        held = sc.broadcast((names, q))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best = Best(len(names), k)
            for batch in batches:
                if batch.num_rows:
                    ids, x = _ids(batch.column(0)), _unit(_matrix(batch.column(1), dim)).T
                    for lo in range(0, len(q), 256):
                        best.scores(lo, q[lo : lo + 256] @ x, ids)
            if len(best.place):
                yield pa.RecordBatch.from_arrays([pa.array([names[n] for n in best.place.tolist()]), pa.array([i.decode() for i in best.id.tolist()]), pa.array(best.similarity)], ["query", "id", "similarity"])

        parts.append(items.select("id", "vector").mapInArrow(scan, f"query {name_type}, id string, similarity double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query {name_type}, id string, similarity double, place int")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= k)


def seeds(direct: DataFrame) -> DataFrame:
    """(query, entity, seed): the entities of the direct claims with their best similarity, at least 0."""
    ends = direct.select("query", "similarity", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity")).where("entity is not null")
    return ends.groupBy("query", "entity").agg(F.greatest(F.lit(0.0), F.max("similarity")).alias("seed"))


def neighbours(queries: DataFrame, seeded: DataFrame, items: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, entity, id, similarity, seed): for each seed the k claims touching its entity that are nearest to the query.

    items: (id, vector, subject_entity_id, object_entity_id). Direct claims may come again. One pass over the items for every
    SEEDED queries; their seeds are few (two per direct claim) and travel with them. A task keeps the k best of each seed, so
    the hot entity of a tenth of all claims yields k rows per seed and task.
    """
    name_type = queries.schema["query"].dataType.simpleString()
    sc = queries.sparkSession.sparkContext
    seeded = cut(seeded)
    parts = []
    for names, q in blocks(queries, dim, SEEDED):
        place = {n: i for i, n in enumerate(names)}
        wanted = seeded.where(F.col("query").between(names[0], names[-1])).toArrow()
        rows = list(zip(*(wanted.column(c).to_pylist() for c in ("query", "entity", "seed")), strict=True))
        of: dict[str, list[int]] = {}
        for n, (_, e, _) in enumerate(rows):
            of.setdefault(e, []).append(n)
        held = sc.broadcast((q, rows, np.array([place[n] for n, _, _ in rows], np.int64), {e: np.array(at) for e, at in of.items()}))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, rows, query, of = held.value
            best = Best(len(rows), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                touching: dict[str, list[int]] = {}
                for i, ends in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    for e in {*ends} & of.keys():
                        touching.setdefault(e, []).append(i)
                if not touching:
                    continue
                ids, x = _ids(batch.column(0)), _unit(_matrix(batch.column(1), dim))
                places, similarities, found = [], [], []
                for e, at in touching.items():
                    seeds_of, part = of[e], x[at].T
                    for lo in range(0, len(seeds_of), 256):
                        these = seeds_of[lo : lo + 256]
                        s = q[query[these]] @ part
                        bound = best.least[these]
                        if s.shape[1] > k:
                            bound = np.maximum(bound, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        row, col = np.nonzero(s >= bound[:, None])
                        places.append(these[row])
                        similarities.append(s[row, col])
                        found.append(ids[np.array(at)[col]])
                best.offer(np.concatenate(places), np.concatenate(similarities), np.concatenate(found))
            if len(best.place):
                of_row = [rows[n] for n in best.place.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in of_row]), pa.array([r[1] for r in of_row]), pa.array([i.decode() for i in best.id.tolist()]), pa.array(best.similarity), pa.array([r[2] for r in of_row])], ["query", "entity", "id", "similarity", "seed"])

        parts.append(items.select("id", "vector", "subject_entity_id", "object_entity_id").mapInArrow(scan, f"query {name_type}, entity string, id string, similarity double, seed double"))
    if not parts:
        return queries.sparkSession.createDataFrame([], f"query {name_type}, entity string, id string, similarity double, seed double")
    place = F.row_number().over(Window.partitionBy("query", "entity").orderBy(F.desc("similarity"), "id"))
    return reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= k).drop("place")


def support_counts(claims: DataFrame, segments: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(equivalence_key, support_count, session_count) over all claims of known segments.

    Pairs of key and segment, and of key and session, are made distinct and then counted: each step is combined before its
    shuffle, so nothing is expanded or gathered.
    """
    rows = claims.select("equivalence_key", "segment_id").where("equivalence_key is not null")
    if keys is not None:
        rows = rows.join(small(keys), "equivalence_key", "left_semi")
    pairs = rows.distinct().join(segments.select("segment_id", "session_id").distinct(), "segment_id")
    # a segment known under two sessions counts once; a null session is none
    counted = pairs.select("equivalence_key", "segment_id").distinct().groupBy("equivalence_key").agg(F.count("*").alias("support_count"))
    sessions = pairs.where("session_id is not null").select("equivalence_key", "session_id").distinct().groupBy("equivalence_key").agg(F.count("*").alias("session_count"))
    return counted.join(sessions, "equivalence_key", "left").select("equivalence_key", "support_count", F.coalesce("session_count", F.lit(0).cast("long")).alias("session_count"))


def supporting(claims: DataFrame, segments: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(equivalence_key, segment_id): the segments that support each key, a row each, however many a hot key has."""
    rows = claims.select("equivalence_key", "segment_id").where("equivalence_key is not null")
    if keys is not None:
        rows = rows.join(small(keys), "equivalence_key", "left_semi")
    return rows.distinct().join(segments.select("segment_id").distinct(), "segment_id", "left_semi").select("equivalence_key", "segment_id")


def support(claims: DataFrame, segments: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(equivalence_key, segment_ids, support_count, session_count): counts, and the segments of each key as one sorted list.

    For the keys a caller asks for; over all claims use `support_counts` and `supporting`, which gather nothing.
    """
    lists = supporting(claims, segments, keys).groupBy("equivalence_key").agg(F.array_sort(F.collect_list("segment_id")).alias("segment_ids"))
    return support_counts(claims, segments, keys).join(lists, "equivalence_key").select("equivalence_key", "segment_ids", "support_count", "session_count")


def recall(queries: DataFrame, claims: DataFrame, segments: DataFrame, dim: int, direct_k: int = 10, neighbour_k: int = 10, limit: int = 20) -> DataFrame:
    """(query, place, id, equivalence_key, is_direct, similarity, score, support_count, session_count, segment_ids).

    claims: one row per id with vector, subject_entity_id, object_entity_id, confidence, equivalence_key, segment_id. Of the
    candidates of one equivalence key the best scored counts; equal scores go to direct claims, then to the smaller id.
    """
    direct = cut(nearest(queries, claims, dim, direct_k))  # a few rows per query, used three times
    ends = claims.select("id", "subject_entity_id", "object_entity_id")
    around = neighbours(queries, seeds(direct.join(ends, "id")), claims, dim, neighbour_k)
    offered = direct.select("query", "id", "similarity", F.lit(None).cast("double").alias("seed"), F.lit(True).alias("is_direct")).unionByName(around.select("query", "id", "similarity", "seed", F.lit(False).alias("is_direct")))
    rows = cut(offered.join(claims.select("id", "confidence", "equivalence_key", "segment_id"), "id"))
    counted = support(claims, segments, rows.select("equivalence_key").distinct())  # as many keys as there are candidates
    scored = rows.join(counted, "equivalence_key", "left").withColumn("score", F.round(recall_score(F.col("is_direct"), F.col("similarity"), F.col("seed"), F.col("confidence"), F.col("session_count")), 9))
    order = [F.desc("score"), F.desc("is_direct"), F.asc("id")]
    one = scored.withColumn("rn", F.row_number().over(Window.partitionBy("query", "equivalence_key").orderBy(*order))).where("rn = 1")
    placed = one.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= limit)
    return placed.select(
        "query", "place", "id", "equivalence_key", "is_direct", "similarity", "score",
        F.coalesce("support_count", F.lit(1).cast("long")).alias("support_count"), F.coalesce("session_count", F.lit(1).cast("long")).alias("session_count"),
        F.coalesce("segment_ids", F.array("segment_id")).alias("segment_ids"),
    )
