"""The k most similar vectors of every vector, by an adaptive dimension scan of inverted lists.

1. One row per id, brought to unit length and rotated by a fixed random orthogonal matrix, so that any block of columns is
   an unbiased sample of a vector's whole length.
2. Lists are fitted in two levels on a bounded sample: spherical k-means gives a centre for each list, then a few prototypes
   within it. A vector belongs to the list of its nearest prototype; as a query it probes the lists that hold one of its
   `probes` nearest prototypes, if within `margin` of the nearest. Prototypes are sought in the `TOP` lists of nearest centre.
   Lists are the unit of shuffling; a query travels to about two of them. Their number grows with the data (`LIST` vectors
   each), so the work for a vector stays the same up to LISTS x LIST vectors (24 million), and grows in proportion beyond.
3. Within a probed list, columns are read in blocks. After each block a hypothesis test asks whether the scaled-up partial
   distance can still end below the query's current k-th distance; candidates that fail are abandoned, survivors are computed
   exactly. The k-th distance is tightened as exact distances of better candidates come in.
4. The k best of the probed lists are merged per query.

A list that is too large for one task is cut by hash of the vector into blocks, and its queries into portions; every query
meets every block of the lists it probes. Copies of one vector share a block, where only the k + 1 smallest ids are kept:
no other copy can be among anyone's k nearest, because ties go to the smaller id. Nothing grows with the data on the driver:
the fit takes at most `SAMPLE` vectors, and prototypes go to the executors as one broadcast of at most `PROTOTYPES` vectors
(33 MB at 64 dimensions). Vectors travel as 16-bit fixed-point values scaled to their largest part (an error of less than
0.00001 in a cosine). An exact result has probes = PROTOTYPES, margin = 2, top = LISTS and epsilon = 1e9, at quadratic cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.keys import pack, unpack

#: Vectors the lists are fitted on: at least and at most; in between an eighth of all.
FEW, SAMPLE = 65_536, 262_144
#: Lists and prototypes, at most; with these a list has no fewer than eight prototypes.
LISTS, PROTOTYPES = 16_384, 131_072
#: Vectors aimed at in a list and at a prototype, vectors of a block, queries of a portion, lists a prototype is sought in.
LIST, PROTOTYPE, BLOCK, PORTION, TOP = 1_500, 9, 4_096, 32_768, 48
PROBES, MARGIN, EPSILON, COLUMNS = 12, 0.2, 2.1, 16
SCALE = 32_767


def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_240_801).standard_normal((dim, dim)))
    return np.ascontiguousarray(q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)


def centroids(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Spherical k-means; empty lists keep their place."""
    c = x[np.random.default_rng(7).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        at, start = np.unique(near[order], return_index=True)
        c[at] = _unit(np.add.reduceat(x[order], start, axis=0))
    return c


@dataclass
class Lists:
    """Centres of lists, and the prototypes of list c at start[c] to start[c + 1]; blocks and portions a list is cut into."""

    centres: np.ndarray
    start: np.ndarray
    prototypes: np.ndarray
    blocks: np.ndarray
    portions: np.ndarray


def fitted(x: np.ndarray, n: int) -> Lists:
    """Lists for n vectors from a sample of them."""
    lists = max(1, min(LISTS, n // LIST, len(x) // 16))
    wanted = max(lists, min(PROTOTYPES, n // PROTOTYPE, len(x) // 2))
    centres = centroids(x, lists, rounds=6)
    of = nearest(x, centres)
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(lists + 1))
    parts = []
    for c in range(lists):
        own = x[order[edge[c] : edge[c + 1]]]
        few = min(max(1, round(wanted * len(own) / len(x))), max(1, len(own) // 2))
        parts.append(centroids(own, few, rounds=2) if few > 1 else centres[c : c + 1])
    held = np.diff(edge) * (n / len(x))
    return Lists(
        centres, np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts),
        np.maximum(1, np.ceil(held / BLOCK)).astype(np.int64), np.maximum(1, np.ceil(held * 2 / PORTION)).astype(np.int64),
    )


def routes(x: np.ndarray, lists: Lists, probes: int, margin: float, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The list each row of x belongs to, and (row, list) of the lists it probes."""
    n, count = len(x), len(lists.centres)
    top = min(top, count)
    coarse = x @ lists.centres.T
    near = np.argpartition(coarse, count - top, axis=1)[:, count - top :]
    pair_list = near.ravel()
    order = np.argsort(pair_list, kind="stable")
    best = np.full((n * top, probes), -np.inf, np.float32)
    edge = np.flatnonzero(np.diff(pair_list[order], prepend=-1))
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(order)], strict=True):
        at = order[lo:hi]
        c = pair_list[at[0]]
        value = x[at // top] @ lists.prototypes[lists.start[c] : lists.start[c + 1]].T
        if value.shape[1] > probes:
            value = np.partition(value, value.shape[1] - probes, axis=1)[:, -probes:]
        best[at, : value.shape[1]] = value
    every = best.reshape(n, top * probes)
    highest = best.max(1).reshape(n, top)
    least = np.maximum(np.partition(every, every.shape[1] - probes, axis=1)[:, -probes], highest.max(1) - margin)
    row, slot = np.nonzero(highest >= least[:, None])
    return near[np.arange(n), highest.argmax(1)], row, near[row, slot]


def _tightened(x: np.ndarray, p: np.ndarray, row: np.ndarray, col: np.ndarray, dist: np.ndarray, bound: np.ndarray, keep: int) -> np.ndarray:
    """A lower bound per query where the `keep` survivors of least partial distance give one; rows come in order of query."""
    order = np.lexsort((dist, row))
    place = np.arange(len(row)) - np.searchsorted(row, row)
    head = order[place < keep]
    who = row[head]
    full = 2 - 2 * np.einsum("ij,ij->i", x[col[head]], p[who])
    most = np.full(len(p), -np.inf, np.float32)
    np.maximum.at(most, who, full.astype(np.float32))
    most[np.bincount(who, minlength=len(p)) < keep] = np.inf
    return np.minimum(bound, most + 1e-6)


def scan(x: np.ndarray, q: np.ndarray, k: int, epsilon: float = EPSILON, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k + 1 nearest rows of x for each row of q (both unit length, rotated): query numbers, row numbers, similarities.

    Fewer come back where x has fewer rows. The pairs are the exact k + 1 best but for candidates wrongly abandoned, which
    the test allows at the rate set by epsilon. While many candidates survive, a block is one matrix product over all of them;
    once few do, only the survivors' columns are read.
    """
    m, dim = x.shape
    keep = min(k + 1, m)
    xs = np.cumsum(x * x, axis=1)
    out = []
    for lo in range(0, len(q), 256):
        p = q[lo : lo + 256]
        ps = np.cumsum(p * p, axis=1)
        d = min(columns, dim)
        part = ps[:, d - 1 : d] + xs[None, :, d - 1] - 2 * (p[:, :d] @ x[:, :d].T)
        if m > 4 * keep and dim > d:
            # The first bound: the k-th distance among those that look best after one block, one of each of 4 k stretches.
            wide = m // (4 * keep)
            first = part[:, : wide * 4 * keep].reshape(len(p), 4 * keep, wide).argmin(2) + np.arange(0, wide * 4 * keep, wide)
            full = 2 - 2 * np.einsum("ijk,ik->ij", x[first], p)
            bound = np.partition(full, keep - 1, axis=1)[:, keep - 1] + 1e-6
        else:
            bound = np.full(len(p), np.inf, np.float32)
        row = col = dist = None
        while True:
            if d < dim:
                most = bound * (d / dim) * (1 + epsilon / np.sqrt(d)) ** 2
                if row is None:
                    alive = part <= most[:, None]
                    if np.count_nonzero(alive) < alive.size // 12:
                        row, col = np.nonzero(alive)
                        dist = part[row, col]
                        bound = _tightened(x, p, row, col, dist, bound, keep)
                else:
                    stay = dist <= most[row]
                    row, col, dist = row[stay], col[stay], dist[stay]
            else:
                break
            e = min(d + columns, dim)
            if row is None:
                part += ps[:, e - 1 : e] - ps[:, d - 1 : d] + (xs[:, e - 1] - xs[:, d - 1])[None, :] - 2 * (p[:, d:e] @ x[:, d:e].T)
                part[~alive] = np.inf
            else:
                dist = dist + (ps[row, e - 1] - ps[row, d - 1]) + (xs[col, e - 1] - xs[col, d - 1]) - 2 * np.einsum("ij,ij->i", p[row, d:e], x[col, d:e])
            d = e
        if row is None:
            col = np.argpartition(part, keep - 1, axis=1)[:, :keep].ravel()
            row = np.repeat(np.arange(len(p)), keep)
            whole = np.isfinite(part[row, col])
            row, col = row[whole], col[whole]
        sims = np.einsum("ij,ij->i", p[row], x[col])
        order = np.lexsort((col, -sims, row))
        row, col, sims = row[order], col[order], sims[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < keep
        out.append((row[top] + lo, col[top], sims[top]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))  # type: ignore[return-value]


def _spread(row: np.ndarray, part_of: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, list) as often as `copies` says, with a running number from 0."""
    number = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    return np.repeat(row, copies), np.repeat(part_of, copies), number.astype(np.int32)


def _route(batches: Iterator[pa.RecordBatch], dim: int, lists: Lists, probes: int, margin: float, top: int = TOP) -> Iterator[pa.RecordBatch]:
    """Each vector once per portion of its own list as data (role 0), and once per block of each probed list as a query (role 1)."""
    turn = rotation(dim)
    for batch in batches:
        x = _unit(_matrix(batch.column(1), dim)) @ turn
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            hashes, ident = (batch.column(i).slice(lo, 4096).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3))
            own, row, met = routes(part, lists, probes, margin, top)
            drow, dlist, dportion = _spread(np.arange(len(part)), own, lists.portions[own])
            dblock = (hashes[drow] % lists.blocks[dlist].astype(np.uint64)).astype(np.int32)
            qrow, qlist, qblock = _spread(row, met, lists.blocks[met])
            qportion = (ident[qrow] % lists.portions[qlist].astype(np.uint64)).astype(np.int32)
            fixed = np.rint(part * (SCALE / np.abs(part).max(1, keepdims=True))).astype(np.int16)
            take = pa.array(np.concatenate([drow, qrow]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([dlist, qlist]).astype(np.int32)),
                    pa.array(np.concatenate([dblock, qblock])),
                    pa.array(np.concatenate([dportion, qportion])),
                    pa.array(np.repeat(np.array([0, 1], np.int32), [len(drow), len(qrow)])),
                    batch.column(0).slice(lo, 4096).take(take),
                    pa.array([v.tobytes() for v in fixed], pa.binary()).take(take),
                ],
                ["list", "block", "portion", "role", "id", "vec"],
            )


def _decode(raw: list[bytes], dim: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), np.int16).reshape(-1, dim).astype(np.float32))


def _search(batches: Iterator[pa.RecordBatch], dim: int, k: int, epsilon: float) -> Iterator[pa.RecordBatch]:
    """Reads partitions sorted by (list, block, portion, role, vec, id): first a block's vectors, then its queries as they stream by."""
    key: tuple | None = None
    vectors: list[bytes] = []
    owners: list[list[bytes]] = []
    ready: np.ndarray | None = None
    first: pa.Array | None = None

    def found(ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        row, col, sims = scan(ready, q, k, epsilon)
        # a vector that several ids share stands for the smallest k + 1 of them
        more = np.array([len(o) for o in owners])
        left, right, value = [ids.take(pa.array(row))], [first.take(pa.array(col))], [sims]
        if (more > 1).any():
            again = np.flatnonzero(more[col] > 1)
            left += [pa.array([ids[int(row[i])].as_py() for i in again for _ in owners[col[i]][1:]], pa.binary())]
            right += [pa.array([o for i in again for o in owners[col[i]][1:]], pa.binary())]
            value += [np.repeat(sims[again], more[col[again]] - 1)]
        me, other = pa.concat_arrays(left), pa.concat_arrays(right)
        batch = pa.RecordBatch.from_arrays([me, other, pa.array(np.concatenate(value).astype(np.float32))], ["id", "other", "similarity"])
        return batch.filter(pc.not_equal(me, other))

    for batch in batches:
        part_of, block, portion, role = (batch.column(i).to_numpy() for i in range(4))
        edge = np.flatnonzero((np.diff(part_of) != 0) | (np.diff(block) != 0) | (np.diff(portion) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(part_of)], strict=True):
            if lo == hi:
                continue
            now = (part_of[lo], block[lo], portion[lo])
            ids, raw = batch.column(4).slice(lo, hi - lo), batch.column(5).slice(lo, hi - lo)
            if now != key:
                key, vectors, owners, ready = now, [], [], None
            if role[lo] == 0:
                for i, v in zip(ids.to_pylist(), raw.to_pylist(), strict=True):
                    if vectors and vectors[-1] == v:
                        if len(owners[-1]) <= k:
                            owners[-1].append(i)
                    else:
                        vectors.append(v)
                        owners.append([i])
                ready = None
                continue
            if not vectors:
                continue
            if ready is None:
                ready = _decode(vectors, dim)
                first = pa.array([o[0] for o in owners], pa.binary())
            yield found(ids, _decode(raw.to_pylist(), dim))


def neighbours(df: DataFrame, dim: int, k: int = 5, id_col: str = "id", vector_col: str = "embedding", probes: int = PROBES, margin: float = MARGIN, epsilon: float = EPSILON, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """(id, other, similarity, place): for every id the k other ids of highest cosine similarity, ties to the smaller id.

    Vectors that are null, not of `dim` values, without length or with a value that is null, infinite or not a number take no
    part, nor do null ids; of an id's differing vectors the smallest (compared value by value) counts. Fewer than k + 1 usable
    ids give shorter lists, none give an empty result. Other columns are ignored.
    """
    v = F.col(f"`{vector_col}`").cast("array<float>")
    usable = F.col(f"`{id_col}`").isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < 1e18)) & F.exists(v, lambda x: F.abs(x) > 1e-15)
    rows = df.where(usable).select(pack(F.col(f"`{id_col}`")).alias("id"), v.alias("v"))
    spark = df.sparkSession
    n = rows.count()
    empty = spark.createDataFrame([], "id string, other string, similarity float, place int")
    if n < 2:
        return empty
    rate = min(1.0, min(sample, max(FEW, n // 8)) / n)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(rate * 1_000_003) + 1).select("v").limit(2 * sample)
    fit = np.unique(_unit(_matrix(drawn.toArrow().column(0), dim)), axis=0) @ rotation(dim)
    made = fitted(fit, n)
    held = spark.sparkContext.broadcast((made.centres, made.start, made.prototypes, made.blocks, made.portions))

    single = rows.groupBy("id").agg(F.min("v").alias("v"))
    hashed = single.select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64("id").alias("hid"))
    routed = hashed.mapInArrow(lambda it: _route(it, dim, Lists(*held.value), probes, margin, top), "list int, block int, portion int, role int, id binary, vec binary")
    met = routed.repartition("list", "block", "portion").sortWithinPartitions("list", "block", "portion", "role", "vec", "id")
    pairs = met.mapInArrow(lambda it: _search(it, dim, k, epsilon), "id binary, other binary, similarity float")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col("other").alias("o")))), 1, k)
    return (
        pairs.groupBy("id").agg(best.alias("top"))
        .select(unpack(F.col("id")).alias("id"), F.posexplode("top").alias("p", "t"))
        .select("id", unpack(F.col("t.o")).alias("other"), (-F.col("t.s")).alias("similarity"), (F.col("p") + 1).cast("int").alias("place"))
    )


def mutual_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first: one row for each pair of which either is a neighbour of the other."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
