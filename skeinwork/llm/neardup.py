"""Records that say the same in slightly different words: candidates by banded min-hashes, sequential Bayesian pruning, exact check.

Records with the same set of words form a class; one record of each class is compared. A class gets `bands` x `rows`
min-hashes and a sketch of one-bit min-hashes. Two classes that agree on all rows of a band are candidates; as they meet in
their bucket, the sketches are compared batch by batch (64 bits at a time), and a pair is dropped as soon as the posterior
probability that its similarity reaches the threshold, given the bits that agree, falls below `miss`. Survivors are checked
exactly on their words. With the defaults a pair just at similarity 0.6 is missed with probability 0.2 %, one at 0.7 with less
than 1e-5.

Buckets are sorted and streamed, so each row is shuffled once. A bucket of more than `HOT` classes leaves that pass as rows:
it is cut into blocks by hash, and every two blocks meet in a task of their own. Copies are folded before banding, nothing is
collected, and no bucket loses a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.keys import pack, unpack
from skeinwork.session import cut, small

BANDS, ROWS, BATCHES = 44, 4, 2
#: Classes of a bucket that meet in one task, at most; larger buckets are cut into blocks of that many.
HOT = 1_024


def words(*texts: Column) -> Column:
    """The distinct words (longest runs of letters and digits, lower-cased) of several texts, sorted. Null texts hold none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *texts)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def most_differing(threshold: float, batches: int = BATCHES, miss: float = 1e-3) -> list[int]:
    """For 64, 128, ... one-bit min-hashes: the most that may differ with P(similarity >= threshold) >= miss.

    Uniform prior over the similarity; two records agree on a bit with probability (1 + similarity) / 2.
    """
    c = (np.linspace(0, 1, 20_001) + 1) / 2
    high = 2 * c - 1 >= threshold
    out = []
    for n in range(64, 64 * batches + 1, 64):
        most = -1
        for differ in range(n + 1):
            log = (n - differ) * np.log(c) + differ * np.log(np.maximum(1 - c, 1e-300))
            weight = np.exp(log - log.max())
            if weight[high].sum() / weight.sum() < miss:
                break
            most = differ
        out.append(most)
    return out


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, id, s0, s1, ...) for each band of each record; column 0 is the id, column 1 the list of word hashes."""
    rng = np.random.default_rng(11)
    count = bands * rows + 64 * bits
    mul = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, count, dtype=np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            ids, lists = batch.column(0).slice(lo, 512), batch.column(1).slice(lo, 512)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            n = len(size)
            mins = np.empty((count, n), np.uint32)
            for i in range(count):
                mins[i] = np.minimum.reduceat(((flat * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32), start)
            weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
            sketch = [((mins[bands * rows + 64 * j : bands * rows + 64 * (j + 1)] & 1).astype(np.uint64) * weights[:, None]).sum(0).view(np.int64) for j in range(bits)]
            bucket = np.empty((bands, n), np.uint64)
            for b in range(bands):
                h = np.full(n, b + 1, np.uint64)
                for r in range(rows):
                    h = (h ^ mins[b * rows + r].astype(np.uint64)) * mix
                    h ^= h >> np.uint64(29)
                bucket[b] = h
            at = pa.array(np.tile(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().view(np.int64)), ids.take(at), *(pa.array(np.tile(s, bands)) for s in sketch)], ["bucket", "id", *(f"s{j}" for j in range(bits))])


def _agree(i: np.ndarray, j: np.ndarray, sketch: list[np.ndarray], most: list[int]) -> np.ndarray:
    """Which pairs of row numbers survive all batches of the sketches."""
    stay = np.arange(len(i))
    differ = np.zeros(len(i), np.int64)
    for s, limit in zip(sketch, most, strict=True):
        differ = differ[: len(stay)] + np.bitwise_count((s[i[stay]] ^ s[j[stay]]).view(np.uint64))
        fine = differ <= limit
        stay, differ = stay[fine], differ[fine]
    return stay


def _meet(batches: Iterator[pa.RecordBatch], most: list[int], hot: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, side, no, sketches) sorted by bucket: all pairs of a bucket, but for two of one side if it has two sides.

    Yields (a, b, sketches as null) for pairs; rows of a bucket of more than `hot` come out as (bucket, no, sketches) instead,
    told apart by b, which is then null.
    """
    bits = len(most)
    names = ["a", "b", "bucket", *(f"s{j}" for j in range(bits))]

    def pairs(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, side, no, sketch = rows[0], rows[1], rows[2], rows[3:]
        n, left, right = len(bucket), [], []
        i, d = np.arange(n), 1
        while len(i := i[i + d < n]):
            i = i[bucket[i] == bucket[i + d]]
            if not len(i):
                break
            j = i + d
            meet = (side[i] < 0) | (side[i] != side[j])
            stay = _agree(i[meet], j[meet], sketch, most)
            left.append(no[i[meet][stay]])
            right.append(no[j[meet][stay]])
            d += 1
        one, two = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        none = pa.nulls(len(one), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), *[none] * (bits + 1)], names)

    def later(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[2]), pa.nulls(len(rows[2]), pa.int64()), pa.array(rows[0]), *(pa.array(x) for x in rows[3:])], names)

    held: list[np.ndarray] | None = None
    large: int | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(n).to_numpy() for n in range(3 + bits)]
        if large is not None:
            same = int(np.searchsorted(rows[0], large, "right")) if rows[0][0] == large else 0
            if same:
                yield later([x[:same] for x in rows])
                rows = [x[same:] for x in rows]
                if not len(rows[0]):
                    continue
            large = None
        if held is not None:
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)]
        # what may go on in the next batch is held back
        edge = np.flatnonzero(np.diff(rows[0])) + 1
        start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows[0])]])
        size = end - start
        tail = start[-1]
        if size[-1] > hot:
            large, held = int(rows[0][-1]), None
        else:
            held = [x[tail:] for x in rows]
        keep = np.repeat(size <= hot, size)
        keep[tail:] = False
        yield pairs([x[keep] for x in rows])
        out = np.repeat(size > hot, size)
        if out.any():
            yield later([x[out] for x in rows])
    if held is not None:
        yield pairs(held)


def similar(records: DataFrame, threshold: float = 0.6, bands: int = BANDS, rows: int = ROWS, batches: int = BATCHES, miss: float = 1e-3, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """records: (id, words). Returns the classes (id, rep) and the links between them (rep_a, rep_b, similarity).

    rep is the smallest id that has the same set of words; links join two different classes, the smaller rep first, whose
    Jaccard similarity is at least the threshold. Null ids and records without words take no part; an id that occurs with
    several sets of words belongs to several classes. Both results are empty for an empty input.
    """
    usable = records.where(F.col("id").isNotNull() & (F.size("words") > 0)).select(pack(F.col("id")).alias("id"), "words", F.md5(F.concat_ws(" ", "words")).alias("key"))
    heads = cut(usable.groupBy("key").agg(F.min("id").alias("rep"), F.min("words").alias("words")).withColumn("no", F.monotonically_increasing_id()))
    classes = usable.select("id", "key").join(heads.select("key", "rep"), "key").select(unpack(F.col("id")).alias("id"), unpack(F.col("rep")).alias("rep")).distinct()

    most = most_differing(threshold, batches, miss)
    sketch = [f"s{j}" for j in range(batches)]
    longs = ", ".join(f"{s} long" for s in sketch)
    met = f"a long, b long, bucket long, {longs}"
    signed = heads.select("no", F.transform("words", lambda w: F.xxhash64(w)).alias("h")).mapInArrow(lambda it: _sign(it, bands, rows, batches), f"bucket long, id long, {longs}")
    first = signed.select("bucket", F.lit(-1).alias("side"), F.col("id").alias("no"), *sketch).repartition("bucket").sortWithinPartitions("bucket")
    seen = cut(first.mapInArrow(lambda it: _meet(it, most, hot), met).groupBy("a", "b", "bucket").agg(*(F.first(s).alias(s) for s in sketch)))
    found = seen.where("b is not null").select("a", "b")
    large = seen.where("b is null")
    if not large.isEmpty():
        counted = large.groupBy("bucket").agg(F.ceil(F.count("*") / hot).cast("int").alias("k"))
        dealt = large.join(small(counted), "bucket").withColumn("block", F.pmod(F.xxhash64("a"), F.col("k")).cast("int"))
        copies = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int"))
        # the number of a pair of blocks replaces the bucket
        pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
        second = copies.select(pair.alias("bucket"), side.alias("side"), F.col("a").alias("no"), *sketch).repartition("bucket").sortWithinPartitions("bucket")
        more = second.mapInArrow(lambda it: _meet(it, most, 1 << 60), met)
        found = found.unionByName(more.select("a", "b")).distinct()
    texts = heads.select("no", "rep", "words")
    both = found.join(texts.select(F.col("no").alias("a"), F.col("rep").alias("ra"), F.col("words").alias("wa")), "a").join(texts.select(F.col("no").alias("b"), F.col("rep").alias("rb"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    checked = both.select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), (common / (F.size("wa") + F.size("wb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    return classes, checked.select(unpack(F.col("rep_a")).alias("rep_a"), unpack(F.col("rep_b")).alias("rep_b"), "similarity")


def expand(classes: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of different ids, the smaller first: within each class and across each link."""
    one, two = classes.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), classes.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.join(one, "rep_a").join(two, "rep_b").select("x", "y").where("x <> y")
    within = one.join(two, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
    return across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(within.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """What distinct edges add up to, in whatever order: their number and two sums of 64-bit hashes."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(links: DataFrame, left: str = "rep_a", right: str = "rep_b") -> DataFrame:
    """(id, group) of every id in a link: the smallest id it is joined to by any chain of links.

    Alternating large-star and small-star steps until no link changes; each step is one aggregation by node, so nothing is
    collected and a node of many links is aggregated before the shuffle. The number of steps grows with the logarithm of the
    longest chain. Lineage is cut by a checkpoint at each step.
    """
    edges = cut(links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(floor, "u")
        after = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()


def grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep, group, links): each id with its class, its group (the smallest id in reach) and its class's number of links."""
    links = cut(links)  # used for the groups and to count
    ends = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    in_groups = components(links)
    return (
        classes.join(in_groups.withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
        .select("id", "rep", F.coalesce("group", "rep").alias("group"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    )
