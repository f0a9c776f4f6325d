"""Documents packed into containers of fixed capacity by swap-based local search.

Documents are dealt by hash into shards of about `shard` documents, each packed by one task on its own; a shard wastes less
than one container against the best possible where its search ends at the fewest containers its sizes need. A shard starts
from next fit, which looks at nothing but the last container; the work is done by exchanges: the emptiest container gives
documents to any other one - a document moves, one changes places with one, or one with two in either direction - and each
exchange raises the sum of squared fills, so that fill gathers in some containers and others run empty. No container is left
out of the search, and it ends only where nothing is left to gain.
A document is cut only if it alone exceeds the capacity: into full containers and one remainder that is packed like any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.prefix import running_sum
from skeinwork.session import cut, small

CAPACITY, SHARD = 2_048, 4_096
#: Local searches of a shard, at most; the first that reaches the fewest containers its sizes need is the last.
STARTS = 4


def next_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin, items taken as they come: an item that does not fit the last bin opens another."""
    bins: list[list[int]] = []
    room = 0
    for i, w in enumerate(sizes):
        if w > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= w
    return bins


class Shelf:
    """Bins under local search: item numbers, and item sizes as rows of a matrix padded by zeros."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.capacity = capacity
        self.items = [list(b) for b in bins]
        self.sizes = sizes
        self.w = np.zeros((len(bins), max(map(len, bins), default=1)), np.int64)
        for n, b in enumerate(bins):
            self.w[n, : len(b)] = [sizes[i] for i in b]
        self.fill = self.w.sum(1)

    def _set(self, n: int, items: list[int]) -> None:
        self.items[n] = items
        if len(items) > self.w.shape[1]:
            self.w = np.pad(self.w, ((0, 0), (0, len(items) - self.w.shape[1] + 4)))
        self.w[n] = 0
        self.w[n, : len(items)] = [self.sizes[i] for i in items]
        self.fill[n] = self.w[n].sum()

    def _best(self, y: int, at: np.ndarray, gives: np.ndarray, takes: np.ndarray) -> tuple[int, int, int, int] | None:
        """(increase, receiver, column of takes, column of gives) of the exchange that raises the sum of squared fills most.

        The donor gives what gives[j] weighs and takes back what takes[x, i] weighs; negative entries do not exist.
        """
        gain = gives[None, None, :] - takes[:, :, None]
        room = (self.capacity - self.fill[at])[:, None, None]
        ahead = (self.fill[at] - self.fill[y])[:, None, None]
        fine = (gain > 0) & (gain <= room) & (ahead + gain > 0) & (takes >= 0)[:, :, None]
        value = np.where(fine, gain * (ahead + gain), 0)
        n = int(value.argmax())
        if value.flat[n] <= 0:
            return None
        x, i, j = np.unravel_index(n, value.shape)
        return int(value[x, i, j]), int(at[x]), int(i), int(j)

    def step(self, y: int) -> bool:
        """The best exchange of bin y with any other bin that is not full: one item moves or changes places with one; only where
        there is no such exchange, one item changes places with two, in either direction. False if there is none."""
        at = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        at = at[at != y]
        ours = len(self.items[y])
        if not len(at) or not ours:
            return False
        wide = max(len(self.items[x]) for x in at)
        theirs = np.where(self.w[at, :wide] > 0, self.w[at, :wide], -1)
        mine = self.w[y, :ours]
        none = np.zeros((len(at), 1), np.int64)
        if best := self._best(y, at, mine, np.concatenate([none, theirs], axis=1)):
            _, x, i, j = best
            return self._swap(x, y, [i - 1] if i else [], [j])
        a, b = np.triu_indices(ours, 1)
        best, two = None, True
        if len(a):
            best = self._chunked(y, at, mine[a] + mine[b], theirs)
        c, d = np.triu_indices(wide, 1)
        if len(c):
            for lo in range(0, len(at), max(1, 4_000_000 // (len(c) * ours))):
                part = slice(lo, lo + max(1, 4_000_000 // (len(c) * ours)))
                both = np.where((theirs[part][:, c] > 0) & (theirs[part][:, d] > 0), theirs[part][:, c] + theirs[part][:, d], -1)
                other = self._best(y, at[part], mine, both)
                if other and (best is None or other[0] > best[0]):
                    best, two = other, False
        if best is None:
            return False
        _, x, i, j = best
        return self._swap(x, y, [i] if two else [int(c[i]), int(d[i])], [int(a[j]), int(b[j])] if two else [j])

    def _chunked(self, y: int, at: np.ndarray, gives: np.ndarray, theirs: np.ndarray) -> tuple[int, int, int, int] | None:
        best = None
        size = max(1, 4_000_000 // (len(gives) * theirs.shape[1]))
        for lo in range(0, len(at), size):
            other = self._best(y, at[lo : lo + size], gives, theirs[lo : lo + size])
            if other and (best is None or other[0] > best[0]):
                best = other
        return best

    def _swap(self, x: int, y: int, out: list[int], into: list[int]) -> bool:
        mine, theirs = self.items[y], self.items[x]
        left, given = [theirs[i] for i in out], [mine[j] for j in into]
        self._set(x, [i for n, i in enumerate(theirs) if n not in out] + given)
        self._set(y, [i for n, i in enumerate(mine) if n not in into] + left)
        return True


def _searched(sizes: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """One local search from next fit: bins of item numbers, and the number of exchanges made."""
    shelf = Shelf(sizes, next_fit(sizes, capacity), capacity)
    fewest = -(-sum(sizes) // capacity)
    used, exchanges, changed = len(shelf.items), 0, True
    while changed and used > fewest:
        changed = False
        tried: set[int] = set()
        while used > fewest:
            open_ = [n for n in np.flatnonzero((shelf.fill > 0) & (shelf.fill < capacity)).tolist() if n not in tried]
            if not open_:
                break
            y = min(open_, key=lambda n: (shelf.fill[n], n))
            tried.add(y)
            while shelf.fill[y] and shelf.step(y):
                exchanges += 1
                changed = True
            if not shelf.fill[y]:
                used -= 1
    return [b for b in shelf.items if b], exchanges


def pack(sizes: list[int], capacity: int = CAPACITY, starts: int = STARTS) -> tuple[list[list[int]], int]:
    """Bins of item numbers, and the number of exchanges made; every size must be from 1 to the capacity.

    The emptiest bin gives items to any other until it is empty or no exchange raises the sum of squared fills; then the next
    emptiest does. A search ends when the bins are as few as all sizes together need, or when in a whole round over all bins
    no bin has an exchange left. In the latter case it is run again from other orders of the items, `starts` times in all, and
    the result of fewest bins counts, of equal ones the first.
    """
    best: list[list[int]] | None = None
    exchanges, fewest = 0, -(-sum(sizes) // capacity)
    for n in range(max(1, starts)):
        order = np.random.default_rng(n).permutation(len(sizes)).tolist() if n else list(range(len(sizes)))
        bins, made = _searched([sizes[i] for i in order], capacity)
        exchanges += made
        if best is None or len(bins) < len(best):
            best = [[order[i] for i in b] for b in bins]
        if len(best) <= fewest:
            break
    return best or [], exchanges


def _shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    # by a hash, so that next fit meets sizes in no particular order
    rows = pdf.sort_values(["h", "id", "start"])
    n, ids, starts = (rows[c].tolist() for c in ("n", "id", "start"))
    shard = int(rows["shard"].iloc[0])
    loose = [i for i, w in enumerate(n) if w < capacity]
    packed, _ = pack([n[i] for i in loose], capacity)
    # parts that fill a container need no search
    bins = [[i] for i, w in enumerate(n) if w == capacity] + [[loose[i] for i in b] for b in packed]
    out = [(shard, b, place, ids[i], starts[i], starts[i] + n[i]) for b, items in enumerate(bins) for place, i in enumerate(sorted(items, key=lambda i: (ids[i], starts[i])))]
    return pd.DataFrame(out, columns=["shard", "bin", "place", "id", "token_start", "token_end"])


def fill(sized: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container_no, place, id, token_start, token_end) of every document (id, n_tokens) with a token; containers are numbered from 0.

    token_start and token_end are the range of the document's tokens in that container: all of them unless it is cut.
    Documents without tokens, or with null id or size, are in no container.
    """
    rows = sized.where((F.col("n_tokens") > 0) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("n_tokens").cast("long").alias("n"))
    rows = cut(rows)  # sizes alone; counting them must not count all tokens twice
    parts = rows.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("part"))
    cuts = parts.select("id", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity).alias("n"), F.xxhash64("id", "part").alias("h"))
    spark = sized.sparkSession
    shards = max(1, -(-cuts.count() // shard))
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cuts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("long")).repartition(tasks, "shard")
    packed = cut(dealt.groupBy("shard").applyInPandas(lambda pdf: _shard(pdf, capacity), "shard long, bin int, place int, id long, token_start long, token_end long"))
    counts = packed.groupBy("shard").agg((F.max("bin") + 1).alias("bins")).withColumn("_all", F.lit(0))
    upto = running_sum(counts, ["_all"], F.floor(F.col("shard") / 1_024), [F.col("shard")], F.col("bins"), "upto").select("shard", (F.col("upto") - F.col("bins")).alias("base"))
    return packed.join(small(upto), "shard").select((F.col("base") + F.col("bin")).cast("long").alias("container_no"), "place", "id", "token_start", "token_end")


def usage(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of all capacity that is used."""
    per = packed.groupBy("container_no").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (F.sum("n") / (F.count("*") * capacity)).alias("used"))
