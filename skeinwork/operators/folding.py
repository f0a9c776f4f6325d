"""Greedy cutting of ordered rows into runs, where a cut depends on all before it.

Rows are partitioned by group, sorted within their partition and streamed through a fold that keeps one running total; no
group is ever held in memory, however many rows it has. A hot group is one task's sequential pass over narrow rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Packer:
    """Closes a run before it would exceed the limit, right when it meets it, and around rows that exceed it alone."""

    def __init__(self, limit: float):
        self.limit = limit
        self.run, self.size, self.open = 0, 0.0, False

    def take(self, weight: float) -> tuple[int, bool]:
        """(run number from 1, whether this row surely ends its run)."""
        if self.open and self.size + weight > self.limit:
            self.open = False
        if not self.open:
            self.run, self.size, self.open = self.run + 1, 0.0, True
        self.size += weight
        ended = self.size >= self.limit
        if ended:
            self.open = False
        return self.run, ended


class BoundPacker(Packer):
    """Packs rows between bounds like Packer, and puts rows of one bound into a run of their own."""

    def __init__(self, limit: float):
        super().__init__(limit)
        self.bound: object = None

    def take(self, weight: float, bound: object = None) -> tuple[int, bool]:
        fresh, self.bound = bound != self.bound, bound
        if fresh:
            self.open = False
        if bound is None:
            return super().take(weight)
        self.run += fresh
        return self.run, True


class Batcher:
    """Starts a new batch when the next item would make too many items or too many bytes."""

    def __init__(self, items: int, limit: float):
        self.items, self.limit = items, limit
        self.run, self.size, self.count = 1, 0.0, 0

    def take(self, weight: float) -> tuple[int, bool]:
        if self.count and (self.count >= self.items or self.size + weight > self.limit):
            self.run, self.size, self.count = self.run + 1, 0.0, 0
        self.size += weight
        self.count += 1
        return self.run, False


def runs(df: DataFrame, group: str, order: list[str], weight: str, make, also: str | None = None) -> DataFrame:
    """df with run_no (bigint, from 1 in each group) and run_ended (whether the row itself closes its run).

    make builds the fold of a group; also names a further column it is given. Null weights count as 0; a null group is a group.
    order must be total.
    """
    schema = df.select(*df.columns, F.lit(0).cast("long").alias("run_no"), F.lit(False).alias("run_ended")).schema
    place, heavy, third = df.columns.index(group), df.columns.index(weight), None if also is None else df.columns.index(also)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            numbers, ends = [], []
            more = [()] * batch.num_rows if third is None else [(x,) for x in batch.column(third).to_pylist()]
            for g, w, x in zip(batch.column(place).to_pylist(), batch.column(heavy).to_pylist(), more, strict=True):
                if state is None or g != now:
                    now, state = g, make()
                number, end = state.take(0.0 if w is None or math.isnan(w) else float(w), *x)
                numbers.append(number)
                ends.append(end)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(ends, pa.bool_())], [*batch.schema.names, "run_no", "run_ended"])

    return df.repartition(group).sortWithinPartitions(group, *order).mapInArrow(fold, schema)


def packed(df: DataFrame, group: str, order: list[str], weight: str, limit: float) -> DataFrame:
    return runs(df, group, order, weight, lambda: Packer(limit))


def batched(df: DataFrame, group: str, order: list[str], weight: str, items: int = 128, limit: float = 100_000) -> DataFrame:
    return runs(df, group, order, weight, lambda: Batcher(items, limit))
