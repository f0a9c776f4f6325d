"""Running sums and numbers within groups that may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.session import cut


def running_sum(df: DataFrame, group: list[str], slot: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group up to and with this one.

    `slot` cuts a group into ranges that do not overlap in the order given; slots are summed first (combined before the
    shuffle), the few slot totals are accumulated per group, and the fine order is settled within each slot alone. No task
    holds more than one slot of a group.
    """
    rows = df.withColumn("_slot", slot).withColumn("_value", value)
    totals = rows.groupBy(*group, "_slot").agg(F.sum("_value").alias("_total"))
    # of the slots before alone: infinite values must not be taken away again
    sums = F.coalesce(F.sum("_total").over(Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_slot").alias("_s"), sums.alias("_before"))
    within = F.sum("_value").over(Window.partitionBy(*group, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_slot").eqNullSafe(F.col("_s"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(before, same).withColumn(name, F.col("_before") + within).select(*df.columns, name)


def _edges(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """One row for a partition sorted by group: its first and last group, their rows, and whether there is only one group."""
    first = last = None
    heads = tails = 0
    seen = False
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(at))
        values, ends = runs.values.to_pylist(), runs.run_ends.to_pylist()
        for value, size in zip(values, np.diff([0, *ends]).tolist(), strict=True):
            if not seen:
                first, heads, last, tails, seen = (value,), size, (value,), size, True
                continue
            if last == (value,):
                tails += size
            else:
                last, tails = (value,), size
            if first == last:
                heads = tails
    if seen:
        one = TaskContext.get().partitionId()
        kind = batch.schema.field(at).type
        yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([first[0]], kind), pa.array([heads], pa.int64()), pa.array([last[0]], kind), pa.array([tails], pa.int64())], ["part", "first", "heads", "last", "tails"])


def _numbers(batches: Iterator[pa.RecordBatch], at: int, before: dict[int, int], name: str) -> Iterator[pa.RecordBatch]:
    carried = before.get(TaskContext.get().partitionId(), 0)
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column(at))
        values, ends = runs.values.to_pylist(), np.array(runs.run_ends.to_pylist())
        start = np.concatenate([[0], ends[:-1]])
        size = ends - start
        base = np.zeros(len(size), np.int64)
        if last is None or last == (values[0],):
            base[0] = carried
        number = np.arange(batch.num_rows) - np.repeat(start, size) + np.repeat(base, size) + 1
        carried, last = int(number[-1]), (values[-1],)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int64())], [*batch.schema.names, name])


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds each row's number (bigint, from 1) in its group, in an order that must be total.

    One range shuffle by group and order, so that a group of any size is spread over tasks; the sorted rows are checkpointed,
    each task reports the groups at its two ends, and numbering goes on where the partition before left off. The driver sees
    one row per partition. A null group is a group.
    """
    rows = cut(df.repartitionByRange(*(F.col(c) for c in (group, *order))).sortWithinPartitions(group, *order))
    at = rows.columns.index(group)
    kind = rows.schema[group].dataType.simpleString()
    ends = rows.mapInArrow(lambda it: _edges(it, at), f"part int, first {kind}, heads long, last {kind}, tails long").collect()
    before: dict[int, int] = {}
    last, carried = None, 0
    for r in sorted(ends, key=lambda r: r["part"]):
        here = carried if last == (r["first"],) else 0
        before[r["part"]] = here
        carried = r["tails"] + (here if r["first"] == r["last"] else 0)
        last = (r["last"],)
    schema = rows.select(*rows.columns, F.lit(0).cast("long").alias(name)).schema
    return rows.mapInArrow(lambda it: _numbers(it, at, before, name), schema)
