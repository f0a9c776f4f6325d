"""Keyed state of a stream: the latest change of each key, kept between batches, with tombstones for what was deleted.

Spark runs the changes of one key one after another, so nothing has to be locked. State is held by the RocksDB provider and
survives restarts from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skeinwork.operators import changefeed

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "first long, second long, kind int, value string"
_OUT = "key string, first long, second long, value string, outcome string"


class Latest(StatefulProcessor):
    """Per key the change of highest sequence; yields what each batch did to a key: `set`, `deleted`, or `late` for each change that came too late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        held = self._last.get() if self._last.exists() else None
        before = held
        late = []
        for pdf in rows:
            for first, second, kind, value in pdf[["first", "second", "kind", "value"]].itertuples(index=False, name=None):
                value = None if value is None or value != value else value
                change = (int(first), int(second), int(kind), value)
                if held is None or change[:3] > tuple(held)[:3]:
                    # an update without a value leaves the old one, unless the key was deleted
                    if kind == changefeed.UPDATE and value is None and held is not None and held[2] != changefeed.DELETE:
                        change = (*change[:3], held[3])
                    held = change
                elif change[:3] < tuple(held)[:3]:
                    late.append((key[0], *change[:2], value, "late"))
        out = list(late)
        if held is not None and (before is None or tuple(before) != tuple(held)):
            self._last.update(tuple(held))
            out.append((key[0], held[0], held[1], held[3], "deleted" if held[2] == changefeed.DELETE else "set"))
        if out:
            yield pd.DataFrame(out, columns=["key", "first", "second", "value", "outcome"])

    def close(self) -> None:
        pass


def latest(changes: DataFrame, key: str, order: list[str], value: str, op: str = "op") -> DataFrame:
    """(key, first, second, value, outcome) of a stream of changes, in update mode.

    order names two columns, the later one null as 0. Void changes (no key, no sequence, unknown operation) are left out;
    a delete leaves a tombstone, so that a change from before it is reported as late and revives nothing.
    """
    rows = changes.select(
        F.col(key).cast("string").alias("key"), F.col(order[0]).cast("long").alias("first"), F.coalesce(F.col(order[1]).cast("long"), F.lit(0).cast("long")).alias("second"), changefeed.operation(F.col(op)).alias("kind"), F.col(value).cast("string").alias("value")
    ).where("key is not null and first is not null and kind is not null")
    return rows.groupBy("key").transformWithStateInPandas(Latest(), _OUT, "Update", "None")
