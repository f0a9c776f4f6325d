"""Current state of a keyed table from a feed of inserts, updates and deletes.

The fold is commutative, associative and idempotent: each change becomes a few (sequence, value) structs and the state keeps
the maximum of each per key. Order of arrival, repeats and late changes therefore cannot matter, partial aggregation runs
before the shuffle, and a hot key sends one row per task. Folded states are themselves input to the next fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = 1, 0, 2
#: Spellings of operations, lower-cased and trimmed.
SPELLINGS = {
    INSERT: ("i", "ins", "insert", "inserted", "c", "create", "created", "r", "read"),
    UPDATE: ("u", "upd", "update", "updated", "upsert"),
    DELETE: ("d", "del", "delete", "deleted", "remove", "removed"),
}


def operation(op: Column) -> Column:
    """INSERT, UPDATE or DELETE; null for anything else."""
    text = F.lower(F.trim(op))
    return F.coalesce(*(F.when(text.isin(*names), F.lit(code)) for code, names in SPELLINGS.items()))


def fold(changes: DataFrame, key: str, order: list[str], payload: list[str], op: str = "op", base: DataFrame | None = None) -> DataFrame:
    """One state row per key, deleted keys included.

    changes: rows with the key, the `order` columns (a change's sequence, most significant first), an operation and the
    `payload` columns. Rows without the key, the first order column or a known operation are void; null in a later order
    column counts as 0. Rows of equal key and sequence are one change (a delete wins over an insert, an insert over an
    update; of differing payload values the greatest counts). An insert sets every payload column, an update only those
    that are not null and creates the key if need be, a delete ends the key. base: a state this function returned before;
    its tombstones keep late changes from reviving a key. Other columns are ignored, an empty feed gives an empty state.

    Returns key, last (sequence, operation), reset (sequence, operation of the last insert or delete) and set_<column>
    (sequence, value) for each payload column.
    """
    kind = operation(F.col(f"`{op}`"))
    at = [F.col(f"`{order[0]}`").cast("long")] + [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0).cast("long")) for c in order[1:]]
    rows = changes.select(
        F.col(f"`{key}`").alias("key"),
        kind.alias("kind"),
        F.struct(*(c.alias(f"s{i}") for i, c in enumerate(at))).alias("seq"),
        *(F.col(f"`{c}`").alias(f"value_{c}") for c in payload),
    ).where(F.col("key").isNotNull() & F.col("kind").isNotNull() & F.col("seq.s0").isNotNull())
    state = rows.select(
        "key",
        F.struct("seq", "kind").alias("last"),
        F.when(F.col("kind") != UPDATE, F.struct("seq", "kind")).alias("reset"),
        *(F.when((F.col("kind") != DELETE) & F.col(f"value_{c}").isNotNull(), F.struct("seq", F.col(f"value_{c}").alias("value"))).alias(f"set_{c}") for c in payload),
    )
    if base is not None:
        state = state.unionByName(base.select(F.col(key).alias("key"), "last", "reset", *(f"set_{c}" for c in payload)))
    return state.groupBy("key").agg(F.max("last").alias("last"), F.max("reset").alias("reset"), *(F.max(f"set_{c}").alias(f"set_{c}") for c in payload)).withColumnRenamed("key", key)


def current(state: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """The live rows of a folded state: key, the order columns of the last change, and the payload."""
    value = {}
    for c in payload:
        at = F.col(f"set_{c}.seq")
        counts = F.col("reset").isNull() | (at > F.col("reset.seq")) | ((at == F.col("reset.seq")) & (F.col("reset.kind") != DELETE))
        value[c] = F.when(counts, F.col(f"set_{c}.value"))
    return state.where(F.col("last.kind") != DELETE).select(key, *(F.col(f"last.seq.s{i}").alias(c) for i, c in enumerate(order)), *(v.alias(c) for c, v in value.items()))


def apply_feeds(feeds: list[DataFrame], key: str, order: list[str], payload: list[str], op: str = "op") -> DataFrame:
    """Folds several feeds one after another; equal to folding their union, in whatever order."""
    return reduce(lambda state, feed: fold(feed, key, order, payload, op, state), feeds[1:], fold(feeds[0], key, order, payload, op))
