"""Keeping tables: merging, replacing, cascading, removing orphans, validating, choosing one row per key.

Snapshots are immutable; each function returns the new content of a table as a plan over the old one and the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.session import small


def upsert(base: DataFrame, updates: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """base with updates put in place by key: a row of updates replaces the row of its key, or is added.

    `keep` columns of replaced rows stay as they were. Keys must be unique on both sides and have no null. One shuffle of
    each side by key, none if updates are small.
    """
    columns = base.columns
    old, new = base.alias("o"), small(updates.select(*columns, F.lit(True).alias("_new"))).alias("n")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    kept = old.join(new, same, "left").select(
        *((F.col(f"o.{c}") if c in key or c in keep else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in columns)
    )
    return kept.unionByName(updates.select(*columns).join(base.select(*key), key, "left_anti"))


def replace_partitions(base: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """base with every partition that occurs in fresh replaced by its rows there."""
    return base.join(small(fresh.select(partition).distinct()), partition, "left_anti").select(*base.columns).unionByName(fresh.select(*base.columns))


def delete(base: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """base without the rows whose key is in gone."""
    return base.join(small(gone.select(*key).distinct()), key, "left_anti").select(*base.columns)


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent still exists, and those without one."""
    there = parents.select(F.col(parent_key).alias("_parent")).distinct()
    return children.join(there, F.col(child_key) == F.col("_parent"), "left_semi").unionByName(children.where(F.col(child_key).isNull()))


def orphans(entities: DataFrame, claims: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """The ids of entities that no claim has as subject or object; among limits them to given ids.

    The two ends are one column of a distinct list, so the join is by equality and a hot entity is one row before its shuffle.
    """
    ends = claims.select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("id")).where("id is not null").distinct()
    ids = entities.select("id").where("id is not null").distinct()
    if among is not None:
        ids = ids.join(small(among.select("id").distinct()), "id", "left_semi")
    return ids.join(ends, "id", "left_anti")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): the rows that break a rule, each rule a condition that must hold; null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule")).distinct()


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given. Only one row per key and task is shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that are `missing` from actual, `unknown` in it, or there `repeated`."""
    counted = actual.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    wanted = expected.select(F.col(key).alias("_want")).where("_want is not null").distinct()
    both = wanted.join(counted, F.col("_want") == F.col(key), "full_outer")
    problem = F.when(F.col(key).isNull(), "missing").when(F.col("_want").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select(F.coalesce("_want", key).alias(key), problem.alias("problem")).where("problem is not null")


def first_spelling(names: DataFrame, by: str, name: str, normal: Column, order: list[str]) -> DataFrame:
    """(by, name, normal): of the spellings of one name that share a normal form the first."""
    return first_of(names.withColumn("normal", normal), [by, "normal"], [F.col(o) for o in order]).select(by, name, "normal")


def still_valid(cache: DataFrame, current: DataFrame, key: list[str], mark: str) -> DataFrame:
    """The cached rows whose mark is that of the current row of their key, or whose key has none now; a null mark equals a null."""
    now = current.groupBy(*key).agg(F.max(F.struct(mark)).alias("_now"))
    return cache.join(now, key, "left").where(F.col("_now").isNull() | F.col(f"_now.{mark}").eqNullSafe(F.col(mark))).select(*cache.columns)
