"""Candidate entities of a mention: by shared trigrams of names, by vectors, and both in one list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.text import normalize_name, similarity, trigrams
from skeinwork.operators.tables import first_of
from skeinwork.session import small

THRESHOLD, EACH = 0.3, 5


def entity_names(entities: DataFrame) -> DataFrame:
    """(id, name) of all names and aliases."""
    return entities.select("id", F.explode(F.array_union(F.array("canonical_name"), F.coalesce("aliases", F.array()))).alias("name")).where("id is not null and name is not null").distinct()


def by_trigrams(queries: DataFrame, names: DataFrame, k: int = EACH, threshold: float = THRESHOLD) -> DataFrame:
    """(query, id, similarity, place): for each query (query, text) the k entities (id, name) with the most similar name.

    Two sets of trigrams that reach the threshold share one of the rarest of either: of n trigrams in order of rarity the
    first n - ceil(threshold x n) + 1. Only those are joined on, so that a frequent trigram, which would be a hot key, finds
    only names it is among the rarest of; sizes that cannot reach the threshold are dropped in the join, and the similarity is
    then taken over whole sets. Equal texts and names are met once.
    """
    texts = queries.select("text").where("text is not null").distinct().withColumn("g", trigrams(F.col("text"))).where(F.size("g") > 0)
    forms = names.select("name").distinct().withColumn("h", trigrams(F.col("name"))).where(F.size("h") > 0)
    often = forms.select(F.explode("h").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))

    def rarest(sets: DataFrame, key: str, grams: str) -> DataFrame:
        met = sets.select(key, F.size(grams).alias("n"), F.explode(grams).alias("gram")).join(small(often), "gram", "left")
        ordered = met.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("o"))
        few = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
        return ordered.select(key, "n", F.explode(F.slice("o", F.lit(1), few.cast("int"))).alias("x")).select(key, "n", "x.gram")

    left, right = rarest(texts, "text", "g"), rarest(forms, "name", "h").withColumnRenamed("n", "m")
    fits = F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - 1e-9
    met = left.join(small(right), "gram").where(fits).select("text", "name").distinct()
    near = met.join(texts, "text").join(small(forms), "name").select("text", "name", similarity(F.col("g"), F.col("h")).alias("similarity")).where(F.col("similarity") >= threshold)
    best = near.join(small(names), "name").groupBy("text", "id").agg(F.max("similarity").alias("similarity"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("similarity"), "id"))).where(F.col("place") <= k)
    return queries.select("query", "text").join(ranked, "text").select("query", "id", "similarity", "place")


def described(found: DataFrame, entities: DataFrame) -> DataFrame:
    """found (.., id) with each entity's name, description and aliases, these in order of their normal form; those without have an empty list."""
    lists = entities.where("id is not null").select("id", "canonical_name", "description", F.transform(F.array_sort(F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: F.struct(normalize_name(a).alias("n"), a.alias("a")))), lambda x: x["a"]).alias("aliases"))
    one = lists.groupBy("id").agg(F.max(F.struct("canonical_name", "description", "aliases")).alias("e")).select("id", "e.*")
    return found.join(small(one), "id", "left").select(*found.columns, "canonical_name", "description", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def union(first: DataFrame, second: DataFrame, each: int = EACH) -> DataFrame:
    """(query, id, place, source): up to `each` of either list (query, id, place), the first list first, every id once."""
    both = first.select("query", "id", "place", F.lit(0).alias("rank")).unionByName(second.select("query", "id", "place", F.lit(1).alias("rank"))).where(F.col("place") <= each)
    once = first_of(both, ["query", "id"], [F.col("rank"), F.col("place")])
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "place"))
    return once.select("query", "id", place.alias("place"), F.when(F.col("rank") == 0, "name").otherwise("vector").alias("source"))
