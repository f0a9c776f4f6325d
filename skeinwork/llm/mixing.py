"""Records of several sources combined so that each has its target share of all tokens, by weighted fair queueing.

Each source's documents are shuffled by a keyed hash, once per pass, and queue up pass after pass, up to the source's most
repeats. A document's virtual finish time is the cumulative size of its source's queue up to and with it, divided by the
source's weight. Served in order of finish time, every prefix of the mixture has the target shares to within one document per
source. The mixture ends at the total budget; without one given, at the largest total that no source falls short of.

The cumulative sizes are two-level: a source is cut into hash ranges, range totals are combined before the shuffle, and the
fine order is settled within each range alone, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.prefix import running_sum
from skeinwork.session import cut, small

#: Hash ranges a pass over a source is cut into.
RANGES = 1_024


def mixture(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1) -> DataFrame:
    """(id, source, pass_no, n_tokens, finish) of the documents in the mixture, in order of finish.

    sized: (id, source, n_tokens). targets: (source, target_share, max_repeats). Only sources with a positive share and at
    least one repeat count, and only their documents with a token; documents without a source, or of a source without target,
    stay out. Of targets that repeat a source the largest counts. A target source without a document, or an empty table,
    gives an empty mixture unless a budget is set.
    """
    goals = (
        targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & F.col("source").isNotNull())
        .groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("g"))
        .select("source", F.col("g.target_share").alias("weight"), F.col("g.max_repeats").cast("int").alias("most"))
    )
    docs = sized.where(F.col("id").isNotNull() & (F.col("n_tokens") > 0)).select("id", "source", "n_tokens").join(small(goals), "source")
    docs = cut(docs)  # sizes alone; adding them up must not count all tokens twice
    if budget is None:
        held = goals.join(docs.groupBy("source").agg(F.sum("n_tokens").alias("n")), "source", "left")
        limit = held.agg(F.min(F.coalesce("n", F.lit(0)) * F.col("most") / F.col("weight"))).first()[0]
        budget = float(limit or 0)
    passes = docs.select("id", "source", "n_tokens", "weight", F.explode(F.sequence(F.lit(1), "most")).alias("pass_no"))
    drawn = passes.withColumn("_draw", F.xxhash64("id", "pass_no", F.lit(seed)))
    slot = F.col("pass_no") * RANGES + F.shiftright("_draw", 54) + RANGES // 2
    summed = running_sum(drawn, ["source"], slot, [F.col("_draw"), F.col("id")], F.col("n_tokens"), "cumulative")
    served = summed.withColumn("finish", F.col("cumulative") / F.col("weight")).where(F.col("finish") <= budget)
    return served.select("id", "source", "pass_no", "n_tokens", "finish").sort("finish", "source")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, n_tokens, documents, passes) really reached, a row for every target source."""
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("documents"), F.max("pass_no").alias("passes"))
    total = per.agg(F.sum("n").alias("total"))
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = goals.join(per, "source", "left").crossJoin(F.broadcast(total))  # one row: the total
    return joined.select("source", "target_share", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"), F.coalesce("n", F.lit(0)).alias("n_tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("passes", F.lit(0)).alias("passes"))
