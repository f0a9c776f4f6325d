"""Outside sources and sinks: declared schemas throughout, nothing inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REQUEST = (
    "session_id string, start_user_message_id string, end_user_message_id string, projection_version int, messages array<struct<role: string, text: string>>"
)
CHECKPOINT = "session_id string, context_limit double, checkpoint struct<tail_start: string, summary: string, created_at_message string, lossy: boolean>"


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON files that fit the schema, and the raw lines (line) of those that do not."""
    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.text(path).withColumn("j", F.from_json("value", StructType([*shape.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    fine = F.col("j").isNotNull() & F.col("j._bad").isNull()
    return rows.where(fine).select(*(F.col(f"j.{f.name}") for f in shape.fields)), rows.where(~F.coalesce(fine, F.lit(False))).select(F.col("value").alias("line"))


def jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a database; with a numeric partition column it is read in that many ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        reader = reader.options(partitionColumn=partition, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of a few keys. The list reaches the scan, which skips row groups without any of them."""
    return df.where(F.col(key).isin(values))


def newest_first(sessions: DataFrame, at: str = "time_created", key: str = "id") -> DataFrame:
    """Sessions from the newest on, of one time the greater key first; those without a time come last."""
    return sessions.orderBy(F.col(at).desc_nulls_last(), F.desc(key))


def in_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Rows of each group together and in order (messages of sessions, parts of messages), without a global sort."""
    return rows.repartition(group).sortWithinPartitions(group, *order)


def assembled(messages: DataFrame, parts: DataFrame, schema: str | None = None) -> DataFrame:
    """messages (id, ...) with the list of their parts (message_id, id, data) in order of id; an empty list where there are none.

    With a schema, data is parsed as JSON of that shape; what is no such JSON becomes a null in its place.
    """
    data = F.col("data") if schema is None else F.from_json("data", schema)
    lists = parts.select("message_id", F.struct("id", data.alias("data")).alias("s")).groupBy("message_id").agg(F.array_sort(F.collect_list("s")).alias("p")).select("message_id", F.col("p.data").alias("parts"))
    joined = messages.join(lists, messages["id"] == lists["message_id"], "left").drop("message_id")
    return joined.withColumn("parts", F.coalesce("parts", F.array().cast(lists.schema["parts"].dataType)))


def pretty(df: DataFrame) -> DataFrame:
    """One JSON text per row, indented."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))
