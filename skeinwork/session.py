"""Session settings, the shared checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when Catalyst's own estimate of it is below this many bytes.
BROADCAST_BYTES = 32 << 20


def session(app: str = "skeinwork", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Pins what results depend on. Returns the same session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share: the session's, as `spark.checkpoint.dir` or set on its context.

    On a local master without one the session's own warehouse serves; on a cluster that is an error, as a folder of one
    machine would lose data.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its estimated size is within the limit; beyond it the join shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def counted_small(df: DataFrame, row_bytes: int = 128, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same by an exact count of rows of at most so many bytes; for what is cheap to count, as rows that were checkpointed."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Rows ahead of a costly pass in Python, dealt to all cores where the scan has fewer partitions than that; no shuffle otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
