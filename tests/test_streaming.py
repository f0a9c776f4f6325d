from pyspark.sql import functions as F

from skeinwork.operators import changefeed as cf
from skeinwork.sources.snapshots import Snapshots
from skeinwork.streaming import events as ev

DATA = "/root/testdata/sf0.001"


def streamed(spark, build, name, mode="complete"):
    source = spark.readStream.schema(spark.read.parquet(f"{DATA}/events.parquet").schema).parquet(f"{DATA}/events.parque[t]")
    build(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def batch(spark, build):
    return {tuple(r) for r in build(spark.read.parquet(f"{DATA}/events.parquet")).collect()}


def test_stream_equals_batch(spark):
    for n, build in enumerate((lambda e: ev.sessions(e, "user_id", "ts"), lambda e: ev.windows(e, "event_type", "ts", "event_id", "1 hour"), lambda e: ev.windows(e, "event_type", "ts", "event_id", "2 hours", "1 hour"), lambda e: ev.latest(e.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]))):
        assert streamed(spark, build, f"stream{n}") == batch(spark, build)


def test_once_in_a_stream(spark):
    double = lambda e: ev.once(e.unionByName(e), ["event_id"], "ts").select("event_id")
    assert streamed(spark, double, "once", "append") == batch(spark, lambda e: e.select("event_id"))


def test_fold_into_is_idempotent(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    sink = ev.fold_into(store, "jobs", "segment_id", ["source_generation", "attempts"], ["source_fingerprint"])
    feed = spark.read.parquet(f"{DATA}/job_changes.parquet")
    parts = [feed.where(F.pmod("change_no", F.lit(3)) == i) for i in range(3)]
    for n in (2, 0, 1):
        sink(parts[n], n)
    version = store.version
    sink(parts[1], 1)
    assert store.version == version
    live = lambda s: {tuple(r) for r in cf.current(s, "segment_id", ["source_generation", "attempts"], ["source_fingerprint"]).collect()}
    assert live(store.read("jobs")) == live(cf.fold(feed, "segment_id", ["source_generation", "attempts"], ["source_fingerprint"]))


def test_inactive(spark):
    e = spark.createDataFrame([(1, "2025-01-01 00:00:00"), (2, "2025-01-01 00:04:59"), (2, "2025-01-01 00:05:01"), (3, "2025-01-01 00:05:00")], "u int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert {r["u"] for r in ev.inactive(e, "u", "t", "2025-01-01 00:15:00").collect()} == {1, 3}
