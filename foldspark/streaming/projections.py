"""Continuous projections with Structured Streaming."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and time bucket; state older than the watermark is dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("bucket"), "event_type", "n", "total")


def versions_of(spark: SparkSession, sink: str) -> list[int]:
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    done = [int(n[len("batch=") :]) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{n}/_SUCCESS"))]
    return sorted(done)


def read_model(spark: SparkSession, sink: str) -> DataFrame | None:
    """The newest complete state of a projection, or None before the first batch."""
    done = versions_of(spark, sink)
    return spark.read.parquet(f"{sink}/batch={done[-1]}") if done else None


def merged(old: DataFrame | None, new: DataFrame, keys: list[str], merge: dict[str, Callable]) -> DataFrame:
    """Partial rows by key come together with the stored ones: ``merge`` has an aggregate for each column."""
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()])


def project(events: DataFrame, fold: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str], merge: dict[str, Callable]):
    """Folds each micro-batch and merges it with the state before it.

    A batch writes the whole next state under its own number and reads the newest state of a lower one, so a
    replayed batch gives the same state again. Two states are kept.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions_of(spark, sink) if v < batch_id]
        old = spark.read.parquet(f"{sink}/batch={before[-1]}") if before else None
        merged(old, fold(batch), keys, merge).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        for v in before[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/batch={v}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Pages of new events to ``handle(page, number)``, each at least once and in order."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild(events: DataFrame, fold: Callable[[DataFrame], DataFrame], sink: str) -> None:
    """The state anew from all events, in one batch job, as batch 0 of an empty sink."""
    fold(events).write.mode("overwrite").parquet(f"{sink}/batch=0")


def progress(query) -> list[dict]:
    """Where a running projection stands: its batch, its input rows and its offsets."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "offsets": [s["endOffset"] for s in p["sources"]]} for p in query.recentProgress]


def fresh(query, sink: str, spark: SparkSession) -> DataFrame | None:
    """Waits until the projection has handled all that is there, then reads its state."""
    query.processAllAvailable()
    return read_model(spark, sink)
