"""Column expressions and table helpers shared by the operators of this package."""

import atexit
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = r"[\x20\x09-\x0D]+") -> Column:
    """Runs of characters outside ``separators``; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fold(doc_id: Column, k: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def shared_folder(spark: SparkSession) -> str:
    """Where written tables go: spark.checkpoint.dir, or on one machine, if that is unset, the warehouse.

    A cluster without the setting is refused: its executors share no other folder that is known here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


_folders: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new path in this application's own folder, which is deleted when Python ends."""
    key = spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"{shared_folder(spark)}/foldspark-{key}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _folders[key])
    return f"{_folders[key]}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through a written table in the cluster's shared folder; ``drop`` deletes it early."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._cut_at)


#: Rows up to which a table of ids is broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(batch: pa.RecordBatch, text: pa.Array, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch whose texts hold about ``most`` bytes each (one text at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield batch.slice(low, high - low), text.slice(low, high - low)
        low = high


#: Texts that Spark hands to Python at once; by its own default it is 10,000, however long they are.
TEXTS_PER_BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to TEXTS_PER_BATCH rows, since both the JVM and Python hold whole
    ones; a lower setting stays. Plans made later in the session follow it too; results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_PER_BATCH:
        spark.conf.set(key, str(TEXTS_PER_BATCH))


#: Links that one task joins in memory (two longs each) before links of different tasks meet.
EDGES_PER_TASK = 500_000


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's links as stars: each node with the least node that its links reach."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = np.array([(x, r) for x in list(parent) if (r := root(x)) != x], np.int64).reshape(-1, 2)
    yield pd.DataFrame({"a": stars[:, 0], "b": stars[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component_id)``, the least id of each.

    Tasks of about EDGES_PER_TASK links first reduce them to stars. Where that took several tasks,
    large-star and small-star alternate, which halve path lengths and keep the number of edges
    bounded; they converge in a logarithmic number of rounds. Grouping only takes a minimum, so a
    hub is combined on the map side. Nodes without edges get no row.
    """
    e = cut(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    tasks = max(1, -(-e.count() // EDGES_PER_TASK))
    e, raw, last = cut(e.coalesce(tasks).mapInPandas(forest, "a long, b long")), e, None
    drop(raw)
    while tasks > 1:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = big.where("a <> b").distinct()
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        less = big.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        less = less.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e, old = cut(less), e
        drop(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    inner = e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return inner.unionByName(roots)
