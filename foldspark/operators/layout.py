"""How tables are laid out: hash, list and range partitions, and time chunks with retention.

Partition columns are plain expressions of a row, so writes need no shuffle, and filters on them prune
folders. Chunks are half-open spans of ``days`` days counted from ``ORIGIN``.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORIGIN = "2000-01-03"
DEFAULT = "default"


def hash_partition(key: Column, n: int) -> Column:
    """0 to n - 1 by the first eight hex digits of the key's md5, the same in any engine; null is 0."""
    digits = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(digits % n, F.lit(0)).cast("int")


def list_partition(value: Column, lists: Mapping[str, Sequence]) -> Column:
    """The name of the list that holds the value, else the default partition's."""
    out = F.lit(DEFAULT)
    for name, values in reversed(lists.items()):
        out = F.when(value.isin(list(values)), name).otherwise(out)
    return out


def range_partition(value: Column, ranges: Mapping[str, tuple]) -> Column:
    """The name of the range (from, to) that holds the value, ``to`` excluded, else the default's."""
    out = F.lit(DEFAULT)
    for name, (low, high) in reversed(ranges.items()):
        out = F.when((value >= low) & (value < high), name).otherwise(out)
    return out


def chunk(ts: Column, days: int) -> Column:
    """The first day of the chunk that holds a time."""
    origin = F.lit(ORIGIN).cast("date")
    return F.date_add(origin, (F.floor(F.datediff(ts.cast("date"), origin) / days) * days).cast("int"))


def rolling(ts: Column, now: Column, days: int, behind: int, ahead: int) -> Column:
    """The chunk of a time from ``behind`` chunks before now's to ``ahead`` after it, else null, which is
    the default partition."""
    own, here = chunk(ts, days), chunk(now, days)
    return F.when(own.between(F.date_add(here, -behind * days), F.date_add(here, ahead * days)), own)


def chunks(table: DataFrame, ts: str, days: int) -> DataFrame:
    """One row per chunk: its span, rows, and least and greatest time."""
    start = chunk(F.col(ts), days).alias("starts")
    found = table.groupBy(start).agg(F.count("*").alias("n"), F.min(ts).alias("least"), F.max(ts).alias("greatest"))
    return found.withColumn("ends", F.date_add("starts", days))


def retained(table: DataFrame, ts: str, days: int, before: Column) -> DataFrame:
    """Without the chunks that end at ``before`` or earlier: whole chunks go, never parts of one.

    Rows without a time are in no chunk and stay. The bound is one value, so the filter on ``ts`` reaches the scan.
    """
    return table.where(F.col(ts).isNull() | (F.col(ts).cast("date") >= chunk(before, days)))


def write_chunks(table: DataFrame, path: str, ts: str, days: int, segment: Sequence[str] = ()) -> None:
    """Parquet folders by chunk. Chunks that are there already and get rows anew are replaced, others stay.

    ``segment``: the columns by which rows are ordered in each file, for compression and skipping."""
    out = table.withColumn("chunk", chunk(F.col(ts), days)).sortWithinPartitions("chunk", *segment, ts)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def read_chunks(spark, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The rows of the chunks that start from ``since`` to before ``until``; other folders are not read."""
    out = spark.read.parquet(path)
    out = out if since is None else out.where(F.col("chunk") >= since.cast("date"))
    return out if until is None else out.where(F.col("chunk") < until.cast("date"))
