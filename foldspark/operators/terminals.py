"""Operators that end a query with one value or one row."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(df: DataFrame, pred: Column | None = None, name: str = "n") -> DataFrame:
    return (df if pred is None else df.where(pred)).agg(F.count("*").alias(name))


def exists(df: DataFrame, pred: Column | None = None, name: str = "found") -> DataFrame:
    """One task stops at its first row."""
    return (df if pred is None else df.where(pred)).limit(1).agg((F.count("*") > 0).alias(name))


def total(df: DataFrame, member: Column, name: str = "total") -> DataFrame:
    """0 where there are no rows."""
    return df.agg(F.coalesce(F.sum(member), F.lit(0)).alias(name))


def average(df: DataFrame, member: Column, name: str = "mean") -> DataFrame:
    return df.agg(F.avg(member.cast("double")).alias(name))


def first(df: DataFrame, *order, default: bool = True) -> DataFrame:
    """The first row by ``order``; without rows none, or with ``default`` off an error."""
    out = df.orderBy(*order).limit(1)
    return out if default else guarded(out, F.lit(False), "the sequence contains no elements", need=True)


def single(df: DataFrame, default: bool = False) -> DataFrame:
    """The only row. More than one row is an error, and without ``default`` so is none."""
    return guarded(df.limit(2), F.col("_n") > 1, "the sequence contains more than one element", need=not default)


def guarded(few: DataFrame, bad: Column, message: str, need: bool) -> DataFrame:
    """Rows of ``few`` (two at most), failing when the query runs if ``bad`` holds of their number or, with ``need``, if there are none."""
    packed = few.agg(F.collect_list(F.struct(*[F.col(c) for c in few.columns])).alias("_rows")).withColumn("_n", F.size("_rows"))
    check = F.when(bad, F.raise_error(F.lit(message)))
    if need:
        check = check.when(F.col("_n") == 0, F.raise_error(F.lit("the sequence contains no elements")))
    rows = F.when(check.isNull(), F.col("_rows"))
    return packed.select(F.inline(rows))


def distinct_count(df: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    return df.select(*columns).distinct().agg(F.count("*").alias(name))
