"""Offset and keyset paging with totals, page flags and cursors."""

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.ordering import by

VERSION = "v1:"


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame, paged: DataFrame, name: str = "total_rows") -> DataFrame:
    """The rows of a page with the number of all rows; the count is an aggregate, no window over all rows."""
    return paged.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row about a page: totals, first and last row number on it, and the flags of a pager."""
    n = F.col("total_rows")
    pages = F.ceil(n / size).cast("long")
    t = df.agg(F.count("*").alias("total_rows")).withColumn("page_count", pages)
    first = F.when(n == 0, 0).otherwise((number - 1) * size + 1).cast("long")
    return t.select(
        "total_rows", "page_count", F.lit(number).alias("page_number"), F.lit(size).alias("page_size"), (F.col("page_count") > number).alias("has_next"), F.lit(number > 1).alias("has_previous"),
        F.lit(number == 1).alias("is_first"), (F.col("page_count") <= number).alias("is_last"), first.alias("first_row"), F.least(F.lit(number * size), n).cast("long").alias("last_row"),
    )


def after(df: DataFrame, keys: list[tuple[str, bool]], last: dict | None, size: int | None) -> DataFrame:
    """The ``size`` rows after ``last`` in the order of ``keys`` (column, descending), all without a size;
    the last key is unique.

    A null key stands last going up and first going down, as in the order.
    """
    if last is not None:
        cond = F.lit(False)
        for i, (k, desc) in enumerate(keys):
            v, c = last[k], F.col(k)
            if v is None:
                step = c.isNotNull() if desc else F.lit(False)
            else:
                step = c < v if desc else (c > v) | c.isNull()
            for name, _ in keys[:i]:
                step = step & F.col(name).eqNullSafe(F.lit(last[name]))
            cond = cond | step
        df = df.where(cond)
    df = df.orderBy(*[by(F.col(k), d) for k, d in keys])
    return df if size is None else df.limit(size)


def cursor(row: dict, keys: list[tuple[str, bool]]) -> str:
    """An opaque token of a row's key values."""
    return VERSION + base64.urlsafe_b64encode(json.dumps([row[k] for k, _ in keys]).encode()).decode()


def seek(df: DataFrame, keys: list[tuple[str, bool]], token: str | None, size: int | None) -> DataFrame:
    """The page after the row that ``token`` was made of."""
    if token is None:
        return after(df, keys, None, size)
    if not token.startswith(VERSION):
        raise ValueError("unknown cursor")
    values = json.loads(base64.urlsafe_b64decode(token[len(VERSION) :]))
    if len(values) != len(keys):
        raise ValueError("the cursor is of another order")
    return after(df, keys, dict(zip([k for k, _ in keys], values)), size)
