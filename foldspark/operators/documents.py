"""Operators over document collections."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_by(df: DataFrame, keys: Sequence[str], order: Column, latest: bool = False) -> DataFrame:
    """One row per key: the first by ``order`` (the last with ``latest``).

    max_by / min_by combine on the map side, where a ranking window would sort every row.
    """
    pick = F.max_by if latest else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(pick(row, order).alias("_row")).select("_row.*")
