"""Vector and geographic distances as JVM-side expressions."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return 1 - _dot(a, b) / F.sqrt(_dot(a, a) * _dot(b, b))


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_dot(d, d))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Metres along a great circle."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(h))


def inner(a: Column, b: Column) -> Column:
    """The negative inner product, so that the nearest come first."""
    return -_dot(a, b)


MEASURES = {"l2": l2, "cosine": cosine, "inner": inner}


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, measure: str = "l2", key: str = "id") -> DataFrame:
    """The k rows nearest to ``query`` with their ``distance``; rows without a vector are left out. Each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.where(F.col(vector).isNotNull()).withColumn("distance", MEASURES[measure](F.col(vector), q)).orderBy("distance", key).limit(k)


def within(lat: Column, lon: Column, at: tuple[float, float], metres: float) -> Column:
    """A point stands within a distance; a box of degrees, which reaches the scan, comes before the distance."""
    near = haversine(lat, lon, F.lit(at[0]), F.lit(at[1])) <= metres
    d = math.degrees(metres / 6371008.8)
    return lat.between(at[0] - d, at[0] + d) & near


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """A point lies inside a ring: an odd number of edges cross the ray from it to greater x."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > y) != (F.lit(y2) > y)
        crossed = crossed + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


def boxes_meet(low1: tuple[Column, Column], high1: tuple[Column, Column], low2, high2) -> Column:
    """Two boxes share a point."""
    return (low1[0] <= high2[0]) & (high1[0] >= low2[0]) & (low1[1] <= high2[1]) & (high1[1] >= low2[1])
