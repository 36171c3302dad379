"""Includes: a query's rows and the related documents they name."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids_of(rows: DataFrame, member: str | Column) -> DataFrame:
    """The distinct ids that a member holds: a scalar, a list or a map's values."""
    c = F.col(member) if isinstance(member, str) else member
    kind = rows.select(c.alias("id")).schema["id"].dataType.typeName()
    c = F.explode(F.map_values(c)) if kind == "map" else F.explode(c) if kind == "array" else c
    return rows.select(c.alias("id")).where("id is not null").distinct()


def include(rows: DataFrame, member: str | Column, others: DataFrame, mapping: str = "id", where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` and the documents of ``others`` that they name by ``mapping``, each once, filtered by ``where``.

    Rows may be one page: only its documents are included. A semi join, so that no row is repeated.
    """
    others = others if where is None else others.where(where)
    found = others.join(ids_of(rows, member).withColumnRenamed("id", "_id"), F.col(mapping) == F.col("_id"), "left_semi")
    return rows, found


def lookup(keys: DataFrame, key: str, value, streams: DataFrame, stream: str) -> DataFrame:
    """The streams that a natural key names, by a table of (key, stream)."""
    return streams.join(keys.where(F.col(key) == value).select(stream).distinct(), stream, "left_semi")


def tagged(events: DataFrame, tags: DataFrame, conditions: Sequence[tuple[str, str, str | None]], event_id: str = "event_id", kind: str = "event_type") -> DataFrame:
    """Events with one of the conditions (tag type, value, event type or None), each once, in one pass over the tags."""
    hit = F.lit(False)
    named = tags
    for tag, value, only in conditions:
        one = (F.col("tag") == tag) & (F.col("value") == value)
        hit = hit | (one if only is None else one & (F.col(kind) == only))
    if any(only is not None for _, _, only in conditions):
        named = tags.join(events.select(event_id, kind), event_id)
    return events.join(named.where(hit).select(event_id).distinct(), event_id, "left_semi")


def with_any(child: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Keys of the parents with a child row that satisfies the predicate, which reaches the child table's scan."""
    return child.where(predicate).select(key).distinct()


def with_all(child: DataFrame, key: str, predicate: Column) -> DataFrame:
    """Keys of the parents that have child rows and none that fails the predicate; null counts as failing."""
    return child.groupBy(key).agg(F.bool_and(F.coalesce(predicate, F.lit(False))).alias("_all")).where("_all").select(key)
