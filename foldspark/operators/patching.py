"""Patches of struct columns by dotted paths: set, duplicate, increment, append, insert, remove, rename, delete."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def get(doc: Column, path: str) -> Column:
    for part in path.split("."):
        doc = doc.getField(part)
    return doc


def put(doc: Column, path: str, new: Column) -> Column:
    """``withField`` makes a null parent null; here the other fields of ``doc`` stay."""
    return doc.withField(path, new)


def set_value(doc: Column, path: str, new) -> Column:
    return put(doc, path, value(new))


def duplicate(doc: Column, path: str, *to: str) -> Column:
    for p in to:
        doc = put(doc, p, get(doc, path))
    return doc


def increment(doc: Column, path: str, by=1) -> Column:
    """A missing number counts as 0."""
    return put(doc, path, F.coalesce(get(doc, path), F.lit(0)) + by)


def append(doc: Column, path: str, new, if_absent: bool | Callable = False) -> Column:
    """Only where there is an array. ``if_absent``: unless it holds the value, or an element for which the function given is true."""
    have = get(doc, path)
    held = F.exists(have, if_absent) if callable(if_absent) else F.array_contains(have, value(new)) if if_absent else F.lit(False)
    return put(doc, path, F.when(F.coalesce(held, F.lit(False)), have).otherwise(F.array_append(have, value(new))))


def insert(doc: Column, path: str, new, index: int | None = None, if_absent: bool = False) -> Column:
    """At a zero-based place, or at the end, which also stands for places beyond it."""
    have = get(doc, path)
    place = F.least(F.lit(index) + 1, F.size(have) + 1) if index is not None else F.size(have) + 1
    held = F.array_contains(have, value(new)) if if_absent else F.lit(False)
    return put(doc, path, F.when(F.coalesce(held, F.lit(False)), have).otherwise(F.array_insert(have, place, value(new))))


def remove(doc: Column, path: str, old=None, where: Callable | None = None) -> Column:
    """Every element that equals ``old`` (or satisfies ``where``) goes; null elements stay unless asked for."""
    gone = where or (lambda x: x.eqNullSafe(value(old)))
    return put(doc, path, F.filter(get(doc, path), lambda x: ~F.coalesce(gone(x), F.lit(False))))


def put_entry(doc: Column, path: str, key, new) -> Column:
    """Add or replace an entry of a map, where there is a map."""
    have = get(doc, path)
    return put(doc, path, F.map_concat(F.map_filter(have, lambda k, _: k != value(key)), F.create_map(value(key), value(new))))


def remove_entry(doc: Column, path: str, key) -> Column:
    return put(doc, path, F.map_filter(get(doc, path), lambda k, _: k != value(key)))


def rename(doc: Column, old: str, new: str) -> Column:
    """The value moves to ``new``, a full path."""
    return doc.withField(new, get(doc, old)).dropFields(old)


def delete(doc: Column, path: str) -> Column:
    return doc.dropFields(path)


def patch(df: DataFrame, doc: str, change: Callable[[Column], Column], where: Column | str | None = None) -> DataFrame:
    """Apply ``change`` to the column ``doc`` of the rows that satisfy ``where`` (an expression or SQL text).

    A change that alters the type must apply to all rows.
    """
    if where is None:
        return df.withColumn(doc, change(F.col(doc)))
    hit = F.expr(where) if isinstance(where, str) else where
    return df.withColumn(doc, F.when(F.coalesce(hit, F.lit(False)), change(F.col(doc))).otherwise(F.col(doc)))
