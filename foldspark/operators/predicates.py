"""Predicates over scalars, arrays and maps. None of those over collections gives null."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_true(c: Column) -> Column:
    return c.isNotNull() & c


def is_false(c: Column) -> Column:
    """A missing flag counts as false."""
    return ~sure(c)


def equals(c: Column, value) -> Column:
    """Equality where None asks for null; ``!=`` keeps SQL's rule that a null member is not unequal."""
    return c.isNull() if value is None else c == F.lit(value)


def compare(a: Column, b) -> Column:
    """-1, 0 or 1 by the order of the two values; null if one is missing."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def equals_ignore_case(c: Column, value: str) -> Column:
    return F.lower(c) == value.lower()


def any_of(c: Column, pred: Callable | None = None) -> Column:
    """Some element satisfies ``pred``; null collections and null outcomes are false."""
    return ~is_empty(c) if pred is None else sure(F.exists(c, pred))


def all_of(c: Column, pred: Callable) -> Column:
    """No element is null or fails ``pred``; null and empty collections are true."""
    return ~sure(F.exists(c, lambda x: x.isNull() | ~pred(x)))


def all_null(c: Column) -> Column:
    return ~sure(F.exists(c, lambda x: x.isNotNull()))


def none_null(c: Column) -> Column:
    return ~sure(F.exists(c, lambda x: x.isNull()))


def contains(c: Column, value) -> Column:
    return sure(F.array_contains(c, F.lit(value)))


def literals(values: Sequence) -> Column:
    return F.array(*map(F.lit, values))


def overlaps(c: Column, values: Sequence) -> Column:
    """Some element is one of ``values``."""
    return sure(F.arrays_overlap(c, literals(values)))


def subset_of(c: Column, values: Sequence) -> Column:
    return sure(F.size(F.array_except(c, literals(values))) == 0)


def superset_of(c: Column, values: Sequence) -> Column:
    return sure(F.size(F.array_except(literals(values), c)) == 0)


def is_empty(c: Column) -> Column:
    """Null or without elements (also for maps)."""
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def count_of(c: Column, pred: Callable | None = None) -> Column:
    """The number of elements (that satisfy ``pred``); 0 for a null collection."""
    return F.greatest(F.coalesce(F.size(c if pred is None else F.filter(c, pred)), F.lit(0)), F.lit(0))


def sum_of(c: Column, pick: Callable = lambda x: x) -> Column:
    """0 for none; null elements are left out."""
    return F.coalesce(F.aggregate(F.transform(c, pick), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))), F.lit(0.0))


def min_of(c: Column, pick: Callable = lambda x: x) -> Column:
    return F.array_min(F.transform(c, pick))


def max_of(c: Column, pick: Callable = lambda x: x) -> Column:
    return F.array_max(F.transform(c, pick))


def average_of(c: Column, pick: Callable = lambda x: x) -> Column:
    """The mean of the elements that are not null, or null."""
    have = F.filter(F.transform(c, pick), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, sum_of(have) / F.size(have))


def at(c: Column, index: int) -> Column:
    """Zero-based; null beyond the end."""
    return F.get(c, F.lit(index))


def has_key(c: Column, key) -> Column:
    return sure(F.map_contains_key(c, F.lit(key)))


def value_at(c: Column, key) -> Column:
    return F.try_element_at(c, F.lit(key))


def any_value(c: Column, pred: Callable) -> Column:
    return any_of(F.map_values(c), pred)


def any_pair(c: Column, pred: Callable) -> Column:
    """``pred(key, value)`` holds for some entry."""
    return any_of(F.map_entries(c), lambda e: pred(e["key"], e["value"]))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (F.regexp_replace(c, r"^\s+|\s+$", "") == "")


def null_or_empty(c: Column) -> Column:
    return c.isNull() | (c == "")
