"""Orderings: nulls stand last going up and first going down."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def by(member: str | Column, descending: bool = False, ignore_case: bool = False) -> Column:
    """``member`` may be a column, or a name with an optional ``asc`` or ``desc`` behind it."""
    if isinstance(member, str):
        name, _, suffix = member.strip().partition(" ")
        if suffix.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"unknown direction: {member}")
        descending = descending or suffix.strip().lower() == "desc"
        member = F.col(name)
    member = F.lower(member) if ignore_case else member
    return member.desc_nulls_first() if descending else member.asc_nulls_last()
