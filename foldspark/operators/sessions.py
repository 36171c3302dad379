"""Queries kept for reuse, several queries in one job, and sessions that remember documents."""

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.operators import store


@dataclass(frozen=True)
class Compiled:
    """SQL with named parameters (``:name``) over tables (``{name}``), written once and run with any arguments.

    Arguments are bound as literals, never pasted into the text.
    """

    sql: str

    def run(self, spark: SparkSession, tables: Mapping[str, DataFrame], **args) -> DataFrame:
        return spark.sql(self.sql, args=args, **tables)


def batch(queries: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of several queries in one job: query, row as JSON. ``answers`` takes them apart.

    Scans and shuffles that queries share are planned once."""
    parts = [df.select(F.lit(name).alias("query"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")) for name, df in queries.items()]
    if not parts:
        raise ValueError("a batch needs a query")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def answers(batched: DataFrame, queries: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each query's rows again, with its columns and types, from a batch that was written or cached."""
    return {name: batched.where(F.col("query") == name).select(F.from_json("row", df.schema).alias("r")).select("r.*") for name, df in queries.items()}


@dataclass
class Session:
    """Documents by id as dictionaries. ``tracking``: none (each load reads anew), identity (an id gives the same
    object) or dirty (as identity, and objects that were changed are found when saving).

    It holds what was asked for by id, never a query's result."""

    table: DataFrame
    tracking: str = "identity"
    key: str = "id"
    held: dict = field(default_factory=dict)
    read: dict = field(default_factory=dict)
    stored: dict = field(default_factory=dict)

    def load_many(self, ids: Sequence) -> list[dict]:
        """The documents that exist, in the order of ``ids``; one job for those that are not held."""
        known = {} if self.tracking == "none" else self.held
        want = [i for i in dict.fromkeys(ids) if i not in known]
        found = {r[self.key]: r.asDict(recursive=True) for r in self.table.where(F.col(self.key).isin(want)).collect()} if want else {}
        if self.tracking != "none":
            self.held |= found
            self.read |= {i: json.dumps(d, default=str, sort_keys=True) for i, d in found.items()}
        known = found if self.tracking == "none" else self.held
        return [known[i] for i in ids if i in known]

    def load(self, id) -> dict | None:
        return next(iter(self.load_many([id])), None)

    def store(self, document: dict) -> None:
        self.stored[document[self.key]] = document
        if self.tracking != "none":
            self.held[document[self.key]] = document

    def evict(self, id) -> None:
        for d in (self.held, self.read, self.stored):
            d.pop(id, None)

    def changes(self) -> list[dict]:
        """What saving would write: stored documents and, if tracked, those changed since they were read."""
        dirty = {i: d for i, d in self.held.items() if i in self.read and json.dumps(d, default=str, sort_keys=True) != self.read[i]} if self.tracking == "dirty" else {}
        return list((dirty | self.stored).values())

    def save(self) -> DataFrame:
        """The table's next state; the session goes on from it."""
        rows = self.changes()
        if rows:
            spark = self.table.sparkSession
            new = spark.createDataFrame([tuple(d.get(c) for c in self.table.columns) for d in rows], self.table.schema)
            self.table = store.upsert(self.table, new, key=self.key)
            self.stored, self.read = {}, {i: json.dumps(d, default=str, sort_keys=True) for i, d in self.held.items()}
        return self.table


def descendants(parents: Mapping[str, str | None], kind: str) -> list[str]:
    """A document type and all types below it, from each type's parent."""
    found, new = [kind], [kind]
    while new:
        new = sorted(k for k, p in parents.items() if p in new and k not in found)
        found += new
    return found


def of_type(table: DataFrame, parents: Mapping[str, str | None], kind: str, column: str = "doc_type") -> DataFrame:
    """The rows of one hierarchy's table that are of ``kind`` or of a type below it."""
    return table.where(F.col(column).isin(descendants(parents, kind)))


def query_plan(build: Callable[..., DataFrame], **fixed) -> Callable[..., DataFrame]:
    """A reusable query object: a builder with some of its arguments fixed."""
    return lambda *tables, **args: build(*tables, **(fixed | args))
