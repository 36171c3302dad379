"""Read models from events.

``Model`` folds by rules that Spark combines on the map side, so a hot key needs no task of its own;
``fold_with`` takes any Python fold and streams each key's events through it in order, holding one
state at a time.
"""

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.streams import since_delete


@dataclass
class Model:
    """Columns of a read model by name, each an aggregate built by one of the rules below.

    ``create``: types one of which a key must have (after its last delete) to have a row, if given.
    ``deletes``: types that remove the row; later events start anew.
    """

    columns: Mapping[str, Callable[[str], Column]]
    create: Sequence[str] = ()
    deletes: Sequence[str] = ()
    kind: str = "event_type"
    keys: list[str] = field(default_factory=list)

    def fold(self, events: DataFrame, keys: str | list[str], seq: str) -> DataFrame:
        keys = [keys] if isinstance(keys, str) else list(keys)
        live = since_delete(events, keys, seq, F.col(self.kind).isin(list(self.deletes))) if self.deletes else events
        made = F.max(F.col(self.kind).isin(list(self.create))) if self.create else F.lit(True)
        out = live.groupBy(*keys).agg(*[rule(seq).alias(c) for c, rule in self.columns.items()], F.count("*").alias("version"), made.alias("_made"))
        return out.where("_made").drop("_made")


def of(types: Sequence[str] | str, kind: str = "event_type") -> Column:
    return F.col(kind).isin([types] if isinstance(types, str) else list(types))


def counted(types) -> Callable[[str], Column]:
    return lambda seq: F.count(F.when(of(types), 1))


def summed(value: str, types, minus=()) -> Callable[[str], Column]:
    """The sum over ``types``, less that over ``minus``; 0 for none."""
    return lambda seq: F.coalesce(F.sum(F.when(of(types), F.col(value)).when(of(list(minus)) if minus else F.lit(False), -F.col(value))), F.lit(0))


def newest(value: str, types) -> Callable[[str], Column]:
    """The value of the last such event."""
    return lambda seq: F.max_by(F.when(of(types), F.col(value)), F.when(of(types), F.col(seq)))


def oldest(value: str, types) -> Callable[[str], Column]:
    return lambda seq: F.min_by(F.when(of(types), F.col(value)), F.when(of(types), F.col(seq)))


def flagged(on, off) -> Callable[[str], Column]:
    """True if the last of the events of both kinds is of ``on``."""
    both = [*([on] if isinstance(on, str) else on), *([off] if isinstance(off, str) else off)]
    return lambda seq: F.coalesce(F.max_by(F.when(of(both), of(on)), F.when(of(both), F.col(seq))), F.lit(False))


def live(model: Model, events: DataFrame, stream: str, id, seq: str, upto: Column | None = None) -> DataFrame:
    """One stream's aggregate from its events (those that satisfy ``upto``); no row without events."""
    events = events.where(F.col(stream) == id)
    return model.fold(events if upto is None else events.where(upto), stream, seq)


def routed(events: DataFrame, identity: Column) -> DataFrame:
    """Events under each read model's key that they belong to: ``identity`` gives a key or an array of keys."""
    keyed = events.withColumn("_key", identity)
    if keyed.schema["_key"].dataType.typeName() == "array":
        keyed = keyed.withColumn("_key", F.explode(F.array_distinct("_key")))
    return keyed.where("_key is not null")


def multi_stream(model: Model, events: DataFrame, identity: Column, seq: str, name: str = "id") -> DataFrame:
    return model.fold(routed(events, identity), "_key", seq).withColumnRenamed("_key", name)


def fan_out(events: DataFrame, items: Column, child: str, seq: str, body: str, kind: str = "event_type") -> DataFrame:
    """Each element of ``items`` becomes an event of type ``child`` right after its parent, which stays.

    Order within a parent is kept in ``part`` (0 for the parent).
    """
    parents = events.withColumn("part", F.lit(0)).withColumn("item", F.lit(None).cast(events.select(items.alias("x")).schema["x"].dataType.elementType))
    kids = events.select(*events.columns, F.posexplode(items).alias("part", "item")).withColumn("part", F.col("part") + 1).withColumn(kind, F.lit(child))
    return parents.unionByName(kids.select(*parents.columns))


def months(ts: str) -> Column:
    """A key part for each month."""
    return F.date_format(F.col(ts), "yyyy-MM")


def enriched(events: DataFrame, reference: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Events with columns looked up in a reference table, whose rows have distinct keys."""
    return events.join(reference.select(key, *columns), key, "left")


def changes(before: DataFrame, after: DataFrame, key: str, seq: str = "event_id") -> DataFrame:
    """What a stage did to a read model, as events for the next: key, event_type updated or deleted, and the row.

    Rows that did not change give no event."""
    a, b = (t.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in after.columns]).alias(n)) for t, n in ((before, "old"), (after, "new")))
    both = a.join(b, "_k", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(F.col("_k").alias(key), F.when(F.col("new").isNull(), "deleted").otherwise("updated").alias("event_type"), F.coalesce("new", "old").alias("row"))


def fold_with(events: DataFrame, key: str, seq: str, start: Callable, apply: Callable, schema: str) -> DataFrame:
    """Any fold: ``apply(state, event)`` over a key's events in order, from ``start(key)``; an event is a named
    tuple, a state a dict of the columns of ``schema`` (which has the key), or None for no row. Events that make
    ``apply`` raise ``SkipEvent`` are left out."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, out = None, None, []
        begun = False
        for pdf in batches:
            for e in pdf.itertuples(index=False):
                k = getattr(e, key)
                if not begun or k != now:
                    if begun and held is not None:
                        out.append(held)
                    begun, now, held = True, k, start(k)
                try:
                    held = apply(held, e)
                except SkipEvent:
                    continue
                if len(out) >= 10_000:
                    yield pd.DataFrame(out)
                    out = []
        if begun and held is not None:
            out.append(held)
        if out:
            yield pd.DataFrame(out)

    return events.repartition(key).sortWithinPartitions(key, seq).mapInPandas(one, schema)


class SkipEvent(Exception):
    """An event that a fold cannot use."""


def timeline(model: Model, events: DataFrame, stream: str, id, seq: str) -> DataFrame:
    """The fold's state after each event of one stream, by a running window."""
    from pyspark.sql import Window as W

    w = W.partitionBy(stream).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    one = events.where(F.col(stream) == id)
    return one.select(stream, seq, F.count("*").over(w).alias("version"), *[over(rule(seq), w).alias(c) for c, rule in model.columns.items()])


def over(aggregate: Column, w) -> Column:
    return aggregate.over(w)

def stepped(types) -> Callable[[str], Column]:
    """One up for each such event, but for one that made the row, which starts at 0; for ``flat_upsert``."""
    return lambda seq: F.count(F.when(of(types) & (F.col(seq) > F.col("_made")), 1))


def flat_upsert(events: DataFrame, key: str, seq: str, columns: Mapping[str, Callable[[str], Column]], full: Sequence[str], partial: Sequence[str] = (), deletes: Sequence[str] = (), kind: str = "event_type") -> DataFrame:
    """A flat table whose rows only events of the types ``full`` insert: those that map every required column.

    Events of the types ``partial`` change a row that is there and do nothing without one; ``deletes`` remove it,
    and later events start anew. The first such event of each key is found by an aggregate, not by a window.
    """
    mapped = events.where(of([*full, *partial, *deletes], kind) & F.col(key).isNotNull())
    live = since_delete(mapped, [key], seq, of(list(deletes), kind)) if deletes else mapped
    made = live.where(of(list(full), kind)).groupBy(key).agg(F.min(seq).alias("_made"))
    held = live.join(made, key).where(F.col(seq) >= F.col("_made"))
    return held.groupBy(key).agg(*[rule(seq).alias(name) for name, rule in columns.items()])


def natural_keys(events: DataFrame, value: Column, stream: str, seq: str) -> DataFrame:
    """natural_key, stream: each stream's key as its last event that names one has it (``value``, else null).

    A key that two streams hold in the end is an error when the query runs."""
    own = events.withColumn("_v", value).where("_v is not null").groupBy(stream).agg(F.max_by("_v", seq).alias("natural_key"))
    held = own.groupBy("natural_key").agg(F.min(stream).alias(stream), F.count("*").alias("_n"))
    return held.where(F.when(F.col("_n") > 1, F.raise_error(F.lit("two streams hold one natural key")).cast("string").isNull()).otherwise(True)).drop("_n")


def by_natural_key(events: DataFrame, keys: DataFrame, wanted, stream: str) -> DataFrame:
    """The events of the stream that holds the key ``wanted``; none if no stream does."""
    return events.join(F.broadcast(keys.where(F.col("natural_key") == wanted).select(stream)), stream, "left_semi")


def assign_tags(tags: DataFrame, events: DataFrame, where: Column, tag: str, value: Column, seq: str = "event_id") -> DataFrame:
    """The tag table with ``tag`` on every event that satisfies ``where``; a tag that is there stays one row."""
    new = events.where(where).select(seq, F.lit(tag).alias("tag"), value.alias("value"))
    return tags.select(seq, "tag", "value").unionByName(new).distinct()


def repaired_progress(progress: DataFrame, events: DataFrame, seq: str) -> DataFrame:
    """Progress rows with none beyond the greatest event, and the high-water mark set to it."""
    top = events.agg(F.coalesce(F.max(seq), F.lit(0))).scalar()
    return progress.withColumn("last_seq", F.when(F.col("name") == "HighWaterMark", top).otherwise(F.least(F.col("last_seq"), top)))
