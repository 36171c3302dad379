"""Event-store reads and writes: streams, versions, appends, gaps, archive, masks, old event types."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def versions(events: DataFrame, stream: str, seq: str) -> DataFrame:
    """Versions from 1 within each stream, for events that don't store them."""
    return events.withColumn("version", F.row_number().over(W.partitionBy(stream).orderBy(seq)))


def fetch(events: DataFrame, stream, stream_col: str, version: int | None = None, until=None, from_version: int = 0, seq: str = "event_id", ts: str = "ts") -> DataFrame:
    """A slice of one stream; the filter on the stream reaches the scan."""
    out = events.where(F.col(stream_col) == stream)
    out = (out if "version" in events.columns else versions(out, stream_col, seq)).where(F.col("version") >= from_version)
    if version:
        out = out.where(F.col("version") <= version)
    return out.where(F.col(ts) <= until) if until is not None else out


def state(events: DataFrame, stream: str, ts: str = "ts") -> DataFrame:
    return events.groupBy(stream).agg(F.count("*").alias("version"), F.min(ts).alias("created"), F.max(ts).alias("updated"))


def append(events: DataFrame, batch: DataFrame, stream: str, seq: str, order: str, expected: Mapping | None = None, new_only: bool = False) -> DataFrame:
    """The batch as new events: ``seq`` goes on from the greatest, ``version`` from each stream's last.

    ``expected`` names streams' versions before the append and ``new_only`` demands that no stream exists;
    both fail when the query runs. Sequence numbers come from two prefix sums, within ranges of the
    batch's order and over the ranges, so that no task numbers the whole batch.
    """
    last = events.groupBy(F.col(stream).alias("_s")).agg(F.max("version").alias("_v"))
    top = F.broadcast(events.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_top")))
    named = batch.select(stream).distinct().withColumnRenamed(stream, "_s")
    last = named.join(last, "_s", "left").select("_s", F.coalesce("_v", F.lit(0)).alias("_v"))
    if expected is not None:
        want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
        bad = F.map_contains_key(want, F.col("_s")) & (F.try_element_at(want, F.col("_s")) != F.col("_v"))
        last = last.where(F.when(bad, F.raise_error(F.lit("the stream has another version")).cast("string").isNull()).otherwise(True))
    if new_only:
        last = last.where(F.when(F.col("_v") > 0, F.raise_error(F.lit("the stream exists already")).cast("string").isNull()).otherwise(True))
    own = batch.withColumn("_n", F.row_number().over(W.partitionBy(stream).orderBy(order)))
    own = own.withColumn("_r", F.floor(F.col(order) / 100_000))
    before = own.groupBy("_r").agg(F.count("*").alias("_m"))
    before = before.select("_r", F.coalesce(F.sum("_m").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = own.join(F.broadcast(before), "_r").withColumn("_at", F.row_number().over(W.partitionBy("_r").orderBy(order)) + F.col("_before"))
    out = own.join(last, F.col(stream) == F.col("_s")).crossJoin(top)
    out = out.withColumn(seq, F.col("_top") + F.col("_at")).withColumn("version", F.col("_v") + F.col("_n"))
    return out.select(*events.columns)


def query_events(events: DataFrame, types: Sequence[str] | None = None, where: Column | None = None, number: int = 1, size: int = 100, seq: str = "event_id", kind: str = "event_type") -> DataFrame:
    """A page of events, newest first, with the number of all that match."""
    hit = events if types is None else events.where(F.col(kind).isin(list(types)))
    hit = hit if where is None else hit.where(where)
    rows = hit.orderBy(F.col(seq).desc()).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(hit.agg(F.count("*").alias("total_rows"))))


def event_page(events: DataFrame, floor: int, ceiling: int, size: int, types: Sequence[str] | None = None, seq: str = "event_id", kind: str = "event_type") -> DataFrame:
    """The next events of a reader: above ``floor``, up to ``ceiling``, in order; both bounds reach the scan."""
    hit = events.where((F.col(seq) > floor) & (F.col(seq) <= ceiling))
    hit = hit if types is None else hit.where(F.col(kind).isin(list(types)))
    return hit.orderBy(seq).limit(size)


def statistics(events: DataFrame, stream: str, seq: str) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.countDistinct(stream).alias("streams"), F.max(seq).alias("sequence"))


def gaps(events: DataFrame, seq: str, width: int = 1_000_000, tenant: str | None = None) -> DataFrame:
    """Missing ranges of a sequence (of each tenant's), as (after, before).

    Neighbours are found inside ranges of ``width`` numbers; only each range's ends meet in one
    small window, so no task sorts the whole sequence.
    """
    by = [tenant] if tenant else []
    t = events.select(*by, F.col(seq).alias("s")).withColumn("r", F.floor(F.col("s") / width))
    inside = t.withColumn("next", F.lead("s").over(W.partitionBy(*by, "r").orderBy("s"))).where("next > s + 1").select(*by, F.col("s").alias("after"), F.col("next").alias("before"))
    ends = t.groupBy(*by, "r").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).withColumn("next", F.lead("lo").over(W.partitionBy(*by).orderBy("r")))
    return inside.unionByName(ends.where("next > hi + 1").select(*by, F.col("hi").alias("after"), F.col("next").alias("before")))


def high_water(events: DataFrame, seq: str, mark: int = 0) -> DataFrame:
    """The last number up to which none is missing after ``mark``: the first gap's lower edge, or the greatest."""
    above = events.where(F.col(seq) >= mark)
    edge = gaps(above, seq).agg(F.min("after").alias("edge"))
    return above.agg(F.max(seq).alias("top"), F.min(seq).alias("low")).crossJoin(F.broadcast(edge)).select(F.when(F.col("low") > mark + 1, mark).otherwise(F.coalesce("edge", "top", F.lit(mark))).alias("mark"))


def archive(events: DataFrame, stream: str, ids: Sequence) -> DataFrame:
    """Marks the streams' events; ``store.scan`` leaves them out from then on."""
    old = F.coalesce(F.col("is_archived"), F.lit(False)) if "is_archived" in events.columns else F.lit(False)
    return events.withColumn("is_archived", old | F.col(stream).isin(list(ids)))


def compact(events: DataFrame, stream: str, seq: str, id, upto: int, snapshot: Column, body: str, kind: str = "event_type") -> DataFrame:
    """A stream's events up to a version become one event ``compacted`` in the place of the last of them,
    whose body is the aggregate ``snapshot`` over them."""
    numbered = events if "version" in events.columns else versions(events, stream, seq)
    gone = (F.col(stream) == id) & (F.col("version") <= upto)
    old = numbered.where(gone)
    last = F.struct(*[F.col(c) for c in numbered.columns])
    one = old.agg(F.max_by(last, "version").alias("_l"), snapshot.alias("_b")).where("_l is not null")
    one = one.select(*[F.lit("compacted").alias(c) if c == kind else F.col("_b").alias(c) if c == body else F.col("_l").getField(c).alias(c) for c in numbered.columns])
    return numbered.where(~gone).unionByName(one)


def overwrite(events: DataFrame, seq: str, number: int, body: str, new) -> DataFrame:
    """Replaces the body of one event."""
    return events.withColumn(body, F.when(F.col(seq) == number, F.lit(new)).otherwise(F.col(body)))


def mask(events: DataFrame, rules: Mapping[str, Callable[[Column], Column]], body: str, where: Column | None = None, kind: str = "event_type") -> DataFrame:
    """Bodies changed by a rule for each event type, for the events that satisfy ``where``."""
    out = F.col(body)
    for name, rule in rules.items():
        hit = F.col(kind) == name
        out = F.when(hit if where is None else hit & where, rule(F.col(body))).otherwise(out)
    return events.withColumn(body, out)


def upcast(events: DataFrame, steps: Mapping[str, tuple[str, Callable[[Column], Column]]], body: str, kind: str = "event_type") -> DataFrame:
    """Old event types read as new ones: type -> (new type, change of the body); chains go on to the newest."""
    for _ in range(len(steps)):
        new_kind, new_body = F.col(kind), F.col(body)
        for old, (new, change) in steps.items():
            new_kind = F.when(F.col(kind) == old, new).otherwise(new_kind)
            new_body = F.when(F.col(kind) == old, change(F.col(body))).otherwise(new_body)
        events = events.select(*[new_kind.alias(c) if c == kind else new_body.alias(c) if c == body else F.col(c) for c in events.columns])
    return events


def roll_up(events: DataFrame, keys: list[str], types: list[str]) -> DataFrame:
    """One row per key with a count for each event type."""
    return events.groupBy(*keys).agg(*[F.count(F.when(F.col("event_type") == t, 1)).alias(f"n_{t}") for t in types])


def flat_table(events: DataFrame, key: str, seq: str, adds: list[str], subtracts: list[str], deletes: list[str]) -> DataFrame:
    """Signed sums of ``value`` since each key's last delete; keys ending in a delete are absent."""
    live = since_delete(events, [key], seq, F.col("event_type").isin(deletes))
    signed = F.when(F.col("event_type").isin(adds), F.col("value")).when(F.col("event_type").isin(subtracts), -F.col("value")).otherwise(0.0)
    return live.groupBy(key).agg(F.round(F.sum(signed), 4).alias("total"), F.count("*").alias("revision"))


def since_delete(events: DataFrame, keys: list[str], seq: str, deletes: Column) -> DataFrame:
    """The events after each key's last delete."""
    last = events.where(deletes).groupBy(*keys).agg(F.max(seq).alias("_cut"))
    live = events.join(last, keys, "left").where(F.col("_cut").isNull() | (F.col(seq) > F.col("_cut")))
    return live.drop("_cut")
