"""A document table as a sink: inserts, upserts, versions, soft deletes, tenants.

Every operation gives the table's next state as a DataFrame, to be written as a new version; nothing
is changed in place. Tables carry ``id`` and, where used, ``version``, ``deleted``, ``deleted_at``,
``tenant_id``, ``modified_at``. Changes meet the table in one join by id, whose smaller side Spark
broadcasts where its statistics allow it; a batch may name an id more than once, and then its row with
the greatest ``order`` holds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TENANT = "*DEFAULT*"


def latest(batch: DataFrame, order: Column | None, key: str = "id") -> DataFrame:
    """One row per id; combined on the map side."""
    row = F.struct(*[F.col(c) for c in batch.columns])
    pick = F.any_value(row) if order is None else F.max_by(row, order)
    return batch.groupBy(F.col(key).alias("_key")).agg(pick.alias("_row")).select("_row.*")


def both(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Full outer join of the two as structs ``t`` and ``b``."""
    t = table.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in table.columns]).alias("t"))
    b = batch.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in table.columns]).alias("b"))
    return t.join(b, "_k", "full_outer")


def refuse(hit: Column, message: str, otherwise: Column) -> Column:
    """An error when the query runs and ``hit`` holds for some row."""
    return F.when(hit, F.raise_error(F.lit(message)).cast("string").isNull()).otherwise(otherwise)


def bulk(table: DataFrame, batch: DataFrame, mode: str = "inserts_only", order: Column | None = None, key: str = "id") -> DataFrame:
    """Modes: inserts_only (an id that exists is an error), ignore_duplicates, overwrite,
    overwrite_if_version (the batch's ``version`` must be that of the stored row, else the row stays)."""
    j = both(table, latest(batch, order, key), key)
    old, new = F.col("t").isNotNull(), F.col("b").isNotNull()
    if mode == "inserts_only":
        return j.where(refuse(old & new, "an id exists already", F.lit(True))).select(F.coalesce("t", "b").alias("d")).select("d.*")
    if mode == "ignore_duplicates":
        return j.select(F.coalesce("t", "b").alias("d")).select("d.*")
    if mode == "overwrite":
        return j.select(F.coalesce("b", "t").alias("d")).select("d.*")
    if mode == "overwrite_if_version":
        raised = F.col("b").withField("version", F.col("b.version") + 1)
        return j.select(F.when(~old, F.col("b")).when(new & (F.col("b.version") == F.col("t.version")), raised).otherwise(F.col("t")).alias("d")).select("d.*")
    raise ValueError(f"unknown mode: {mode}")


def upsert(table: DataFrame, batch: DataFrame, order: Column | None = None, key: str = "id") -> DataFrame:
    """Store: new ids are added, others replaced; with a ``version`` column it counts the changes."""
    j = both(table, latest(batch, order, key), key)
    new = F.col("b")
    if "version" in table.columns:
        new = new.withField("version", F.coalesce(F.col("t.version"), F.lit(0)) + 1)
    return j.select(F.when(F.col("b").isNotNull(), new).otherwise(F.col("t")).alias("d")).select("d.*")


def insert(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    return bulk(table, batch, "inserts_only", key=key)


def update(table: DataFrame, batch: DataFrame, order: Column | None = None, key: str = "id") -> DataFrame:
    """Replaces stored documents; an id that isn't stored is an error."""
    j = both(table, latest(batch, order, key), key)
    return j.where(refuse(F.col("t").isNull(), "no such document", F.lit(True))).select(F.coalesce("b", "t").alias("d")).select("d.*")


def update_expected(table: DataFrame, batch: DataFrame, tolerate: bool = False, key: str = "id") -> DataFrame:
    """The batch's ``version`` names the version it was made from. Another stored version is an error, or
    with ``tolerate`` the stored row stays."""
    j = both(table, batch, key)
    stale = F.col("b").isNotNull() & F.col("t").isNotNull() & (F.col("b.version") != F.col("t.version"))
    raised = F.col("b").withField("version", F.coalesce(F.col("b.version"), F.lit(0)) + 1)
    if not tolerate:
        j = j.where(refuse(stale, "the document has another version", F.lit(True)))
    return j.select(F.when(stale | F.col("b").isNull(), F.col("t")).otherwise(raised).alias("d")).select("d.*")


def hard_delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def soft_delete(table: DataFrame, where: Column, now: Column | None = None) -> DataFrame:
    """Marks the rows that satisfy ``where`` and aren't marked yet."""
    hit = F.coalesce(where, F.lit(False)) & ~F.coalesce(F.col("deleted"), F.lit(False))
    at = F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("deleted_at"))
    return table.withColumn("deleted_at", at).withColumn("deleted", hit | F.coalesce(F.col("deleted"), F.lit(False)))


def undo_delete(table: DataFrame, where: Column) -> DataFrame:
    hit = F.coalesce(where, F.lit(False)) & F.coalesce(F.col("deleted"), F.lit(False))
    return table.withColumn("deleted_at", F.when(~hit, F.col("deleted_at"))).withColumn("deleted", F.coalesce(F.col("deleted"), F.lit(False)) & ~hit)


def scan(table: DataFrame, deleted: bool | None = False, tenants: list[str] | str | None = DEFAULT_TENANT, archived: bool | None = False) -> DataFrame:
    """The default filters of a query, for the columns the table has. ``deleted`` and ``archived``: only
    those without the mark (False), only those with it (True), or either (None). ``tenants``: one, several,
    or None for any."""
    for name, want in (("deleted", deleted), ("is_archived", archived)):
        if name in table.columns and want is not None:
            mark = F.coalesce(F.col(name), F.lit(False))
            table = table.where(mark if want else ~mark)
    if "tenant_id" in table.columns and tenants is not None:
        table = table.where(F.col("tenant_id").isin([tenants] if isinstance(tenants, str) else list(tenants)))
    return table


def deleted_since(at) -> Column:
    return F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("deleted_at") > at)


def deleted_before(at) -> Column:
    return F.coalesce(F.col("deleted"), F.lit(False)) & (F.col("deleted_at") < at)


def modified_since(at, column: str = "modified_at") -> Column:
    """Strictly later; the same for creation with ``column``."""
    return F.col(column) > at


def modified_before(at, column: str = "modified_at") -> Column:
    return F.col(column) < at


def delete_tenant(table: DataFrame, tenant: str) -> DataFrame:
    return hard_delete(table, F.col("tenant_id") == tenant)


def write(table: DataFrame, path: str, *partitions: str) -> None:
    """A state as Parquet, by tenant or another partition column, so that filters on it prune folders."""
    table.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def hilo(batch: DataFrame, high: int, size: int = 1000, key: str = "id", tasks: int = 2**20) -> DataFrame:
    """Ids for new rows from blocks of ``size``: a task takes the block of its own number, counted from ``high``,
    and then every ``tasks``-th one.

    Ids are distinct and above ``high * size``, with gaps, and need no shuffle. Rows that are computed again may
    get other ids, so write the result before using it twice. More than ``tasks`` tasks are an error.
    """
    n = F.monotonically_increasing_id()
    task, row = F.shiftright(n, 33), n.bitwiseAND(F.lit(2**33 - 1))
    block = F.lit(high) + F.floor(row / size) * F.lit(tasks) + F.when(task < tasks, task).otherwise(F.raise_error(F.lit("too many tasks")).cast("bigint"))
    return batch.withColumn(key, block * size + row % size + 1)
