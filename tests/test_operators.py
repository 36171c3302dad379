"""Operators that fail on purpose, keep state or stream, and edge cases without SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from foldspark.functions import text
from foldspark.operators import joins, layout, ordering, paging, patching, sessions, store, streams, terminals
from foldspark.operators import projections as pr
from foldspark.streaming import projections as live


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "a", 1), (2, "b", 4), (3, None, 2)], "id long, name string, version long")


def test_single_and_first_raise(docs):
    with pytest.raises(Exception, match="more than one"):
        terminals.single(docs).collect()
    with pytest.raises(Exception, match="no elements"):
        terminals.single(docs.where("id = 9")).collect()
    with pytest.raises(Exception, match="no elements"):
        terminals.first(docs.where("id = 9"), "id", default=False).collect()
    assert terminals.single(docs.where("id = 2")).first()["name"] == "b"
    assert terminals.first(docs, ordering.by("name desc"), "id").first()["id"] == 3


def test_writes_raise(docs):
    with pytest.raises(Exception, match="exists already"):
        store.insert(docs, docs.limit(1)).collect()
    with pytest.raises(Exception, match="no such document"):
        store.update(docs, docs.withColumn("id", F.lit(7)).limit(1)).collect()
    with pytest.raises(Exception, match="another version"):
        store.update_expected(docs, docs.where("id = 2").withColumn("version", F.lit(3).cast("long"))).collect()
    ok = store.update_expected(docs, docs.where("id = 2").withColumn("name", F.lit("z")))
    assert ok.where("id = 2").first().asDict() == {"id": 2, "name": "z", "version": 5} and ok.count() == 3


def test_append_checks_versions(spark):
    e = spark.createDataFrame([(1, "s", "a", 1), (2, "s", "b", 2)], "event_id long, user string, event_type string, version long")
    b = spark.createDataFrame([("s", "c", 1), ("t", "d", 2)], "user string, event_type string, place long")
    got = {tuple(r) for r in streams.append(e, b, "user", "event_id", "place", {"s": 2, "t": 0}).collect()}
    assert got == {(3, "s", "c", 3), (4, "t", "d", 1)}
    with pytest.raises(Exception, match="another version"):
        streams.append(e, b, "user", "event_id", "place", {"s": 1}).collect()
    with pytest.raises(Exception, match="exists already"):
        streams.append(e, b, "user", "event_id", "place", new_only=True).collect()


def test_patches_of_nulls_and_missing_arrays(spark):
    d = spark.range(1).select(F.struct(F.array(F.lit(1), F.lit(None), F.lit(2)).alias("a"), F.lit(None).cast("array<int>").alias("none")).alias("doc"))

    def one(c):
        return d.select(c.alias("doc")).first()["doc"]

    assert one(patching.append(F.col("doc"), "none", 7))["none"] is None
    assert one(patching.remove(F.col("doc"), "a", 2))["a"] == [1, None] and one(patching.remove(F.col("doc"), "a"))["a"] == [1, 2]
    assert one(patching.insert(F.col("doc"), "a", 9, 99))["a"] == [1, None, 2, 9]
    assert one(patching.append(F.col("doc"), "a", 5, if_absent=lambda x: x > 1))["a"] == [1, None, 2]


def test_pages_cover_null_keys(spark):
    rows = [(i, None if i % 3 == 0 else i % 4) for i in range(40)]
    d = spark.createDataFrame(rows, "id long, k int")
    for descending in (False, True):
        keys, token, seen = [("k", descending), ("id", False)], None, []
        while got := [r.asDict() for r in paging.seek(d, keys, token, 7).collect()]:
            seen += [r["id"] for r in got]
            token = paging.cursor(got[-1], keys)
        assert seen == [r["id"] for r in d.orderBy(ordering.by("k", descending), "id").collect()]
    with pytest.raises(ValueError):
        paging.seek(d, keys, "x", 3)


def test_web_style(spark):
    d = spark.createDataFrame([(0, "a quick lazy dog"), (1, "quick foo_bar"), (2, "b c"), (3, None)], "id int, t string")

    def hits(pred):
        return {r["id"] for r in d.where(pred).collect()}

    assert hits(text.web_style(F.col("t"), 'quick -"lazy dog"')) == {1}
    assert hits(text.web_style(F.col("t"), "a quick or b c")) == {0, 2}
    assert hits(text.all_terms(F.col("t"), "foo_bar")) == {1}
    assert hits(text.search(F.col("t"), "qui:* & !(lazy | c)")) == {1}
    with pytest.raises(ValueError):
        text.search(F.col("t"), "(a & b")


def test_fold_skips_poison_events(spark):
    e = spark.createDataFrame([(1, k, i) for i, k in enumerate(["x", "bad", "x", "x"])] + [(2, "bad", 9)], "user long, event_type string, event_id long")

    def apply(state, event):
        if event.event_type == "bad":
            raise pr.SkipEvent
        return {"user": event.user, "n": (state["n"] if state else 0) + 1}

    assert [tuple(r) for r in pr.fold_with(e, "user", "event_id", lambda k: None, apply, "user long, n long").collect()] == [(1, 3)]


def test_projection_merges_batches_and_replays(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    now = datetime.datetime(2024, 1, 1)
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    for part in range(3):
        rows = [(part * 10 + i, now, "ab"[i % 2], 1.0) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def fold(batch):
        return batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def run(at):
        q = live.project(live.event_stream(spark, src, schema, 1), fold, sink, str(tmp_path / at), ["event_type"], {"n": F.sum, "total": F.sum})
        q.awaitTermination(120)
        return {tuple(r) for r in live.read_model(spark, sink).collect()}

    assert run("one") == {("a", 15, 15.0), ("b", 15, 15.0)}
    # Another run from the start replays the batches under the same numbers; the result stays.
    assert run("two") == {("a", 15, 15.0), ("b", 15, 15.0)} and len(live.versions_of(spark, sink)) == 2
    live.rebuild(spark.read.schema(schema).parquet(src), fold, str(tmp_path / "anew"))
    assert {tuple(r) for r in live.read_model(spark, str(tmp_path / "anew")).collect()} == {("a", 15, 15.0), ("b", 15, 15.0)}


def test_session_tracking(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    none, same, dirty = (sessions.Session(t, m) for m in ("none", "identity", "dirty"))
    assert none.load(1) is not none.load(1)
    assert same.load(1) is same.load(1) and same.load(9) is None
    same.load(1)["name"] = "x"
    assert same.changes() == []
    dirty.load_many([2, 1])[0]["name"] = "x"
    dirty.store({"id": 3, "name": "c"})
    assert sorted(map(tuple, dirty.save().collect())) == [(1, "a"), (2, "x"), (3, "c")]
    assert dirty.changes() == []
    dirty.evict(1)
    assert dirty.load(1) == {"id": 1, "name": "a"}


def test_chunks_are_replaced_and_pruned(spark, tmp_path):
    t = spark.sql("SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id AS INT)) AS ts FROM range(20)")
    layout.write_chunks(t, str(tmp_path / "h"), "ts", 7)
    layout.write_chunks(t.where("id < 7").withColumn("id", F.col("id") + 100), str(tmp_path / "h"), "ts", 7)
    got = layout.read_chunks(spark, str(tmp_path / "h"))
    assert sorted(r.id for r in got.collect()) == [*range(7, 20), *range(100, 107)]
    late = layout.read_chunks(spark, str(tmp_path / "h"), since=F.lit("2024-01-08"), until=F.lit("2024-01-15"))
    assert sorted(r.id for r in late.collect()) == list(range(7, 14))
    kept = layout.retained(t.unionByName(spark.sql("SELECT 99L AS id, CAST(NULL AS timestamp_ntz) AS ts")), "ts", 7, F.lit("2024-01-14").cast("date"))
    assert sorted(r.id for r in kept.collect()) == [*range(7, 20), 99]


def test_flat_partial_mapping_updates_only(spark):
    e = spark.createDataFrame([(1, "a", "plus"), (2, "a", "new"), (3, "a", "plus"), (4, "b", "plus"), (5, "c", "new"), (6, "c", "gone"), (7, "c", "plus"), (8, None, "new")], "seq long, k string, event_type string")
    out = pr.flat_upsert(e, "k", "seq", {"n": pr.stepped(["new", "plus"])}, ["new"], ["plus"], ["gone"])
    assert [tuple(r) for r in out.collect()] == [("a", 1)]


def test_natural_keys(spark):
    e = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x"), (4, 2, None)], "seq long, stream long, code string")
    keys = pr.natural_keys(e, F.col("code"), "stream", "seq")
    assert sorted(map(tuple, keys.collect())) == [("x", 2), ("y", 1)]
    assert sorted(r.seq for r in pr.by_natural_key(e, keys, "x", "stream").collect()) == [3, 4]
    twice = e.unionByName(spark.createDataFrame([(5, 1, "x")], e.schema))
    with pytest.raises(Exception, match="natural key"):
        pr.natural_keys(twice, F.col("code"), "stream", "seq").collect()


def test_ids_and_hierarchies(spark):
    ids = [r.id for r in store.hilo(spark.range(250).withColumnRenamed("id", "v").repartition(3), 2, 10).collect()]
    assert len(set(ids)) == 250 and min(ids) > 20
    assert sessions.descendants({"a": None, "b": "a", "c": "b", "d": None}, "a") == ["a", "b", "c"]


def test_empty_tables_give_no_groups(spark):
    none = spark.createDataFrame([], "k long, v double")
    assert joins.with_any(none, "k", F.col("v") > 1).count() == joins.with_all(none, "k", F.col("v") > 1).count() == 0
    some = spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], none.schema)
    assert [r.k for r in joins.with_all(some, "k", F.col("v") > 1).collect()] == [2]


def test_page_after_null_has_all_rows(spark, tmp_path):
    from foldspark.plans import filters  # noqa: F401
    from foldspark.plans.registry import QUERIES

    columns = "id + 1 AS o_orderkey", "CAST(5 AS BIGINT) AS o_custkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "DATE'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority"
    spark.range(100_003).selectExpr(*columns).write.parquet(str(tmp_path / "orders.parquet"))
    assert QUERIES["page_after_null"](spark, str(tmp_path)).count() == 100_003
