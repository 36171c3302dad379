"""Registered queries: writes, default filters, patches, includes and joins."""

from pyspark.sql import functions as F

from foldspark.operators import joins, patching, store
from foldspark.plans.registry import query
from foldspark.sources.fixtures import TARGET_SQL, target
from foldspark.sources.tables import table

c = F.col


def stored(spark, sf):
    """Customers as a stored table with the marks of deletion, tenancy and version."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "CAST(c_nationkey AS BIGINT) AS version", "c_custkey % 9 = 0 AS deleted",
        "CASE WHEN c_custkey % 9 = 0 THEN make_timestamp_ntz(2024, 1, 1 + CAST(c_custkey % 27 AS INT), 0, 0, 0) END AS deleted_at", "concat('t', c_custkey % 3) AS tenant_id",
        "make_timestamp_ntz(2024, 2, 1 + CAST(c_custkey % 28 AS INT), 0, 0, 0) AS modified_at",
    )


def batch(spark, sf):
    """Every third customer with another balance, and as many new ones with greater ids."""
    s = stored(spark, sf).where("id % 3 = 0")
    return s.withColumn("balance", c("balance") + 1).unionByName(s.withColumn("id", c("id") + 1000000))


S = """WITH s AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_nationkey::BIGINT AS version, c_custkey % 9 = 0 AS deleted,
  CASE WHEN c_custkey % 9 = 0 THEN make_timestamp(2024, 1, 1 + c_custkey % 27, 0, 0, 0) END AS deleted_at, 't' || (c_custkey % 3) AS tenant_id, make_timestamp(2024, 2, 1 + c_custkey % 28, 0, 0, 0) AS modified_at FROM customer),
b AS (SELECT id, name, balance + 1 AS balance, version FROM s WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, name, balance, version FROM s WHERE id % 3 = 0),
j AS (SELECT coalesce(s.id, b.id) AS id, s.id AS old, b.id AS new, s.balance AS t_balance, b.balance AS b_balance, s.version AS t_version, b.version AS b_version FROM s FULL JOIN b ON s.id = b.id) """
SHOW = ("id", "balance", "version")

#: name: (query over the stored table and the batch, the same in SQL over ``s``, ``b`` and their join ``j``).
STATES = {
    "bulk_ignore_duplicates": (lambda s, b: store.bulk(s, b, "ignore_duplicates").select(*SHOW), "SELECT id, coalesce(t_balance, b_balance) AS balance, coalesce(t_version, b_version) AS version FROM j"),
    "bulk_overwrite": (lambda s, b: store.bulk(s, b, "overwrite").select(*SHOW), "SELECT id, coalesce(b_balance, t_balance) AS balance, coalesce(b_version, t_version) AS version FROM j"),
    "bulk_overwrite_if_version": (
        lambda s, b: store.bulk(s, b.withColumn("version", c("version") + F.when(c("id") % 2 == 0, 1).otherwise(0)), "overwrite_if_version").select(*SHOW),
        """SELECT id, CASE WHEN old IS NULL THEN b_balance WHEN new IS NOT NULL AND id % 2 = 1 THEN b_balance ELSE t_balance END AS balance,
        CASE WHEN old IS NULL THEN b_version + (id % 2 = 0)::INT WHEN new IS NOT NULL AND id % 2 = 1 THEN t_version + 1 ELSE t_version END AS version FROM j""",
    ),
    "bulk_inserts_only": (lambda s, b: store.insert(s, b.where("id >= 1000000")).select(*SHOW), "SELECT id, balance, version FROM s UNION ALL SELECT id, balance, version FROM b WHERE id >= 1000000"),
    "store_upsert": (
        lambda s, b: store.upsert(s, b.unionByName(b.withColumn("balance", c("balance") - 5)), order=-c("balance")).select(*SHOW),
        "SELECT id, coalesce(b_balance - 5, t_balance) AS balance, CASE WHEN new IS NULL THEN t_version ELSE coalesce(t_version, 0) + 1 END AS version FROM j",
    ),
    "store_update": (lambda s, b: store.update(s, b.where("id < 1000000")).select(*SHOW), "SELECT id, coalesce(b_balance, t_balance) AS balance, coalesce(b_version, t_version) AS version FROM j WHERE id < 1000000"),
    "update_expected_version": (
        lambda s, b: store.update_expected(s, b.withColumn("version", c("version") + F.when(c("id") % 2 == 0, 1).otherwise(0)), tolerate=True).select(*SHOW),
        """SELECT id, CASE WHEN new IS NULL OR (old IS NOT NULL AND id % 2 = 0) THEN t_balance ELSE b_balance END AS balance,
        CASE WHEN new IS NULL OR (old IS NOT NULL AND id % 2 = 0) THEN t_version ELSE b_version + (id % 2 = 0)::INT + 1 END AS version FROM j""",
    ),
    "hard_delete_where": (lambda s, b: store.hard_delete(s, c("balance") < 0).select("id"), "SELECT id FROM s WHERE NOT balance < 0"),
    "soft_delete_where": (
        lambda s, b: store.soft_delete(s, c("balance") < 0, F.lit("2025-01-01").cast("timestamp_ntz")).select("id", "deleted", "deleted_at"),
        "SELECT id, deleted OR balance < 0 AS deleted, CASE WHEN deleted THEN deleted_at WHEN balance < 0 THEN TIMESTAMP '2025-01-01' END AS deleted_at FROM s",
    ),
    "undo_delete_where": (
        lambda s, b: store.undo_delete(s, c("id") % 2 == 0).select("id", "deleted", "deleted_at"),
        "SELECT id, deleted AND id % 2 = 1 AS deleted, CASE WHEN deleted AND id % 2 = 1 THEN deleted_at END AS deleted_at FROM s",
    ),
    "default_filters": (lambda s, b: store.scan(s, tenants="t1").select("id"), "SELECT id FROM s WHERE NOT deleted AND tenant_id = 't1'"),
    "maybe_deleted": (lambda s, b: store.scan(s, deleted=None, tenants="t0").select("id", "deleted"), "SELECT id, deleted FROM s WHERE tenant_id = 't0'"),
    "is_deleted": (lambda s, b: store.scan(s, deleted=True, tenants=None).select("id"), "SELECT id FROM s WHERE deleted"),
    "deleted_since": (lambda s, b: s.where(store.deleted_since(F.lit("2024-01-12").cast("timestamp_ntz"))).select("id"), "SELECT id FROM s WHERE deleted AND deleted_at > TIMESTAMP '2024-01-12'"),
    "deleted_before": (lambda s, b: s.where(store.deleted_before(F.lit("2024-01-12").cast("timestamp_ntz"))).select("id"), "SELECT id FROM s WHERE deleted AND deleted_at < TIMESTAMP '2024-01-12'"),
    "modified_since": (lambda s, b: s.where(store.modified_since(F.lit("2024-02-12").cast("timestamp_ntz"))).select("id"), "SELECT id FROM s WHERE modified_at > TIMESTAMP '2024-02-12'"),
    "modified_before": (lambda s, b: s.where(store.modified_before(F.lit("2024-02-12").cast("timestamp_ntz"))).select("id"), "SELECT id FROM s WHERE modified_at < TIMESTAMP '2024-02-12'"),
    "any_tenant": (lambda s, b: store.scan(s, tenants=None).groupBy("tenant_id").agg(F.count("*").alias("n")), "SELECT tenant_id, count(*) AS n FROM s WHERE NOT deleted GROUP BY tenant_id"),
    "tenant_is_one_of": (lambda s, b: store.scan(s, tenants=["t0", "t2"]).select("id"), "SELECT id FROM s WHERE NOT deleted AND tenant_id IN ('t0', 't2')"),
    "delete_tenant": (lambda s, b: store.delete_tenant(s, "t1").select("id"), "SELECT id FROM s WHERE tenant_id <> 't1'"),
    "select_with_version": (lambda s, b: store.scan(s, tenants="t1").select("id", "name", "version", "modified_at"), "SELECT id, name, version, modified_at FROM s WHERE NOT deleted AND tenant_id = 't1'"),
}


def state(name, build, sql):
    query(name, S + sql)(lambda spark, sf: build(stored(spark, sf), batch(spark, sf)))


for name, (build, sql) in STATES.items():
    state(name, build, sql)


#: name: (patch of the document ``doc``, what to show, the same in SQL over ``t``).
PATCHES = {
    "patch_nested_set": (lambda d: patching.set_value(d, "deep.word", "new"), {"word": "deep.word", "n": "deep.n"}, "'new' AS word, inner_.n AS n"),
    "patch_duplicate": (lambda d: patching.duplicate(d, "number", "copy", "deep.copy"), {"x": "copy", "y": "deep.copy"}, "number AS x, number AS y"),
    "patch_nested_increment": (lambda d: patching.increment(d, "deep.n", 5), {"n": "deep.n"}, "inner_.n + 5 AS n"),
    "patch_append": (lambda d: patching.append(d, "numbers", 7), {"numbers": "numbers"}, "CASE WHEN numbers IS NOT NULL THEN list_append(numbers, 7) END AS numbers"),
    "patch_append_if_absent": (lambda d: patching.append(d, "numbers", 2, True), {"numbers": "numbers"}, "CASE WHEN list_contains(numbers, 2) THEN numbers WHEN numbers IS NOT NULL THEN list_append(numbers, 2) END AS numbers"),
    "patch_insert": (lambda d: patching.insert(d, "numbers", 8, 1), {"numbers": "numbers"}, "CASE WHEN numbers IS NOT NULL THEN numbers[1:1] || [8] || numbers[2:] END AS numbers"),
    "patch_remove": (lambda d: patching.remove(d, "numbers", 4), {"numbers": "numbers"}, "list_filter(numbers, lambda x: x IS NULL OR x <> 4) AS numbers"),
    "patch_remove_where": (lambda d: patching.remove(d, "numbers", where=lambda x: x > 4), {"numbers": "numbers"}, "list_filter(numbers, lambda x: x IS NULL OR x <= 4) AS numbers"),
    "patch_put_entry": (lambda d: patching.put_entry(d, "dict", "z", 9), {"z": "dict.z", "a": "dict.a"}, "9 AS z, dict['a'] AS a"),
    "patch_remove_entry": (lambda d: patching.remove_entry(d, "dict", "a"), {"size": "size(doc.dict)", "b": "dict.b"}, "CASE WHEN cardinality(dict) = 0 THEN 0 ELSE 1 END AS size, dict['b'] AS b"),
    "patch_nested_rename": (lambda d: patching.rename(d, "deep.word", "label"), {"label": "label", "n": "deep.n"}, "lower(name) AS label, inner_.n AS n"),
    "patch_delete": (lambda d: patching.delete(d, "deep.n"), {"word": "deep.word"}, "lower(name) AS word"),
}


def patch(name, change, show, sql):
    shown = {k: v if "(" in v else f"try_element_at(doc.dict, '{v[5:]}')" if v.startswith("dict.") else f"doc.{v}" for k, v in show.items()}

    def build(spark, sf):
        return patching.patch(target(spark, sf).selectExpr("id", "struct(number, numbers, dict, inner AS deep) AS doc"), "doc", change).selectExpr("id", *[f"{v} AS {k}" for k, v in shown.items()])

    query(name, f"{TARGET_SQL}SELECT id, {sql} FROM t")(build)


for name, (change, show, sql) in PATCHES.items():
    patch(name, change, show, sql)


@query("patch_where", TARGET_SQL + "SELECT id, CASE WHEN number > 50 THEN number + 1 ELSE number END AS number FROM t")
def patch_where(spark, sf):
    t = target(spark, sf).select("id", F.struct("number").alias("doc"))
    return patching.patch(t, "doc", lambda d: patching.increment(d, "number"), "doc.number > 50").select("id", "doc.number")


@query("include_documents", """WITH p AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
    SELECT 'order' AS kind, o_orderkey AS id FROM p UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM p)""")
def include_documents(spark, sf):
    """A page of orders and each of its customers once, as one tagged result."""
    page = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_custkey")
    rows, found = joins.include(page, "o_custkey", table(spark, sf, "customer"), "c_custkey")
    return rows.select(F.lit("order").alias("kind"), c("o_orderkey").alias("id")).unionByName(found.select(F.lit("customer").alias("kind"), c("c_custkey").alias("id")))


@query("include_list_filtered", TARGET_SQL + "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2 AND n_nationkey IN (SELECT unnest(numbers) FROM t WHERE number < 20)")
def include_list_filtered(spark, sf):
    docs = target(spark, sf).where("number < 20")
    return joins.include(docs, "numbers", table(spark, sf, "nation"), "n_nationkey", c("n_regionkey") != 2)[1].select("n_nationkey", "n_name")


@query("include_dict", TARGET_SQL + "SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT unnest(map_values(dict)) FROM t WHERE number = 8)")
def include_dict(spark, sf):
    return joins.include(target(spark, sf).where("number = 8"), "dict", table(spark, sf, "region"), "r_regionkey")[1].select("r_regionkey", "r_name")


@query("join_where_after", "SELECT c_name, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'FURNITURE' AND o_totalprice > 300000")
def join_where_after(spark, sf):
    """A one-sided filter behind the join is pushed to its side's scan."""
    both = table(spark, sf, "customer").join(table(spark, sf, "orders"), c("c_custkey") == c("o_custkey"))
    return both.where("c_mktsegment = 'FURNITURE' and o_totalprice > 300000").select("c_name", "o_totalprice")


@query("join_aggregate", "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_aggregate(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    both = table(spark, sf, "customer").join(per, c("c_custkey") == c("o_custkey"))
    return both.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
