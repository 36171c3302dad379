"""Registered queries: partitions and chunks, compiled and batched queries, hierarchies, flat upserts, natural keys."""

from pyspark.sql import functions as F

from foldspark.operators import layout, sessions, store
from foldspark.operators import projections as pr
from foldspark.plans.registry import query
from foldspark.plans.writes import stored
from foldspark.sources.tables import table

c = F.col
#: Monday 3 January 2000 is the first chunk's first day.
CHUNK_SQL = "DATE '2000-01-03' + (floor(date_diff('day', DATE '2000-01-03', {0}::DATE) / {1}::DOUBLE) * {1})::INT"
WEEK = CHUNK_SQL.format("ts", 7)


@query("partition_by_hash", "SELECT ('0x' || substr(md5(o_custkey::VARCHAR), 1, 8))::BIGINT % 16 AS part, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY part")
def partition_by_hash(spark, sf):
    part = layout.hash_partition(c("o_custkey"), 16).cast("bigint").alias("part")
    return table(spark, sf, "orders").groupBy(part).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


@query("partition_by_list", "SELECT CASE WHEN o_orderstatus IN ('F') THEN 'done' WHEN o_orderstatus IN ('O') THEN 'open' ELSE 'default' END AS part, count(*) AS n FROM orders GROUP BY part")
def partition_by_list(spark, sf):
    part = layout.list_partition(c("o_orderstatus"), {"done": ["F"], "open": ["O"]}).alias("part")
    return table(spark, sf, "orders").groupBy(part).agg(F.count("*").alias("n"))


@query("partition_by_range", "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 'low' WHEN o_totalprice >= 50000 AND o_totalprice < 200000 THEN 'mid' ELSE 'default' END AS part, count(*) AS n FROM orders GROUP BY part")
def partition_by_range(spark, sf):
    part = layout.range_partition(c("o_totalprice"), {"low": (0, 50000), "mid": (50000, 200000)}).alias("part")
    return table(spark, sf, "orders").groupBy(part).agg(F.count("*").alias("n"))


@query("partition_rolling", f"""SELECT part, count(*) AS n FROM (SELECT CASE WHEN chunk BETWEEN here - 14 AND here + 7 THEN chunk END AS part
  FROM (SELECT {WEEK} AS chunk, {CHUNK_SQL.format("DATE '2024-01-17'", 7)} AS here FROM events)) GROUP BY part""")
def partition_rolling(spark, sf):
    part = layout.rolling(c("ts"), F.lit("2024-01-17").cast("date"), 7, 2, 1).alias("part")
    return table(spark, sf, "events").groupBy(part).agg(F.count("*").alias("n"))


@query("hypertable_chunks", f"SELECT {WEEK} AS starts, {WEEK} + 7 AS ends, count(*) AS n, min(ts) AS least, max(ts) AS greatest FROM events GROUP BY ALL")
def hypertable_chunks(spark, sf):
    return layout.chunks(table(spark, sf, "events"), "ts", 7)


@query("hypertable_retention", f"SELECT event_id FROM events WHERE ts IS NULL OR {WEEK} + 7 > DATE '2024-01-17'")
def hypertable_retention(spark, sf):
    return layout.retained(table(spark, sf, "events"), "ts", 7, F.lit("2024-01-17").cast("date")).select("event_id")


ORDERS_OF = sessions.Compiled("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = :customer AND o_totalprice >= :least ORDER BY o_orderkey LIMIT :most")


@query("compiled_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice >= 1000 ORDER BY o_orderkey LIMIT 5")
def compiled_query(spark, sf):
    return ORDERS_OF.run(spark, {"orders": table(spark, sf, "orders")}, customer=7, least=1000, most=5)


@query("compiled_query_again", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 13 AND o_totalprice >= 50000 ORDER BY o_orderkey LIMIT 2")
def compiled_query_again(spark, sf):
    return ORDERS_OF.run(spark, {"orders": table(spark, sf, "orders")}, customer=13, least=50000, most=2)


def several(spark, sf):
    orders = table(spark, sf, "orders")
    return {
        "by_customer": orders.where("o_custkey = 7").select("o_orderkey"), "count": orders.agg(F.count("*").alias("n")),
        "greatest": orders.agg(F.max("o_orderkey").alias("n")), "none": orders.where("o_custkey < 0").select("o_orderkey"),
    }


@query("batched_queries", """SELECT 'by_customer' AS query, '{"o_orderkey":' || o_orderkey || '}' AS row FROM orders WHERE o_custkey = 7
  UNION ALL SELECT 'count', '{"n":' || count(*) || '}' FROM orders UNION ALL SELECT 'greatest', '{"n":' || max(o_orderkey) || '}' FROM orders""")
def batched_queries(spark, sf):
    return sessions.batch(several(spark, sf))


@query("batched_answer", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def batched_answer(spark, sf):
    parts = several(spark, sf)
    return sessions.answers(sessions.batch(parts), parts)["by_customer"]


@query("query_plan", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000")
def query_plan(spark, sf):
    rich = sessions.query_plan(lambda t, nation, least: t.where((c("c_nationkey") == nation) & (c("c_acctbal") > least)), least=1000)
    return rich(table(spark, sf, "customer"), nation=3).select("c_custkey")


@query("session_dirty", "SELECT c_custkey AS id, CASE WHEN c_custkey = 3 THEN 0.5 ELSE c_acctbal END AS balance, c_nationkey::BIGINT + (c_custkey = 3)::INT AS version FROM customer")
def session_dirty(spark, sf):
    s = sessions.Session(stored(spark, sf), "dirty")
    s.load_many([3, 4, 3])[0]["balance"] = 0.5
    return s.save().select("id", "balance", "version")


#: Kinds of users and each one's parent.
KINDS = {"user": None, "staff": "user", "admin": "staff", "guest": "user", "machine": None}


def people(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (c("c_custkey") % len(KINDS) + 1).cast("int"))
    return table(spark, sf, "customer").select(c("c_custkey").alias("id"), kind.alias("doc_type"))


@query("hierarchy_of_type", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 IN (1, 2)")
def hierarchy_of_type(spark, sf):
    return sessions.of_type(people(spark, sf), KINDS, "staff").select("id")


@query("hierarchy_root", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 < 4")
def hierarchy_root(spark, sf):
    return sessions.of_type(people(spark, sf), KINDS, "user").select("id")


@query("hilo_ids", "SELECT count(*) AS n, count(*) AS ids, true AS above FROM customer")
def hilo_ids(spark, sf):
    given = store.hilo(table(spark, sf, "customer").select("c_name"), 7, 100)
    return given.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.min("id") > 700).alias("above"))


LIVE = """WITH d AS (SELECT user_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY user_id),
l AS (SELECT e.* FROM events e LEFT JOIN d USING (user_id) WHERE event_type <> 'view' AND user_id IS NOT NULL AND (gone IS NULL OR event_id > gone)),
m AS (SELECT user_id, min(event_id) AS made FROM l WHERE event_type IN ('signup', 'click') GROUP BY user_id) """


@query("flat_partial_mapping", f"""{LIVE} SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent,
  arg_max(value, event_id) FILTER (WHERE event_type = 'signup') AS joined, count(*) FILTER (WHERE event_type = 'click' AND event_id > made) AS clicks
  FROM l JOIN m USING (user_id) WHERE event_id >= made GROUP BY user_id""")
def flat_partial_mapping(spark, sf):
    columns = {"spent": lambda seq: F.round(pr.summed("value", "purchase")(seq), 4), "joined": pr.newest("value", "signup"), "clicks": pr.stepped("click")}
    return pr.flat_upsert(table(spark, sf, "events"), "user_id", "event_id", columns, ["signup", "click"], ["purchase"], ["error"])


def named(events):
    """Users' natural keys: each signup names one after the user and its own number."""
    code = F.when(c("event_type") == "signup", F.concat_ws("-", c("user_id").cast("string"), c("event_id").cast("string")))
    return pr.natural_keys(events, code, "user_id", "event_id")


@query("natural_key_table", "SELECT user_id || '-' || max(event_id) AS natural_key, user_id FROM events WHERE event_type = 'signup' GROUP BY user_id")
def natural_key_table(spark, sf):
    return named(table(spark, sf, "events"))


@query("natural_key_stream", "SELECT event_id FROM events WHERE user_id = 5")
def natural_key_stream(spark, sf):
    events = table(spark, sf, "events")
    keys = named(events).withColumn("natural_key", F.substring_index("natural_key", "-", 1))
    return pr.by_natural_key(events, keys, "5", "user_id").select("event_id")


@query("tags_assigned", """SELECT event_id, 'band' AS tag, 'high' AS value FROM events WHERE value > 100
  UNION SELECT event_id, 'band', 'high' FROM events WHERE event_type = 'purchase'""")
def tags_assigned(spark, sf):
    events = table(spark, sf, "events")
    tags = events.where("value > 100").select("event_id", F.lit("band").alias("tag"), F.lit("high").alias("value"))
    return pr.assign_tags(tags, events, c("event_type") == "purchase", "band", F.lit("high"))


@query("progress_repaired", """SELECT n_name AS name, CASE WHEN n_name = 'HighWaterMark' THEN top ELSE least(last, top) END AS last_seq
  FROM (SELECT n_name, n_nationkey * 50 AS last FROM nation UNION ALL SELECT 'HighWaterMark', 0), (SELECT max(event_id) AS top FROM events)""")
def progress_repaired(spark, sf):
    rows = table(spark, sf, "nation").selectExpr("n_name AS name", "CAST(n_nationkey * 50 AS BIGINT) AS last_seq")
    progress = rows.unionByName(spark.range(1).selectExpr("'HighWaterMark' AS name", "CAST(0 AS BIGINT) AS last_seq"))
    return pr.repaired_progress(progress, table(spark, sf, "events"), "event_id")
