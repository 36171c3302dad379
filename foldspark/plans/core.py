"""Registered queries over the driver's tables, one or more per operator family."""

from pyspark.sql import functions as F

from foldspark.functions import distance, text
from foldspark.operators import documents as docs
from foldspark.operators import joins, paging, patching, streams
from foldspark.plans.registry import query
from foldspark.sources.tables import table


@query(
    "scan_filter_project",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000",
)
def scan_filter_project(spark, sf):
    t = table(spark, sf, "orders")
    return t.where((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


@query(
    "revenue_by_nation",
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def revenue_by_nation(spark, sf):
    """Aggregated by customer before the join, so one row per customer meets the nations."""
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = per.join(c, per.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("revenue"))


@query(
    "distinct_by",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def distinct_by(spark, sf):
    t = table(spark, sf, "events")
    return docs.distinct_by(t, ["user_id"], F.col("event_id"), latest=True).select("user_id", "event_id", "event_type")


def q(name, sql, build):
    """Register a one-expression query over the scan function ``t``."""
    query(name, sql)(lambda spark, sf: build(lambda n: table(spark, sf, n)))


q("load_many", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9)", lambda t: t("customer").where(F.col("c_custkey").isin(1, 5, 9)).select("c_custkey", "c_name"))
q("exists_by_id", "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 7", lambda t: t("customer").where("c_custkey = 7").limit(1).agg((F.count("*") > 0).alias("found")))
q("modulo", "SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3", lambda t: t("orders").where(F.col("o_custkey") % 7 == 3).select("o_orderkey"))
q("not_one_of", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('P', 'F')", lambda t: t("orders").where(~F.col("o_orderstatus").isin("P", "F")).select("o_orderkey"))
q("string_predicates", "SELECT p_partkey, upper(p_name) AS name FROM part WHERE (p_name ILIKE '%ring%' OR p_name LIKE 'red%') AND NOT p_type LIKE '%Y'", lambda t: t("part").where((F.col("p_name").ilike("%ring%") | F.col("p_name").startswith("red")) & ~F.col("p_type").endswith("Y")).select("p_partkey", F.upper("p_name").alias("name")))
q("regex_match", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)brand#1[0-5]$')", lambda t: t("part").where(F.col("p_brand").rlike("(?i)brand#1[0-5]$")).select("p_partkey"))
q("json_member", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE (props::JSON->>'k')::INT > 50", lambda t: t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k > 50"))
q("group_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12", lambda t: t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).where("n > 12"))
q("group_filtered_count", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events GROUP BY user_id", lambda t: t("events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean")))
q("distinct_count", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)", lambda t: t("orders").select("o_custkey", "o_orderstatus").distinct().agg(F.count("*").alias("n")))
q("group_join_left", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", lambda t: t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey"))
q("include_related", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda t: t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name"))
q("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda t: t("customer").join(t("orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"))
q("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50", lambda t: paging.page(t("orders").select("o_orderkey", "o_totalprice"), 3, 25, F.desc("o_totalprice"), "o_orderkey"))
q("page_keyset", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 40 OR (o_custkey = 40 AND o_orderkey > 100) ORDER BY o_custkey DESC, o_orderkey LIMIT 20", lambda t: paging.after(t("orders").select("o_orderkey", "o_custkey"), [("o_custkey", True), ("o_orderkey", False)], {"o_custkey": 40, "o_orderkey": 100}, 20))
q("full_text_all_terms", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), ['the', 'on'])", lambda t: t("documents").where(text.all_terms(F.col("text"), "the on")).select("doc_id"))
q("ngram_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%rin%' AND lower(p_name) LIKE '%ing%'", lambda t: t("part").where(text.has_grams(F.col("p_name"), "ring")).select("p_partkey"))
q("time_buckets", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL", lambda t: t("events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n"))
q("stream_state", "SELECT user_id, count(*) AS version, min(ts) AS created, max(ts) AS updated FROM events GROUP BY user_id", lambda t: t("events").groupBy("user_id").agg(F.count("*").alias("version"), F.min("ts").alias("created"), F.max("ts").alias("updated")))
q("fetch_stream", "SELECT event_id, version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events) WHERE user_id = 5 AND version <= 10", lambda t: streams.fetch(t("events"), 5, "user_id", version=10).select("event_id", "version"))
q("sequence_gaps", "SELECT after, before FROM (SELECT s AS after, lead(s) OVER (ORDER BY s) AS before FROM (SELECT event_id + event_id // 7 * 3 AS s FROM events)) WHERE before > after + 1", lambda t: streams.gaps(t("events").selectExpr("event_id + event_id div 7 * 3 AS s"), "s"))
q("roll_up", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error FROM events GROUP BY user_id", lambda t: streams.roll_up(t("events"), ["user_id"], ["click", "error"]))
q("flat_table", "WITH l AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'error') AS c FROM events GROUP BY user_id) SELECT e.user_id, round(sum(CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE 0 END), 4) AS total, count(*) AS revision FROM events e JOIN l USING (user_id) WHERE c IS NULL OR event_id > c GROUP BY e.user_id", lambda t: streams.flat_table(t("events"), "user_id", "event_id", ["click"], ["view"], ["error"]))
q("vector_nearest", "WITH o AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id FROM embeddings, o ORDER BY list_cosine_distance(embedding::DOUBLE[], e::DOUBLE[]), vec_id LIMIT 10", lambda t: t("embeddings").crossJoin(F.broadcast(t("embeddings").where("vec_id = 0").limit(1).select(F.col("embedding").alias("e")))).orderBy(distance.cosine(F.col("embedding"), F.col("e")), "vec_id").limit(10).select("vec_id"))


@query("child_any", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'R'")
def child_any(spark, sf):
    return joins.with_any(table(spark, sf, "lineitem"), "l_orderkey", (F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R"))


@query("child_all", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_quantity > 20)")
def child_all(spark, sf):
    return joins.with_all(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_quantity") > 20)


@query("child_count_sum", "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey")
def child_count_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_quantity") > 25, 1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("select_many", "SELECT l_orderkey, l_linenumber AS line, l_quantity AS qty FROM lineitem WHERE l_quantity > 45")
def select_many(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))


@query("patch_document", "SELECT c_custkey, 'VIP' AS segment, c_acctbal + 10 AS balance FROM customer WHERE c_nationkey = 3")
def patch_document(spark, sf):
    doc = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    doc = patching.rename(patching.increment(patching.set_value(doc, "segment", "VIP"), "bal", 10), "bal", "balance")
    return table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey", doc.alias("d")).select("c_custkey", "d.*")
