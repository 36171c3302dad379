"""Registered queries: event-store reads and writes, folds, projections, tags, search and distances."""

from pyspark.sql import functions as F

from foldspark.functions import distance, text
from foldspark.operators import joins, store, streams
from foldspark.operators import projections as pr
from foldspark.plans.registry import query
from foldspark.sources.tables import table

c = F.col
V = "WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, (props::JSON->>'k')::INT AS k FROM events) "


def number():
    return F.get_json_object("props", "$.k").cast("int")


def noon():
    return F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")


#: A user's account: clicks, spendings, views, whether it has acted since its last view; gone after an error.
ACCOUNT = pr.Model(
    {
        "clicks": pr.counted("click"), "spent": lambda seq: F.round(pr.summed("value", "purchase")(seq), 4), "last_view": pr.newest("event_id", "view"),
        "first_view": pr.oldest("event_id", "view"), "active": pr.flagged(["signup", "purchase"], "view"),
    },
    create=["signup", "view"],
    deletes=["error"],
)
ACCOUNT_SQL = """count(*) FILTER (WHERE event_type = 'click') AS clicks, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent,
  max(event_id) FILTER (WHERE event_type = 'view') AS last_view, min(event_id) FILTER (WHERE event_type = 'view') AS first_view,
  coalesce(arg_max(event_type <> 'view', event_id) FILTER (WHERE event_type IN ('signup', 'purchase', 'view')), false) AS active, count(*) AS version"""
MADE = "HAVING count(*) FILTER (WHERE event_type IN ('signup', 'view')) > 0"


def cut_sql(key: str, rows: str = "v") -> str:
    """The events after each key's last error."""
    return f"l AS (SELECT {rows}.* FROM {rows} LEFT JOIN (SELECT {key} AS kk, max(event_id) AS gone FROM {rows} WHERE event_type = 'error' GROUP BY ALL) d ON d.kk = {rows}.{key} WHERE gone IS NULL OR event_id > gone) "


def fold_account(state, e):
    """The account of one user by a Python fold: clicks and purchases since the last error."""
    if e.event_type == "error":
        return None
    state = state or {"user_id": e.user_id, "clicks": 0, "last": None}
    return state | {"clicks": state["clicks"] + (e.event_type == "click"), "last": e.event_id}


def tags_of(events):
    """Tags of every event: its user's region and its price band."""
    region = events.select("event_id", F.lit("region").alias("tag"), (c("user_id") % 5).cast("string").alias("value"))
    band = events.where("value > 100").select("event_id", F.lit("band").alias("tag"), (c("event_id") % 3).cast("string").alias("value"))
    return region.unionByName(band)


def compacted(e):
    out = streams.compact(e, "user_id", "event_id", 5, 20, F.to_json(F.struct(F.count("*").alias("n"))), "props")
    return out.where("user_id = 5 and version <= 22").select("version", "event_type", F.get_json_object("props", "$.n").cast("int").alias("n"))


def appended(e):
    e = streams.versions(e, "user_id", "event_id").select("event_id", "user_id", "event_type", "version")
    batch = e.where("event_id % 4 = 1").select((c("user_id") + F.when(c("event_id") % 8 == 1, 0).otherwise(1000000)).alias("user_id"), "event_type", c("event_id").alias("place"))
    return e.unionByName(streams.append(e, batch, "user_id", "event_id", "place"))


def staged(e):
    """Accounts before and after the second half of the events, and what changed, counted by the second stage."""
    half = ACCOUNT.fold(e.where("event_id % 2 = 0"), "user_id", "event_id")
    return pr.changes(half, ACCOUNT.fold(e, "user_id", "event_id"), "user_id").groupBy("event_type").agg(F.count("*").alias("n"))


ORDER_MODEL = pr.Model({"n_child": pr.counted("item"), "n": pr.counted(["purchase", "click"])})

#: name: (query over events, the same in SQL, with ``v`` the events with versions and the number in their body).
QUERIES_ = {
    "load_event": (lambda e: e.where("event_id = 42").select("event_id", "event_type", "user_id"), "SELECT event_id, event_type, user_id FROM v WHERE event_id = 42"),
    "query_all_events": (lambda e: e.where((c("event_type") == "purchase") & (c("value") > 150)).select("event_id", "ts"), "SELECT event_id, ts FROM v WHERE event_type = 'purchase' AND value > 150"),
    "event_types_are": (lambda e: e.where(pr.of(["click", "signup"])).select("event_id"), "SELECT event_id FROM v WHERE event_type IN ('click', 'signup')"),
    "event_bodies": (lambda e: e.where("event_type = 'click'").select("event_id", F.from_json("props", "k INT").alias("b")).where("b.k < 20").select("event_id", "b.k"), "SELECT event_id, k FROM v WHERE event_type = 'click' AND k < 20"),
    "query_events_page": (
        lambda e: streams.query_events(e, ["view"], c("user_id") < 5, 2, 10).select("event_id", "total_rows"),
        "SELECT event_id, count(*) OVER () AS total_rows FROM v WHERE event_type = 'view' AND user_id < 5 ORDER BY event_id DESC LIMIT 10 OFFSET 10",
    ),
    "event_page": (lambda e: streams.event_page(e, 100, 700, 50, ["error", "view"]).select("event_id"), "SELECT event_id FROM v WHERE event_id > 100 AND event_id <= 700 AND event_type IN ('error', 'view') ORDER BY event_id LIMIT 50"),
    "event_statistics": (lambda e: streams.statistics(e, "user_id", "event_id"), "SELECT count(*) AS events, count(DISTINCT user_id) AS streams, max(event_id) AS sequence FROM v"),
    "fetch_stream_until": (
        lambda e: streams.fetch(e, 7, "user_id", until=noon(), from_version=3).select("event_id", "version"),
        "SELECT event_id, version FROM v WHERE user_id = 7 AND version >= 3 AND ts <= TIMESTAMP '2024-01-10 12:00:00'",
    ),
    "recent_streams": (lambda e: streams.state(e, "user_id").orderBy(F.desc("updated")).limit(10), "SELECT user_id, count(*) AS version, min(ts) AS created, max(ts) AS updated FROM v GROUP BY user_id ORDER BY updated DESC LIMIT 10"),
    "events_with_streams": (
        lambda e: e.where("event_type = 'signup'").join(streams.state(e, "user_id"), "user_id").select("event_id", "version", "created"),
        "SELECT event_id, s.version, s.created FROM v JOIN (SELECT user_id, count(*) AS version, min(ts) AS created FROM v GROUP BY user_id) s USING (user_id) WHERE event_type = 'signup'",
    ),
    "append_events": (
        appended,
        """SELECT event_id, user_id, event_type, version FROM v UNION ALL
        SELECT (SELECT max(event_id) FROM v) + row_number() OVER (ORDER BY place), user_id, event_type, coalesce((SELECT max(version) FROM v WHERE v.user_id = b.user_id), 0) + row_number() OVER (PARTITION BY user_id ORDER BY place)
        FROM (SELECT user_id + CASE WHEN event_id % 8 = 1 THEN 0 ELSE 1000000 END AS user_id, event_type, event_id AS place FROM v WHERE event_id % 4 = 1) b""",
    ),
    "archive_stream": (lambda e: store.scan(streams.archive(e, "user_id", [3, 4])).select("event_id"), "SELECT event_id FROM v WHERE user_id NOT IN (3, 4)"),
    "archived_events": (lambda e: store.scan(streams.archive(e, "user_id", [3, 4]), archived=True).select("event_id"), "SELECT event_id FROM v WHERE user_id IN (3, 4)"),
    "compact_stream": (
        compacted,
        """SELECT version, CASE WHEN version = 20 THEN 'compacted' ELSE event_type END AS event_type, CASE WHEN version = 20 THEN 20 END AS n FROM v WHERE user_id = 5 AND version BETWEEN 20 AND 22""",
    ),
    "overwrite_event": (
        lambda e: streams.overwrite(e, "event_id", 10, "props", '{"k": 1000}').select("event_id", number().alias("k")).where("k > 95"),
        "SELECT event_id, CASE WHEN event_id = 10 THEN 1000 ELSE k END AS k FROM v WHERE event_id = 10 OR k > 95",
    ),
    "mask_events": (
        lambda e: streams.mask(e, {"signup": lambda b: F.regexp_replace(b, "[0-9]+", "0"), "error": lambda b: F.lit("{}")}, "props", c("user_id") < 6).select("event_id", number().alias("k")),
        "SELECT event_id, CASE WHEN user_id < 6 AND event_type = 'signup' THEN 0 WHEN user_id < 6 AND event_type = 'error' THEN NULL ELSE k END AS k FROM v",
    ),
    "upcast_events": (
        lambda e: streams.upcast(e, {"click": ("tap", lambda b: b), "tap": ("touch", lambda b: F.concat(F.lit('{"k": '), (F.get_json_object(b, "$.k").cast("int") * 2).cast("string"), F.lit("}")))}, "props").where("event_type = 'touch'").select("event_id", number().alias("k")),
        "SELECT event_id, k * 2 AS k FROM v WHERE event_type = 'click'",
    ),
    "event_metadata": (lambda e: e.select("event_id", F.create_map(F.lit("user"), c("user_id").cast("string"), F.lit("kind"), c("event_type")).alias("headers")).where("headers['user'] = '3'").select("event_id", c("headers")["kind"].alias("kind")), "SELECT event_id, event_type AS kind FROM v WHERE user_id = 3"),
    "high_water_mark": (lambda e: streams.high_water(e.where("event_id <> 777 and event_id <> 900"), "event_id"), "SELECT CASE WHEN max(event_id) < 777 THEN max(event_id) ELSE 776 END AS mark FROM v"),
    "tenant_gaps": (
        lambda e: streams.gaps(e, "event_id", tenant="event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.max(c("before") - c("after")).alias("widest")),
        "SELECT event_type, count(*) AS n, max(before - after) AS widest FROM (SELECT event_type, event_id AS after, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM v) WHERE before > after + 1 GROUP BY event_type",
    ),
    "live_aggregate": (lambda e: pr.live(ACCOUNT, e, "user_id", 2, "event_id"), f", {cut_sql('user_id')} SELECT user_id, {ACCOUNT_SQL} FROM l WHERE user_id = 2 GROUP BY user_id {MADE}"),
    "live_aggregate_at_version": (
        lambda e: pr.live(ACCOUNT, streams.versions(e, "user_id", "event_id").drop("k"), "user_id", 2, "event_id", c("version") <= 9),
        f", w AS (SELECT * FROM v WHERE user_id = 2 AND version <= 9), {cut_sql('user_id', 'w')} SELECT user_id, {ACCOUNT_SQL} FROM l GROUP BY user_id {MADE}",
    ),
    "live_aggregate_at_time": (
        lambda e: pr.live(ACCOUNT, e, "user_id", 9, "event_id", c("ts") <= noon()),
        f", w AS (SELECT * FROM v WHERE user_id = 9 AND ts <= TIMESTAMP '2024-01-10 12:00:00'), {cut_sql('user_id', 'w')} SELECT user_id, {ACCOUNT_SQL} FROM l GROUP BY user_id {MADE}",
    ),
    "aggregate_as_json": (lambda e: ORDER_MODEL.fold(e.where("user_id = 4"), "user_id", "event_id").select(F.to_json(F.struct("user_id", "n", "version")).alias("data")), """SELECT '{"user_id":4,"n":' || count(*) FILTER (WHERE event_type IN ('purchase', 'click')) || ',"version":' || count(*) || '}' AS data FROM v WHERE user_id = 4"""),
    "single_stream_projection": (lambda e: ACCOUNT.fold(e, "user_id", "event_id"), f", {cut_sql('user_id')} SELECT user_id, {ACCOUNT_SQL} FROM l GROUP BY user_id {MADE}"),
    "python_fold": (
        lambda e: pr.fold_with(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", lambda k: None, fold_account, "user_id long, clicks long, last long"),
        f", {cut_sql('user_id')} SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, max(event_id) AS last FROM l GROUP BY user_id",
    ),
    "multi_stream_projection": (
        lambda e: pr.multi_stream(ACCOUNT, e.withColumn("k", number()), F.when(c("k") >= 10, c("k") % 10), "event_id", "digit"),
        f", w AS (SELECT *, k % 10 AS digit FROM v WHERE k >= 10), {cut_sql('digit', 'w')} SELECT digit, {ACCOUNT_SQL} FROM l GROUP BY digit {MADE}",
    ),
    "multi_stream_many_ids": (
        lambda e: pr.multi_stream(pr.Model({"clicks": pr.counted("click")}), e, F.array(c("user_id") % 3, c("user_id") % 4 + 100), "event_id"),
        "SELECT id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) AS version FROM (SELECT event_type, unnest([user_id % 3, user_id % 4 + 100]) AS id FROM v) GROUP BY id",
    ),
    "fan_out": (
        lambda e: ORDER_MODEL.fold(pr.fan_out(e, F.when(c("event_type") == "purchase", F.sequence(F.lit(1), c("event_id").cast("int") % 3 + 1)), "item", "event_id", "props"), "user_id", "event_id").select("user_id", "n_child", "n"),
        "SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN event_id % 3 + 1 ELSE 0 END)::BIGINT AS n_child, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS n FROM v GROUP BY user_id",
    ),
    "roll_up_by_tenant": (lambda e: streams.roll_up(e.withColumn("tenant_id", c("user_id") % 4), ["tenant_id"], ["view", "signup"]), "SELECT user_id % 4 AS tenant_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'signup') AS n_signup FROM v GROUP BY ALL"),
    "time_segments": (lambda e: pr.Model({"views": pr.counted("view")}).fold(e.withColumn("month", pr.months("ts")), ["user_id", "month"], "event_id"), "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) AS version FROM v GROUP BY ALL"),
    "composite_projection": (
        staged,
        f""", e0 AS (SELECT * FROM v WHERE event_id % 2 = 0), {cut_sql('user_id', 'e0').replace('l AS', 'l0 AS')}, {cut_sql('user_id')},
        a AS (SELECT user_id, {ACCOUNT_SQL} FROM l0 GROUP BY user_id {MADE}), b AS (SELECT user_id, {ACCOUNT_SQL} FROM l GROUP BY user_id {MADE})
        SELECT CASE WHEN b.user_id IS NULL THEN 'deleted' ELSE 'updated' END AS event_type, count(*) AS n FROM a FULL JOIN b ON a.user_id = b.user_id
        WHERE (a.clicks, a.spent, a.last_view, a.first_view, a.active, a.version) IS DISTINCT FROM (b.clicks, b.spent, b.last_view, b.first_view, b.active, b.version) GROUP BY 1""",
    ),
    "projection_timeline": (
        lambda e: pr.timeline(ORDER_MODEL, e, "user_id", 6, "event_id").select("event_id", "version", "n"),
        "SELECT event_id, version, count(*) FILTER (WHERE event_type IN ('purchase', 'click')) OVER (ORDER BY event_id) AS n FROM v WHERE user_id = 6",
    ),
    "projection_filters": (lambda e: ORDER_MODEL.fold(store.scan(streams.archive(e, "user_id", [1])).where(pr.of(["purchase", "click"])), "user_id", "event_id").select("user_id", "n"), "SELECT user_id, count(*) AS n FROM v WHERE user_id <> 1 AND event_type IN ('purchase', 'click') GROUP BY user_id"),
    "query_by_tags": (
        lambda e: joins.tagged(e, tags_of(e), [("region", "2", None), ("band", "1", "click")]).select("event_id"),
        "SELECT event_id FROM v WHERE user_id % 5 = 2 OR (value > 100 AND event_id % 3 = 1 AND event_type = 'click')",
    ),
    "events_exist_by_tags": (lambda e: joins.tagged(e, tags_of(e), [("band", "7", None)]).limit(1).agg((F.count("*") > 0).alias("found")), "SELECT count(*) > 0 AS found FROM v WHERE value > 100 AND event_id % 3 = 7"),
    "aggregate_by_tags": (
        lambda e: joins.tagged(e, tags_of(e), [("region", "1", None), ("region", "3", "purchase")]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")),
        "SELECT count(*) AS n, round(sum(value), 3) AS total FROM v WHERE user_id % 5 = 1 OR (user_id % 5 = 3 AND event_type = 'purchase')",
    ),
    "tag_versions": (lambda e: tags_of(e).groupBy("tag", "value").agg(F.max("event_id").alias("last")), "SELECT 'region' AS tag, (user_id % 5)::VARCHAR AS value, max(event_id) AS last FROM v GROUP BY ALL UNION ALL SELECT 'band', (event_id % 3)::VARCHAR, max(event_id) FROM v WHERE value > 100 GROUP BY ALL"),
}


def events_query(name, build, sql):
    query(name, V.rstrip() + (sql if sql.startswith(",") else " " + sql))(lambda spark, sf: build(table(spark, sf, "events")))


for name, (build, sql) in QUERIES_.items():
    events_query(name, build, sql)


@query("enriched_events", "SELECT event_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase'")
def enriched_events(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return pr.enriched(e, table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id"), "user_id", ["c_name"]).select("event_id", "c_name")


@query("natural_key_fetch", "SELECT event_id FROM events WHERE user_id = (SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007')")
def natural_key_fetch(spark, sf):
    keys = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    return joins.lookup(keys, "c_name", "Customer#000000007", table(spark, sf, "events"), "user_id").select("event_id")


WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
PADDED = f"(' ' || array_to_string({WORDS}, ' ') || ' ')"
#: name: (predicate over a text, the same in SQL).
SEARCHES = {
    "phrase_search": (lambda t: text.phrase(t, "under the"), f"contains({PADDED}, ' under the ')"),
    "prefix_search": (lambda t: text.prefix(t, "lic th"), f"contains({PADDED}, ' lic') AND contains({PADDED}, ' th')"),
    "web_style_search": (lambda t: text.web_style(t, 'license version or "the public" -work'), f"(contains({PADDED}, ' license ') AND contains({PADDED}, ' version ')) OR (contains({PADDED}, ' the public ') AND NOT contains({PADDED}, ' work '))"),
    "web_style_exclude_phrase": (lambda t: text.web_style(t, 'license -"apache license"'), f"contains({PADDED}, ' license ') AND NOT contains({PADDED}, ' apache license ')"),
    "tree_search": (lambda t: text.search(t, "license & (apache | creat:*) & !mit"), f"contains({PADDED}, ' license ') AND (contains({PADDED}, ' apache ') OR contains({PADDED}, ' creat')) AND NOT contains({PADDED}, ' mit ')"),
    "contains_literal": (lambda t: text.like_literal(t, "%", True), "contains(text, '%')"),
}


def text_search(name, pred, sql):
    query(name, f"SELECT doc_id FROM documents WHERE {sql}")(lambda spark, sf: table(spark, sf, "documents").where(pred(c("text"))).select("doc_id"))


for name, (pred, sql) in SEARCHES.items():
    text_search(name, pred, sql)


@query("ngram_rank", """SELECT p_partkey FROM (SELECT p_partkey, (contains(lower(p_name), 'wid')::INT + contains(lower(p_name), 'idg')::INT + contains(lower(p_name), 'dge')::INT + contains(lower(p_name), 'get')::INT) / 4 AS r FROM part)
    ORDER BY r DESC, p_partkey LIMIT 40""")
def ngram_rank(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc(text.gram_rank(c("p_name"), "widget")), "p_partkey").limit(40).select("p_partkey")


QUERY_VECTOR = [((i * 7) % 11 - 5) / 5 for i in range(64)]


def vector_query(name, measure, sql):
    ref = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]::DOUBLE[]"
    query(name, f"SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL ORDER BY {sql.format('embedding::DOUBLE[]', ref)}, vec_id LIMIT 15")(
        lambda spark, sf: distance.nearest(table(spark, sf, "embeddings"), "embedding", QUERY_VECTOR, 15, measure, "vec_id").select("vec_id")
    )


vector_query("vector_nearest_l2", "l2", "list_distance({}, {})")
vector_query("vector_nearest_cosine", "cosine", "list_cosine_distance({}, {})")
vector_query("vector_nearest_inner", "inner", "-list_inner_product({}, {})")

PLACES = "SELECT c_custkey AS id, (c_custkey * 37 % 180) - 90.0 AS lat, (c_custkey * 91 % 360) - 180.0 AS lon FROM customer"
RING = [(-100.0, -40.0), (60.0, -50.5), (120.0, 30.5), (10.0, 70.5), (-20.0, 0.5)]


def places(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS id", "CAST(c_custkey * 37 % 180 AS DOUBLE) - 90.0 AS lat", "CAST(c_custkey * 91 % 360 AS DOUBLE) - 180.0 AS lon")


HAVERSINE = "2 * 6371008.8 * asin(sqrt(pow(sin(radians({1} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({1})) * pow(sin(radians({0} - lon) / 2), 2)))"


@query("within_distance", f"SELECT id FROM ({PLACES}) WHERE {HAVERSINE.format(13.4, 52.5)} <= 3000000")
def within_distance(spark, sf):
    return places(spark, sf).where(distance.within(c("lat"), c("lon"), (52.5, 13.4), 3_000_000)).select("id")


@query("nearest_places", f"SELECT id FROM ({PLACES}) ORDER BY {HAVERSINE.format(13.4, 52.5)}, id LIMIT 12")
def nearest_places(spark, sf):
    return places(spark, sf).orderBy(distance.haversine(c("lat"), c("lon"), F.lit(52.5), F.lit(13.4)), "id").limit(12).select("id")


EDGES = " + ".join(f"(CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END)".replace("- -", "+ ") for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))


@query("contained_in_polygon", f"SELECT id FROM ({PLACES}) WHERE ({EDGES}) % 2 = 1")
def contained_in_polygon(spark, sf):
    return places(spark, sf).where(distance.in_polygon(c("lon"), c("lat"), RING)).select("id")


@query("intersecting_boxes", f"SELECT id FROM ({PLACES}) WHERE lat <= 20.5 AND lat + 10 >= 5 AND lon <= 40.5 AND lon + 15 >= 0")
def intersecting_boxes(spark, sf):
    meets = distance.boxes_meet((c("lon"), c("lat")), (c("lon") + 15, c("lat") + 10), (F.lit(0.0), F.lit(5.0)), (F.lit(40.5), F.lit(20.5)))
    return places(spark, sf).where(meets).select("id")


@query("continuous_aggregate", """SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL""")
def continuous_aggregate(spark, sf):
    """Hourly partial results, as they would be stored, finished to days: no second pass over the events."""
    hours = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    days = hours.groupBy(F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day"), "event_type")
    return days.agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))
