"""Queries over keyed tables: upserts, selections, registries, caches and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, table
from webplan.catalog.fields import SQ_RAW, raw_candidates, ts_micros
from webplan.session import shared_folder
from webplan.sources import tables as S

CUT = 1705363200000000  # 2024-01-16 in microseconds
KEYS = ["project_id", "url_norm", "viewport"]


def analyses(spark, d):
    """events as stored page analyses: before the cut they are the base, after it the updates."""
    e = table(spark, d, "events").withColumn("us", ts_micros())
    sel = F.when(F.col("event_type") != "view", F.concat(F.lit("s"), "event_id"))
    rows = e.select((F.col("user_id") % 5).cast("string").alias("project_id"), F.get_json_object("props", "$.k").alias("url_norm"), F.when(F.col("user_id") % 2 == 0, F.lit("mo")).otherwise(F.lit("pc")).alias("viewport"),
                    F.concat(F.lit("p"), "event_id").alias("payload"), F.col("event_type").alias("page_name"), sel.alias("selection"), "us", F.timestamp_micros("us").alias("updated_at"), F.col("event_id").alias("seq"))
    return rows.filter(F.col("us") < CUT).drop("us"), rows.filter(F.col("us") >= CUT).drop("us")


@query("upsert_page_analyses", """WITH e AS (SELECT (user_id % 5)::VARCHAR AS project_id, json_extract_string(props, '$.k') AS url_norm, CASE WHEN user_id % 2 = 0 THEN 'mo' ELSE 'pc' END AS viewport, event_id, event_type, ts FROM events)
  SELECT project_id, url_norm, viewport, arg_max('p' || event_id, ts) AS payload, arg_max(event_type, ts) AS page_name, arg_max('s' || event_id, ts) FILTER (event_type <> 'view') AS selection, count(*) AS versions FROM e GROUP BY 1, 2, 3""")
def _(spark, d):
    return S.upsert_page_analyses(*analyses(spark, d)).drop("updated_at")


@query("patch_selection_map", """WITH e AS (SELECT user_id::VARCHAR AS page_key, json_extract_string(props, '$.k') AS k, value >= 10 AS v, event_id FROM events),
  l AS (SELECT page_key, k, arg_max(v, event_id) AS v FROM e GROUP BY 1, 2) SELECT page_key, count(*)::INT AS entries, count_if(v)::INT AS selected FROM l GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events")
    m = e.select(F.col("user_id").cast("string").alias("page_key"), F.create_map(F.get_json_object("props", "$.k"), F.col("value") >= 10).alias("selection"), F.col("event_id").alias("seq"))
    base = m.select("page_key").distinct().withColumn("selection", F.lit(None).cast("map<string,boolean>"))
    out = S.patch_selection_map(base, m)
    return out.select("page_key", F.size("selection").alias("entries"), F.size(F.filter(F.map_values("selection"), lambda v: v)).alias("selected"))


@query("merge_selection", SQ_RAW + " SELECT page_id AS page_key, tag_id, tag_id % 3 <> 0 AS selected FROM cand")
def _(spark, d):
    r = raw_candidates(spark, d).select(F.col("page_id").alias("page_key"), "tag_id")
    return S.merge_selection(r.filter("tag_id % 3 = 0").withColumn("selected", F.lit(False)), r)


@query("registry_with_defaults", "SELECT user_id::VARCHAR AS name, CASE WHEN user_id % 3 = 0 THEN 'stored' ELSE 'default' END AS meaning FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    n = table(spark, d, "events").select("user_id", F.col("user_id").cast("string").alias("name")).distinct()
    return S.registry_with_defaults(n.filter("user_id % 6 <> 0").select("name", F.lit("default").alias("meaning")), n.filter("user_id % 3 = 0").select("name", F.lit("stored").alias("meaning")))


@query("explode_description_json", """SELECT c_custkey, 'event' AS kind, c_name AS key, 't' AS trigger, c_mktsegment AS description FROM customer UNION ALL SELECT c_custkey, 'property', 'platform', NULL, c_mktsegment FROM customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    body = F.concat(F.lit('{"events":{"'), "c_name", F.lit('":{"trigger":"t","description":"'), "c_mktsegment", F.lit('","note":"n"}},"properties":{"platform":{"description":"'), "c_mktsegment", F.lit('"}}}'))
    return S.explode_description_json(c.select("c_custkey", body.alias("body"))).select("c_custkey", "kind", "key", "trigger", "description")


@query("cache_split", PAGES_U + """, a AS (SELECT DISTINCT page_key, viewport FROM u WHERE length(page_key) % 3 <> 0), f AS (SELECT page_key, length(page_key) % 5 = 0 AS by_url, length(page_key) % 7 = 0 AS by_view FROM u)
  SELECT page_id, CASE WHEN a.page_key IS NULL OR length(u.page_key) % 5 = 0 OR length(u.page_key) % 7 = 0 THEN false ELSE true END AS cached,
   CASE WHEN NOT (a.page_key IS NULL OR length(u.page_key) % 5 = 0 OR length(u.page_key) % 7 = 0) THEN CASE WHEN page_id % 2 = 0 THEN 'alias' ELSE 'stored' END END AS page_name FROM u LEFT JOIN a ON a.page_key = u.page_key AND a.viewport = u.viewport""")
def _(spark, d):
    from webplan.sources.pages import with_site

    p = with_site(table(spark, d, "pages").select("page_id", "url")).select("page_id", F.col("page_key").alias("url_norm"), "viewport", F.when(F.col("page_id") % 2 == 0, F.lit("alias")).otherwise(F.lit(" ")).alias("alias"))
    n = F.length("url_norm")
    known = p.filter(n % 3 != 0).select("url_norm", "viewport").distinct().withColumn("page_name", F.lit("stored"))
    none = F.lit(None).cast("string")
    forced = p.filter(n % 5 == 0).select("url_norm", none.alias("viewport")).unionByName(p.filter(n % 7 == 0).select("url_norm", "viewport"))
    return S.cache_split(p, known, forced).select("page_id", "cached", "page_name")


@query("valid_sessions", "SELECT o_orderkey AS session_id, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate + INTERVAL 14 DAY > DATE '1995-06-17'")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.date_add(F.col("o_orderdate").cast("date"), 14).alias("expires_at"))
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return S.valid_sessions(o, u, F.lit("1995-06-17").cast("date")).select("session_id", "c_name")


@query("latest_per_key", "SELECT o_custkey, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return S.latest_per_key(o, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("merge_discovered", "SELECT user_id::VARCHAR AS url, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS title, arg_max(props, event_id) AS description FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("title"), F.col("props").alias("description"), F.col("event_id").alias("seq"))
    # one earlier row per address, the others arrive later
    first = e.groupBy("url").agg(F.min("seq").alias("seq"))
    old = e.join(first, ["url", "seq"])
    return S.merge_discovered(old, e.join(first, ["url", "seq"], "left_anti"), ["title", "description"])


@query("user_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_custkey)::INT AS rank FROM customer")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = S.user_sort(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_mktsegment", False, "c_custkey")
    place = W.partitionBy("c_nationkey").orderBy(F.desc("c_mktsegment"), "c_custkey")
    return rows.select("c_custkey", F.row_number().over(place).alias("rank"))


@query("recent_projects", "SELECT o_orderkey AS project_id FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").alias("project_id"), F.col("o_orderdate").alias("updated_at"))
    return S.recent_projects(o, "7").select("project_id")


@query("top_n", "SELECT l_suppkey, l_orderkey, l_linenumber::INT AS l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 8")
def _(spark, d):
    from webplan.operators.links import top_n

    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return top_n(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8, F.col("l_orderkey")).select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("int"))


def scratch(spark):
    """Folder for files a query writes and reads back: shared on a cluster, local in tests."""
    return f"{shared_folder(spark)}/webplan-{uuid.uuid4().hex}"


@query("positions_files", SQ_RAW + " SELECT page_id::VARCHAR AS job_id, viewport, tag_id, x FROM (SELECT *, CASE WHEN boxed THEN x END AS x1 FROM cand) WHERE boxed")
def _(spark, d):
    r = raw_candidates(spark, d).filter("bbox is not null").select(F.col("page_id").cast("string").alias("job_id"), "viewport", F.col("url").alias("page_url"), "tag_id", F.lit("a").alias("selector_hint"), "bbox", "platform", "hidden_reason", "text")
    path = scratch(spark)
    S.write_positions(r, path, job_folders=False)  # every page is a job here
    return S.read_positions(spark, path).select("job_id", "viewport", "tag_id", "bbox.x")


@query("latest_snapshot", "SELECT event_type AS site_key, arg_max(event_id, ts) AS seq FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("site_key"), F.date_format(F.timestamp_micros(ts_micros()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("saved_at"), F.col("event_id").alias("seq"), "props")
    path = scratch(spark)
    S.append_snapshot(e, path)
    return S.latest_snapshot(spark.read.parquet(path)).select("site_key", "seq")


@query("assemble_spec", """SELECT (user_id % 10)::VARCHAR AS session_id, count(DISTINCT event_type)::INT AS screens, count(DISTINCT event_type || '|' || json_extract_string(props, '$.k'))::INT AS events FROM events GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("session_id"), F.col("event_type").alias("screen_id"), F.get_json_object("props", "$.k").alias("stable_key"))
    ev = e.distinct().select("*", F.concat("screen_id", "stable_key").alias("event_id"), F.lit("click").alias("event_name"))
    sc = e.select("session_id", "screen_id").distinct().select("*", F.col("screen_id").alias("screen_name"), F.lit("*").alias("page_url_pattern"), F.lit("route").alias("detected_by"))
    out = S.assemble_spec(sc, ev)
    doc = F.from_json("spec", "screens array<struct<screen_id:string,events:array<struct<stable_key:string>>>>")
    return out.select("session_id", doc.alias("d")).select("session_id", F.size("d.screens").alias("screens"), F.aggregate("d.screens", F.lit(0), lambda n, x: n + F.size(x["events"])).alias("events"))
