"""Queries over failures, statistics, captures and job progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, s, table
from webplan.catalog.fields import BOX, SQ_ISSUE, SQ_RAW, candidates, raw_candidates, ts_micros
from webplan.catalog.naming import pick, sq_pick
from webplan.functions import geometry as G
from webplan.functions import urls as U
from webplan.operators import quality as Q

MESSAGES = [
    "LOGIN_REQUIRED|http://a/x|http://a/login", "페이지에 로그인 필요", "Deno REPL exited", "Execution timed out after 300s", "중단됨", "job cancelled",
    "concurrencyLimited", "Target page has been closed", "openrouter 500", "firecrawl scrape failed", "budget exceeded", "", "net::ERR timeout", "LLM extract",
]
MOVES = ["", "/login", "/myshop/orders", "?next=/auth"]


@query("redirect_check", PAGES_U + """, m AS (SELECT page_id, origin || '/myshop' AS e, origin || list_extract(['/', '/login', '/myshop/orders', '/home?x=1'], page_id % 4 + 1) AS c,
   'https://other.example' || list_extract(['', '/login', '/x', '/sso/'], page_id % 4 + 1) AS o, page_id % 4 AS k FROM u)
  SELECT page_id, list_extract(['member_redirect', 'auth_redirect', NULL, 'member_redirect'], k + 1) AS same_host, list_extract(['external_redirect', 'auth_redirect', 'external_redirect', 'auth_redirect'], k + 1) AS other_host,
   NULL::VARCHAR AS upgraded FROM m""")
def _(spark, d):
    p = table(spark, d, "pages")
    origin = U.with_url(F.col("url"), lambda u: u["origin"])
    rows = p.select("page_id", origin.alias("o"), (F.col("page_id") % 4).alias("k"))
    at = lambda vs: F.element_at(F.array(*[F.lit(v) for v in vs]), (F.col("k") + 1).cast("int"))
    e = F.concat("o", F.lit("/myshop"))
    return rows.select(
        "page_id", Q.redirect_check(e, F.concat("o", at(["/", "/login", "/myshop/orders", "/home?x=1"]))).alias("same_host"),
        Q.redirect_check(e, F.concat(F.lit("https://other.example"), at(["", "/login", "/x", "/sso/"]))).alias("other_host"),
        Q.redirect_check(F.lit("http://www.a.com/x"), F.lit("https://a.com/y/")).alias("upgraded"))


SQ_MSG = "WITH m AS (SELECT event_id, " + sq_pick(MESSAGES, 1) + " AS msg, event_id % 3 = 0 AS member FROM events)"


@query("failure_kind", SQ_MSG + """, k AS (SELECT *, list_extract(['login_required','login_required','session_dead','timeout','cancelled','cancelled','session_dead','session_dead','other','other','other','other','timeout','other'], (event_id % 14 + 1)::INT) AS base FROM m)
  SELECT event_id, CASE WHEN member AND base IN ('session_dead', 'timeout') THEN 'login_required' ELSE base END AS kind FROM k""")
def _(spark, d):
    url = F.when(F.col("event_id") % 3 == 0, F.lit("https://a.com/myshop/x")).otherwise(F.lit("https://a.com/x"))
    return table(spark, d, "events").select("event_id", Q.failure_kind(pick(MESSAGES, 1), url).alias("kind"))


@query("failure_reason", SQ_MSG + """ SELECT event_id, CASE WHEN regexp_matches(lower(msg), 'openrouter|llm|extract') THEN 'extract_error' WHEN regexp_matches(lower(msg), 'firecrawl|scrape') THEN 'firecrawl_error' WHEN lower(msg) LIKE '%timeout%' THEN 'timeout'
   WHEN lower(msg) LIKE '%budget%' THEN 'budget_exceeded' ELSE 'unknown' END AS reason, regexp_matches(lower(msg), 'timed out|timeout|concurrent|closed|net::|deno repl|target page') AS transient FROM m""")
def _(spark, d):
    m = pick(MESSAGES, 1)
    return table(spark, d, "events").select("event_id", Q.failure_reason(m).alias("reason"), Q.is_transient(m).alias("transient"))


@query("platform_stats", SQ_RAW + """ SELECT site, count_if(platform = 'PC') AS pc, count_if(platform = 'MO') AS mo, count_if(platform = 'All') AS "all", count(*) AS total FROM cand GROUP BY 1""")
def _(spark, d):
    rows = raw_candidates(spark, d).withColumn("platform", F.when(F.col("platform") != "All", F.col("platform")))
    return Q.platform_stats(rows, ["site"])


@query("visibility_stats", SQ_RAW + """ SELECT site, count_if(hidden_reason = 'visible') AS visible, count_if(hidden_reason = 'offscreen') AS offscreen, count_if(hidden_reason = 'zero_size') AS zero_size, count(*) AS total, true AS balanced FROM cand GROUP BY 1""")
def _(spark, d):
    return Q.visibility_stats(raw_candidates(spark, d), ["site"]).select("site", "visible", "offscreen", "zero_size", "total", "balanced")


@query("stage_funnel", SQ_RAW + f""" SELECT page_id, count(*) AS raw, count_if(boxed) AS tagged, count_if({BOX}) AS input, count_if(tag_id % 5 <> 0) AS named, count_if(tag_id % 5 = 0 OR tag_id % 7 = 0) AS dropped,
  coalesce(count_if(tag_id % 5 = 0), 0) AS cap FROM cand GROUP BY 1""")
def _(spark, d):
    r = raw_candidates(spark, d)
    t = F.col("tag_id")
    e = r.select("page_id", F.lit(True).alias("matched"), F.col("bbox").isNotNull().alias("tagged"), G.has_bbox(F.col("bbox")).alias("used"))
    n = r.select("page_id", F.when(t % 5 != 0, F.lit("n")).otherwise(F.lit("")).alias("event_name"), F.when(t % 5 == 0, F.lit("cap")).when(t % 7 == 0, F.lit("split")).alias("dropped_reason"))
    return Q.stage_funnel(e, n, ["page_id"]).select("page_id", "raw", "tagged", "input", "named", "dropped", F.coalesce(F.try_element_at("dropped_by_reason", F.lit("cap")), F.lit(0)).alias("cap"))


@query("capture_qc", SQ_RAW + f""", g AS (SELECT page_id, count(*) AS n, count_if({BOX}) AS wb, count_if(k % 3 = 0) AS f, count_if(NOT {BOX} AND k % 3 <> 0) AS lost FROM cand GROUP BY 1),
  j AS (SELECT p.page_id::VARCHAR AS job_id, CASE WHEN p.page_id % 4 = 0 THEN 100 ELSE 9000 END AS png, p.page_id % 6 AS pos, coalesce(n, 0) AS n, coalesce(wb, 0) AS wb, coalesce(f, 0) AS f, coalesce(lost, 0) AS lost FROM pages p LEFT JOIN g USING (page_id))
  SELECT job_id, concat_ws(';', CASE WHEN png < 8000 THEN 'png_too_small bytes=100' END, CASE WHEN pos <= 0 THEN 'positions_json_missing' END, CASE WHEN n > 0 AND f = 0 THEN 'no_element_captures' END) AS errors,
   png >= 8000 AND pos > 0 AND NOT (n > 0 AND f = 0) AS ok, lost AS missing_count FROM j""")
def _(spark, d):
    r = raw_candidates(spark, d)
    k = (F.col("page_id") + F.col("tag_id")) % 3 == 0
    c = r.select(F.col("page_id").cast("string").alias("job_id"), "tag_id", "bbox", F.when(k, F.lit("/c")).alias("element_capture_url"), k.alias("capture_found"), (~k).alias("no_capture"))
    p = F.col("page_id")
    jobs = table(spark, d, "pages").select(p.cast("string").alias("job_id"), F.when(p % 4 == 0, 100).otherwise(9000).alias("png_bytes"), F.lit(10).alias("page_width"), F.lit(10).alias("page_height"),
                                           F.lit(True).alias("modal_cleared"), (p % 6).alias("positions_saved"))
    return Q.capture_qc(jobs, c).select("job_id", F.array_join("errors", ";").alias("errors"), "ok", "missing_count")


@query("position_report", SQ_RAW + f""", i AS (SELECT page_id, tag_id, {SQ_ISSUE} AS a, CASE WHEN tag_id % 3 = 0 THEN CASE WHEN tag_id % 2 = 0 THEN 'wrong' ELSE 'suspicious' END END AS b FROM cand WHERE boxed),
  f AS (SELECT page_id, CASE WHEN b = 'wrong' THEN b ELSE coalesce(a, b) END AS st FROM i)
  SELECT page_id, count(*) AS checked_count, count_if(st = 'wrong') AS wrong, count_if(st = 'suspicious') AS suspicious, count_if(st IS NOT NULL) = 0 AS ok FROM f GROUP BY 1""")
def _(spark, d):
    r = raw_candidates(spark, d).filter("bbox is not null")
    t = F.col("tag_id")
    a = r.withColumn("i", G.position_issue(F.col("bbox"), F.lit(400), F.lit(100))).filter("i is not null").select("page_id", "tag_id", "i.*", F.lit(0).alias("seq"))
    b = r.filter(t % 3 == 0).select("page_id", "tag_id", F.when(t % 2 == 0, F.lit("wrong")).otherwise(F.lit("suspicious")).alias("status"), F.lit("x").alias("reason"), F.lit(1).alias("seq"))
    return Q.position_report(a.unionByName(b), r)


@query("union_bbox", SQ_RAW + f""" SELECT page_id, min(x) FILTER ({BOX}) AS x, min(y) FILTER ({BOX}) AS y, max(x + w) FILTER ({BOX}) - min(x) FILTER ({BOX}) AS w, max(y + h) FILTER ({BOX}) - min(y) FILTER ({BOX}) AS h FROM cand GROUP BY 1""")
def _(spark, d):
    return Q.union_bbox(raw_candidates(spark, d), ["page_id"]).select("page_id", "union_bbox.x", "union_bbox.y", "union_bbox.w", "union_bbox.h")


@query("crop_source", SQ_RAW + f""", m AS (SELECT site AS row_key, CASE WHEN page_id % 2 = 0 THEN 'cap' || page_id % 5 WHEN page_id % 3 = 0 THEN 'job' || page_id % 5 ELSE 'http://x/' || page_id % 5 END AS source, viewport, {BOX} AS b, page_id * 1000 + tag_id AS seq FROM cand),
  g AS (SELECT row_key, source, viewport, count_if(b) AS boxes, min(seq) AS f FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY boxes DESC, f) AS n FROM g)
  SELECT row_key, source, viewport, boxes FROM r WHERE n = 1""")
def _(spark, d):
    p = F.col("page_id")
    k = p % 5
    rows = raw_candidates(spark, d).select(
        F.col("site").alias("row_key"), F.when(p % 3 == 0, F.concat(F.lit("job"), k)).alias("job_id"),
        F.when(p % 2 == 0, F.concat(F.lit("/captures/cap"), k, F.lit("/pc.png"))).otherwise(F.concat(F.lit("http://x/"), k)).alias("capture_url"), "viewport", "bbox", (p * 1000 + F.col("tag_id")).alias("seq"))
    return Q.crop_source(rows)


@query("member_bbox", SQ_RAW + f""" SELECT page_id, tag_id, CASE WHEN tag_id % 3 = 0 THEN 'member' WHEN {BOX} AND tag_id % 2 = 0 THEN 'page' WHEN tag_id % 5 <> 0 THEN 'file' END AS bbox_source FROM cand""")
def _(spark, d):
    r = raw_candidates(spark, d).withColumn("page_key", F.col("page_id").cast("string"))
    one = G.box(*[F.lit(4)] * 4)
    m = r.select("page_id", "page_key", "viewport", "tag_id", F.when(F.col("tag_id") % 3 == 0, one).alias("bbox"))
    pages = r.select("page_key", "viewport", "tag_id", F.when(F.col("tag_id") % 2 == 0, F.col("bbox")).alias("bbox"), F.col("page_key").alias("job_id"))
    files = r.filter("tag_id % 5 <> 0").select(F.col("page_key").alias("job_id"), "tag_id", one.alias("bbox"))
    return Q.member_bbox(m, pages, files).select("page_id", "tag_id", "bbox_source")


# ---------------------------------------------------------------- job progress made from events

STEPS = {"view": "collecting", "click": "tagging", "signup": "naming", "purchase": "done", "error": "failed"}


def progress(spark, d):
    """events as job updates: a job per user, the event type decides the stage."""
    e = table(spark, d, "events")
    stage = F.lit(None).cast("string")
    for k, v in STEPS.items():
        stage = F.when(F.col("event_type") == k, F.lit(v)).otherwise(stage)
    status = F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "purchase", F.lit("done")).otherwise(F.lit("running"))
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), stage.alias("stage"), F.when(F.col("event_type") == "click", F.lit("page_capture")).otherwise(F.col("event_type")).alias("step"),
        F.floor("value").cast("int").alias("current"), F.lit(20).alias("total"), status.alias("status"), F.timestamp_micros(ts_micros()).alias("updated_at"), F.col("event_id").alias("seq"),
        (F.col("user_id") % 5).cast("string").alias("batch_id"))


SQ_PROGRESS = """WITH pr AS (SELECT user_id::VARCHAR AS job_id, (user_id % 5)::VARCHAR AS batch_id, event_id, ts, CASE event_type WHEN 'view' THEN 'collecting' WHEN 'click' THEN 'tagging' WHEN 'signup' THEN 'naming' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS stage,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status, CASE event_type WHEN 'click' THEN 'page_capture' ELSE event_type END AS step, floor(value)::INT AS cur FROM events),
  rg AS (SELECT * FROM (VALUES """ + ", ".join(f"({s(k)}, {a}, {b})" for k, (a, b) in G.STAGE_RANGES.items()) + """) v(stage, a, b)),
  pp AS (SELECT pr.*, (CASE WHEN stage = 'done' THEN 100 WHEN stage = 'failed' THEN a ELSE floor(a + least(1.0, greatest(0.0, cur / 20.0)) * (b - a) + 0.5) END)::INT AS pct FROM pr JOIN rg USING (stage)),
  jl AS (SELECT job_id, min(batch_id) AS batch_id, arg_max(stage, ts) AS stage, arg_max(status, ts) AS status, coalesce(arg_max(pct, ts) FILTER (stage <> 'failed'), 0) AS percent, count(*) AS updates FROM pp GROUP BY 1)"""


@query("latest_jobs", SQ_PROGRESS + " SELECT job_id, stage, status, percent, updates FROM jl")
def _(spark, d):
    return Q.job_latest(progress(spark, d)).select("job_id", "stage", "status", "percent", "updates")


@query("batch_progress", SQ_PROGRESS + """ SELECT batch_id, count(*) AS total, count_if(status = 'done') AS done, count_if(status IN ('done', 'failed')) AS finished, floor(avg(percent) + 0.5)::INT AS percent, sum(least(updates, 60))::BIGINT AS capture_done,
   sum(updates)::BIGINT AS capture_total, floor(sum(least(updates, 60)) / sum(updates) * 100 + 0.5)::INT AS capture_pct, CASE WHEN sum(least(updates, 60)) < sum(updates) THEN 'running' ELSE 'done' END AS capture_phase FROM jl GROUP BY 1""")
def _(spark, d):
    j = Q.job_latest(progress(spark, d)).withColumn("batch_id", (F.col("job_id").cast("int") % 5).cast("string"))
    return Q.batch_progress(j.select("batch_id", "status", "percent", F.least("updates", F.lit(60)).alias("captured"), F.col("updates").alias("capturable")))


@query("progress_gaps", SQ_PROGRESS + """, g AS (SELECT job_id, event_id AS seq, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, lag(step) OVER w AS waiting_in FROM pr WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
  SELECT job_id, seq, (gap // 1000000)::BIGINT AS idle_seconds, CASE waiting_in WHEN 'page_capture' THEN 180 ELSE 90 END AS limit_seconds, gap // 1000000 >= CASE waiting_in WHEN 'page_capture' THEN 180 ELSE 90 END AS stalled FROM g WHERE gap IS NOT NULL""")
def _(spark, d):
    return Q.progress_gaps(progress(spark, d)).select("job_id", "seq", "idle_seconds", "limit_seconds", "stalled")


@query("project_rollup", """WITH o AS (SELECT o_custkey AS project_id, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders)
  SELECT project_id, count(*)::INT AS page_count, count_if(o_orderstatus = 'F')::INT AS analyzed_count, '/api/dev/captures/' || arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') || '/pc.png' AS cover_url, (project_id % 5 + 1)::INT AS current_step FROM o GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    job = F.struct(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", F.lit("done")).otherwise(F.lit("running")).alias("status"),
                   F.lit("pc").alias("viewport"), F.lit(None).cast("string").alias("capture_url"))
    p = o.groupBy(F.col("o_custkey").alias("project_id")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    p = p.select("project_id", (F.col("project_id") % 5 + 1).cast("int").alias("step"), F.lit(None).cast("string").alias("cover_url"), F.array().cast("array<struct<url:string,viewports:array<string>>>").alias("urls"), "jobs")
    return Q.project_rollup(p)
