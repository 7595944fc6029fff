"""Queries over parameters, payloads, geometry and progress percentages."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import query, s, sq_parse, table
from webplan.catalog.links import SQ_HINTED, pages
from webplan.catalog.naming import pick, sq_pick
from webplan.functions import geometry as G
from webplan.functions import params as P
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import candidates as C
from webplan.operators import grouping as GR
from webplan.operators import naming as N

PNAMES = ["platform", "direction", "label", "link_url"]


def param_rows(spark, d):
    """Three parameters per event; names repeat in some rows."""
    e = table(spark, d, "events")
    val = lambda k: F.concat(F.lit(f"v{k}-"), F.col("user_id"))
    arr = F.array(*[F.struct(pick(PNAMES, st).alias("name"), F.when(F.col("event_id") % (k + 5) != 0, val(k)).alias("value_hint"))
                    for k, st in enumerate((1, 2, 4))])
    return e.select("event_id", "user_id", arr.alias("params"))


SQ_PARAMS = "WITH p AS (SELECT event_id, user_id, [" + ", ".join(
    f"{{'n': {sq_pick(PNAMES, st)}, 'v': CASE WHEN event_id % {k + 5} <> 0 THEN 'v{k}-' || user_id END}}" for k, st in enumerate((1, 2, 4))
) + "] AS params FROM events)"
show = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value_hint"], F.lit("~")))), ";")
sq_show = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda p: p.n || '=' || coalesce(p.v, '~')), ';'), '')"


@query("param_value", SQ_PARAMS + " SELECT event_id, list_extract(list_filter(params, lambda p: p.n = 'label'), 1).v AS label FROM p")
def _(spark, d):
    return param_rows(spark, d).select("event_id", P.param_value(F.col("params"), "label").alias("label"))


@query("dedupe_params", SQ_PARAMS + f""" SELECT event_id, {sq_show("list_filter(params, lambda p, i: len(list_filter(params[1:i], lambda q: q.n = p.n)) = 1)")} AS kept FROM p""")
def _(spark, d):
    return param_rows(spark, d).select("event_id", show(P.dedupe_params(F.col("params"))).alias("kept"))


@query("allow_extras", SQ_PARAMS + f""" SELECT event_id, {sq_show("list_filter(params, lambda p: p.n = 'direction')")} AS kept FROM p""")
def _(spark, d):
    return param_rows(spark, d).select("event_id", show(P.allow_extras(F.col("params"))).alias("kept"))


def contexts(spark, d):
    rows = pages(spark, d)
    return rows.select("page_id", "url", F.col("url").alias("page_url"), U.page_category_hint(F.col("title"), F.col("url")).alias("page_category"),
                       U.viewport_of(F.col("url")).alias("viewport"), U.normalize_page_url(F.col("url")).alias("page_key"),
                       U.page_context(F.col("url"), F.col("title")).alias("context"))


LOC = "origin || path || query || frag"
SQ_VIEW_PARAMS = f"""'platform=' || upper(viewport) || ';page_location=' || {LOC} || ';page_path=' || path || query || frag || ';page_title=' ||
  coalesce(nullif(title, ''), '~') """


@query("click_params", SQ_HINTED + f""" SELECT page_id, {SQ_VIEW_PARAMS} || ';page_category=' || page_category || ';category=' || page_category ||
  ';action=기타;label=Buy;link_url=/x;direction=left' AS params FROM hinted""")
def _(spark, d):
    extra = F.array(P.param("direction", F.lit("left")), P.param("label", F.lit("dup")), P.param("color", F.lit("red")))
    return contexts(spark, d).select("page_id", show(P.click_params(
        F.col("page_category"), F.lit(" "), F.lit("Buy"), T.platform_label(F.col("viewport")), F.col("context"), F.lit("/x"), extra)).alias("params"))


@query("page_view_params", SQ_HINTED + f""" SELECT page_id, {SQ_VIEW_PARAMS} || ';page_referrer=~;page_category=' || page_category || ';page_name=' ||
  page_category AS params FROM hinted""")
def _(spark, d):
    return contexts(spark, d).select("page_id", show(P.page_view_params(
        F.col("page_category"), T.platform_label(F.col("viewport")), F.col("context"))).alias("params"))


@query("page_view_rows", SQ_HINTED + """ SELECT page_key, viewport, 0 AS tag_id, page_category AS text, page_category, '' AS action, 'page_view' AS action_key,
  '페이지뷰' AS event_name, upper(viewport) AS platform, 7 AS n_params FROM hinted""")
def _(spark, d):
    rows = C.page_view_rows(contexts(spark, d).select("page_key", "url", "viewport", "page_category", "context"))
    return rows.select("page_key", "viewport", "tag_id", "text", "page_category", "action", "action_key", "event_name", "platform",
                       F.size("parameters").alias("n_params"))


# ---------------------------------------------------------------- candidates derived from anchors

AREAS = ["global/gnb", "main_banner", "추천 상품", "product_list"]
LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
HIDDEN = ["visible", "offscreen", "zero_size", "visible", "collapsed_parent"]


def raw_candidates(spark, d):
    """Anchors as element rows with made-up but deterministic labels, areas, boxes and platforms."""
    from webplan.sources.pages import page_title

    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")
    grab = lambda i: F.regexp_extract_all(clean, F.lit(LINK), F.lit(i))
    p = table(spark, d, "pages").select(
        "page_id", "url", page_title(F.col("html")).alias("title"),
        F.posexplode(F.arrays_zip(grab(1).alias("href"), grab(2).alias("text"))).alias("pos", "a"),
    )
    t = F.col("pos") + 1
    area = F.element_at(F.array(*[F.lit(x) for x in AREAS]), (F.col("page_id") % 2 * 2 + t % 2 + 1).cast("int"))
    rows = p.select(
        "page_id", "url", "title", U.site_of(F.col("url")).alias("site"), U.viewport_of(F.col("url")).alias("viewport"),
        U.normalize_page_url(F.col("url")).alias("page_key"), t.cast("int").alias("tag_id"), area.alias("area_raw"),
        T.decode_entities(F.col("a.text")).alias("text"), F.when((F.col("page_id") + F.floor(t / 2)) % 2 == 0, F.lit("Buy")).otherwise(F.lit("More")).alias("short"),
    )
    k = F.col("page_id") + F.col("tag_id")
    link = F.when(k % 3 != 0, F.concat(F.lit("/"), (k % 2).cast("string")))
    box = F.when(F.col("tag_id") % 11 != 10, G.box(F.col("tag_id") * 37 % 500, F.floor(F.col("tag_id") / 3) * 50,
                                                  F.col("page_id") % 4 * 20, F.lit(30)))
    return rows.select(
        "page_id", "url", "title", "site", "viewport", "page_key", "tag_id", "text", F.col("short").alias("label"), "area_raw",
        F.when(F.col("tag_id") % 9 == 0, F.lit("")).otherwise(F.col("short")).alias("merge_label"), link.alias("link_url"),
        F.element_at(F.array(*[F.lit(x) for x in ("PC", "MO", "All", "All")]), (k % 4 + 1).cast("int")).alias("platform"),
        box.alias("bbox"), F.element_at(F.array(*[F.lit(h) for h in HIDDEN]), (k % 5 + 1).cast("int")).alias("hidden_reason"),
        F.when(F.col("tag_id") % 7 == 3, F.lit("찜하기")).otherwise(F.lit("클릭")).alias("event_name"),
    )


def candidates(spark, d):
    """Canonical candidates with one page view per page."""
    raw = raw_candidates(spark, d).withColumn("hint", U.page_category_hint(F.col("title"), F.col("url"))).withColumn(
        "context", U.page_context(F.col("url"), F.col("title")))
    key = F.when(F.col("area_raw") == "global/gnb", F.lit("click_gnb")).otherwise(F.lit("click"))
    rows = C.canonical_fields(
        raw, T.resolve_page_category(F.col("hint"), F.col("area_raw")), F.col("area_raw"), F.col("label"), F.col("merge_label"),
        F.col("event_name"), key, F.col("platform"), F.col("context"), F.col("link_url"))
    # canonical_fields falls back to the label, the blank merge labels are wanted here
    rows = rows.withColumn("merge_label", F.when(F.col("tag_id") % 9 == 0, F.lit("")).otherwise(F.col("merge_label")))
    rows = rows.withColumn("event_type", F.lit("click")).withColumn("page_name", F.col("hint"))
    pv = contexts(spark, d).withColumn("site", U.site_of(F.col("url"))).withColumn("page_name", F.col("page_category"))
    views = C.page_view_rows(pv.select("page_id", "site", "page_key", "viewport", "page_name", "page_category", "context"))
    cols = ["page_id", "site", "page_key", "viewport", "page_name", "tag_id", "text", "page_category", "category", "action", "action_key", "label",
            "merge_label", "event_name", "event_type", "platform", "parameters", "link_url", "bbox", "hidden_reason"]
    views = views.withColumns({"link_url": F.lit(None).cast("string"), "bbox": F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"),
                               "hidden_reason": F.lit(None).cast("string")})
    return rows.select(*cols).unionByName(views.select(*cols))


SQ_RAW = SQ_HINTED + f""",
la0 AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\\b.*?</script\\s*>', ' ', 'g'),
   '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), {s(LINK)}, 2) AS ts FROM pages),
la AS (SELECT page_id, unnest(ts) AS text0, generate_subscripts(ts, 1)::INT AS tag_id FROM la0),
raw AS (SELECT h.page_id, h.root AS site, h.viewport, h.page_key, h.page_category AS hint, h.title, origin, path, query, frag, tag_id,
  replace(replace(text0, '&amp;', '&'), '&#39;', '''') AS text, CASE WHEN (h.page_id + tag_id // 2) % 2 = 0 THEN 'Buy' ELSE 'More' END AS label,
  list_extract([{', '.join(s(a) for a in AREAS)}], (h.page_id % 2 * 2 + tag_id % 2 + 1)::INT) AS area_raw, (h.page_id + tag_id) AS k,
  CASE WHEN tag_id % 9 = 0 THEN '' WHEN (h.page_id + tag_id // 2) % 2 = 0 THEN 'Buy' ELSE 'More' END AS merge_label,
  CASE WHEN (h.page_id + tag_id) % 3 <> 0 THEN '/' || (h.page_id + tag_id) % 2 END AS link_url,
  list_extract(['PC','MO','All','All'], ((h.page_id + tag_id) % 4 + 1)::INT) AS platform,
  tag_id % 11 <> 10 AS boxed, (tag_id * 37 % 500)::INT AS x, (tag_id // 3 * 50)::INT AS y, (h.page_id % 4 * 20)::INT AS w, 30 AS h,
  list_extract([{', '.join(s(a) for a in HIDDEN)}], ((h.page_id + tag_id) % 5 + 1)::INT) AS hidden_reason,
  CASE WHEN tag_id % 7 = 3 THEN '찜하기' ELSE '클릭' END AS event_name FROM hinted h JOIN la USING (page_id)),
cand AS (SELECT *, CASE area_raw WHEN 'global/gnb' THEN 'GNB' WHEN 'main_banner' THEN '메인 배너' WHEN 'product_list' THEN '상품 목록' ELSE area_raw END AS area,
  CASE WHEN area_raw = 'global/gnb' THEN 'GNB' ELSE hint END AS page_category,
  CASE WHEN area_raw = 'global/gnb' THEN 'click_gnb' ELSE 'click' END AS action_key FROM raw)"""


@query("canonical_fields", SQ_RAW + """ SELECT page_key, tag_id, page_category, page_category AS category, area AS action, action_key, label, merge_label, event_name,
  9 AS n_params FROM cand""")
def _(spark, d):
    rows = candidates(spark, d).filter("tag_id > 0")
    return rows.select("page_key", "tag_id", "page_category", "category", "action", "action_key", "label", "merge_label", "event_name",
                       F.size("parameters").alias("n_params"))


@query("tagging_fields", SQ_RAW + """ SELECT page_key, tag_id, page_category AS page, area, action_key AS key, page_category AS bare_page, area AS bare_area FROM cand
  UNION ALL SELECT page_key, 0, page_category, '', 'page_view', page_category, '' FROM hinted""")
def _(spark, d):
    c = F.col
    page = P.tagging_page_category(c("page_category"), c("parameters"), c("category"))
    none = F.lit(None).cast("string")
    return candidates(spark, d).select(
        "page_key", "tag_id", page.alias("page"), P.tagging_area(c("tag_id"), c("action_key"), c("action"), c("parameters"), page).alias("area"),
        P.tagging_action_key(c("action_key"), c("action")).alias("key"),
        P.tagging_page_category(none, c("parameters"), none).alias("bare_page"),
        P.tagging_area(c("tag_id"), c("action_key"), F.lit("click"), c("parameters"), page).alias("bare_area"),
    )


@query("transmission_payload", SQ_RAW + f""" SELECT page_key, tag_id, event_name, page_category, NULL::VARCHAR AS page_name, page_category AS category, area AS action, trim(label) AS label,
  platform, link_url, NULL::VARCHAR AS direction, {LOC} AS page_location, path || query || frag AS page_path, nullif(trim(title), '') AS page_title, NULL::VARCHAR AS page_referrer FROM cand
  UNION ALL SELECT page_key, 0, '페이지뷰', page_category, page_category, NULL, NULL, NULL, upper(viewport), NULL, NULL, {LOC}, path || query || frag, nullif(trim(title), ''), NULL FROM hinted""")
def _(spark, d):
    return candidates(spark, d).select("page_key", "tag_id", P.transmission_payload(F.col).alias("p")).select("page_key", "tag_id", "p.*")


@query("params_record", SQ_RAW + f""" SELECT page_key, tag_id, 'action=' || area || ';category=' || trim(page_category) || coalesce(';label=' || nullif(trim(label), ''), '') || coalesce(';link_url=' || link_url, '')
  || ';page_category=' || trim(page_category) || ';page_location=' || {LOC} || ';page_path=' || path || query || frag || coalesce(';page_title=' || nullif(trim(title), ''), '') || ';platform=' || platform AS record FROM cand""")
def _(spark, d):
    rec = P.params_record(P.transmission_payload(F.col))
    rows = candidates(spark, d).filter("tag_id > 0").select("page_key", "tag_id", rec.alias("r"))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("r")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("page_key", "tag_id", flat.alias("record"))


REC = lambda r, box: f"CASE WHEN {box} THEN CASE WHEN {r} IN ('offscreen','collapsed_parent') THEN 'visible' ELSE {r} END WHEN {r} = 'visible' THEN 'zero_size' ELSE {r} END"
BOX = "(boxed AND w > 0)"


@query("element_location", SQ_RAW + f""" SELECT page_key, tag_id, '[data-tag-id="' || tag_id || '"]' AS selector_hint, {REC('hidden_reason', BOX)} AS hidden_reason, left(text, 120) AS text,
  CASE WHEN tag_id % 2 = 0 THEN '#moved' ELSE '[data-tag-id="' || tag_id || '"]' END AS merged_selector,
  CASE WHEN tag_id % 2 = 0 THEN CASE hidden_reason WHEN 'offscreen' THEN 'visible' WHEN 'collapsed_parent' THEN 'visible' WHEN 'visible' THEN 'visible' ELSE CASE WHEN {BOX} THEN {REC('hidden_reason', BOX)} ELSE 'zero_size' END END
  ELSE {REC('hidden_reason', BOX)} END AS merged_reason FROM cand""")
def _(spark, d):
    c = F.col
    loc = P.element_location(c("tag_id"), F.lit(" "), F.array().cast("array<string>"), c("bbox"), c("platform"), c("hidden_reason"), c("text"), c("label"))
    row = P.element_location(c("tag_id"), F.lit("#moved"), F.array().cast("array<string>"), G.box(*[F.lit(5)] * 4), c("platform"), c("hidden_reason"),
                             c("text"), c("label"))
    rows = candidates(spark, d).filter("tag_id > 0").withColumn("l", loc).withColumn("m", F.when(c("tag_id") % 2 == 0, row))
    return rows.select("page_key", "tag_id", "l.selector_hint", "l.hidden_reason", "l.text", P.merge_location(c("l"), c("m")).alias("j")).select(
        "page_key", "tag_id", "selector_hint", "hidden_reason", "text", F.col("j.selector_hint").alias("merged_selector"),
        F.col("j.hidden_reason").alias("merged_reason"))


# ---------------------------------------------------------------- geometry


@query("bbox_area", SQ_RAW + f" SELECT page_key, tag_id, CASE WHEN boxed THEN w * h ELSE 0 END AS area, {BOX} AS has_box FROM cand")
def _(spark, d):
    return raw_candidates(spark, d).select("page_key", "tag_id", G.bbox_area(F.col("bbox")).alias("area"), G.has_bbox(F.col("bbox")).alias("has_box"))


@query("reconcile_hidden", SQ_RAW + f" SELECT page_key, tag_id, {REC('hidden_reason', BOX)} AS hidden_reason FROM cand")
def _(spark, d):
    return raw_candidates(spark, d).select("page_key", "tag_id", G.reconcile_hidden(F.col("hidden_reason"), F.col("bbox")).alias("hidden_reason"))


@query("crop_square", SQ_RAW + """, b AS (SELECT page_key, tag_id, x, y, greatest(w, 1) AS w, h, 400 + tag_id * 10 AS iw, 300 AS ih, greatest(w, h, 1) AS m FROM cand WHERE boxed AND w > 0),
  p AS (SELECT *, CASE WHEN m < 40 THEN 180 ELSE greatest(80, floor(m * 0.45 + 0.5)::INT) END AS pad FROM b),
  sd AS (SELECT *, greatest(least(320, iw, ih), least(m + pad * 2, iw, ih)) AS side FROM p),
  l AS (SELECT *, greatest(0, least(floor((x + x + w) / 2 - side / 2 + 0.5)::INT, iw - side)) AS lft, greatest(0, least(floor((y + y + h) / 2 - side / 2 + 0.5)::INT, ih - side)) AS tp FROM sd)
  SELECT page_key, tag_id, lft::INT AS "left", tp::INT AS top, greatest(2, least(side, iw - lft, ih - tp))::INT AS size FROM l""")
def _(spark, d):
    rows = raw_candidates(spark, d).filter(G.has_bbox(F.col("bbox")))
    return rows.select("page_key", "tag_id", G.crop_square(F.col("bbox"), F.lit(400) + F.col("tag_id") * 10, F.lit(300)).alias("c")).select("page_key", "tag_id", "c.*")


@query("is_short_capture", """SELECT o_orderkey, CASE WHEN o_orderkey % 900 <= 0 OR o_custkey % 2000 <= 0 THEN true WHEN o_custkey % 2000 <= 840 THEN o_orderkey % 900 < 680.0
  ELSE o_orderkey % 900 < (o_custkey % 2000) * 0.85 END AS short FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.is_short_capture(F.col("o_orderkey") % 900, F.col("o_custkey") % 2000, F.lit(800)).alias("short"))


SQ_ISSUE = """CASE WHEN x + w > 402 OR y + h > 102 THEN 'wrong' WHEN w < 3 THEN 'wrong' WHEN w * h > 400 * 100 * 0.8 THEN 'suspicious' END"""


@query("position_issue", SQ_RAW + f" SELECT page_key, tag_id, {SQ_ISSUE} AS status FROM cand WHERE boxed AND {SQ_ISSUE} IS NOT NULL")
def _(spark, d):
    rows = raw_candidates(spark, d).withColumn("i", G.position_issue(F.col("bbox"), F.lit(400), F.lit(100)))
    return rows.filter("i is not null").select("page_key", "tag_id", "i.status")


@query("recency_bucket", """WITH e AS (SELECT event_id, ts, epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) AS age FROM events)
  SELECT event_id, CASE WHEN age >= 0 AND age < 86400000000 THEN '오늘' WHEN age >= 0 AND age < 172800000000 THEN '어제' WHEN age >= 0 AND age < 604800000000
   THEN (age // 86400000000) || '일 전' ELSE month(ts) || '. ' || day(ts) || '.' END AS bucket FROM e""")
def _(spark, d):
    now = F.timestamp_micros(F.lit(1705708800000000))
    return table(spark, d, "events").select("event_id", G.recency_bucket(F.timestamp_micros(ts_micros()), now).alias("bucket"))


def ts_micros():
    """Event time as microseconds, whatever time zone the session uses."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


STAGES = list(G.STAGE_RANGES)


@query("stage_percent", "WITH e AS (SELECT event_id, " + sq_pick(STAGES, 1) + """ AS stage, user_id % 12 - 1 AS cur, user_id % 5 * 2 AS total FROM events),
  r AS (SELECT * FROM (VALUES """ + ", ".join(f"({s(k)}, {a}, {b})" for k, (a, b) in G.STAGE_RANGES.items()) + """) v(stage, a, b))
  SELECT event_id, (CASE WHEN stage = 'done' THEN 100 WHEN stage = 'failed' OR total <= 0 THEN a ELSE floor(a + least(1.0, greatest(0.0, cur::DOUBLE / total)) * (b - a) + 0.5) END)::INT AS percent
  FROM e JOIN r USING (stage)""")
def _(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select("event_id", G.stage_percent(pick(STAGES, 1), u % 12 - 1, u % 5 * 2).alias("percent"))


# ---------------------------------------------------------------- model responses

REPLIES = ["ok", "fenced", "wrapped", "cut", "limit", "length", "fatal", "nocat"]


def responses(spark, d):
    """A model response per conversation turn, in all the shapes they come in."""
    c = table(spark, d, "conversations")
    kind = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)) + 1).cast("int"))
    i = F.col("turn").cast("string")
    row = F.concat(F.lit('[{"tag_id": '), i, F.lit(', "category": " 추천   상품 ", "label": "Buy", "event_name": "찜 하기", "parameters": [{"name": "direction", "value_hint": "left"}, {"name": "x", "value_hint": "1"}]},'
                                                '{"tag_id": 900, "category": "hero", "new_event_name": "옵션 선택", "new_event_reason": "new"}, {"category": "lost"}, {"tag_id": "7", "category": "text id"}]'))
    text = (
        F.when(kind == "ok", row).when(kind == "fenced", F.concat(F.lit("```json\n"), row, F.lit("\n```")))
        .when(kind == "wrapped", F.concat(F.lit('{"page_category": " 메인 ", "results": '), row, F.lit("}")))
        .when(kind == "cut", F.substring(row, 1, 60)).when(kind == "length", row).when(kind == "nocat", F.lit('[{"tag_id": 3, "category": " "}]'))
        .otherwise(F.lit(""))
    )
    error = F.when(kind == "limit", F.lit("HTTP 429 rate limit")).when(kind == "fatal", F.lit("bad key"))
    return c.select(F.concat("conv_id", F.lit("-"), "turn").alias("batch_id"), F.col("conv_id").alias("page_id"), "turn", kind.alias("kind"), text.alias("text"),
                    F.when(kind == "length", F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"), error.alias("error"))


SQ_REPLY = "WITH r AS (SELECT conv_id || '-' || turn AS batch_id, conv_id AS page_id, turn, list_extract([" + ", ".join(s(r) for r in REPLIES) + \
    "], ((conv_id + turn) % 8 + 1)::INT) AS kind FROM conversations)"


@query("response_class", SQ_REPLY + """ SELECT batch_id, CASE WHEN kind IN ('cut', 'length') THEN 'TRUNCATED' WHEN kind = 'limit' THEN 'RETRYABLE_ERROR' WHEN kind = 'fatal' THEN 'FATAL' ELSE 'OK' END AS class FROM r""")
def _(spark, d):
    return responses(spark, d).select("batch_id", N.response_class(F.col("text"), F.col("finish_reason"), F.col("error")).alias("class"))


@query("parse_suggestions", SQ_REPLY + """, g AS (SELECT * FROM r WHERE kind IN ('ok', 'fenced', 'wrapped', 'length'))
  SELECT batch_id, CASE WHEN kind = 'wrapped' THEN '메인' END AS page_category, turn::INT AS tag_id, '추천 상품' AS category, 'add_wishlist' AS action, 'Buy' AS label, 'Buy' AS merge_label,
   '찜하기' AS event_name, 'direction=left' AS params, false AS registry_created FROM g
  UNION ALL SELECT batch_id, CASE WHEN kind = 'wrapped' THEN '메인' END, 900, 'hero', 'interact', 'hero', 'hero', '옵션선택', '', true FROM g""")
def _(spark, d):
    from webplan.catalog.naming import registry

    rows = N.parse_suggestions(responses(spark, d), registry(spark))
    return rows.select("batch_id", "page_category", "tag_id", "category", "action", "label", "merge_label", "event_name", show(F.col("parameters")).alias("params"),
                       "registry_created")


@query("infer_param_type", """SELECT event_type, user_id % 20 AS bucket, CASE WHEN bool_and(CASE WHEN user_id % 20 % 3 = 0 THEN NULL ELSE regexp_matches(CASE WHEN user_id % 20 % 3 = 1 THEN value::VARCHAR ELSE props END, '^-?\\d+(\\.\\d+)?$') END)
  THEN 'Double' ELSE 'String' END AS type FROM events GROUP BY 1, 2""")
def _(spark, d):
    from webplan.plans import taxonomy as X

    b = F.col("user_id") % 20
    v = F.when(b % 3 == 0, F.lit(" ")).when(b % 3 == 1, F.col("value").cast("string")).otherwise(F.col("props"))
    return table(spark, d, "events").withColumn("bucket", b).withColumn("v", v).groupBy("event_type", "bucket").agg(X.infer_param_type(F.col("v")).alias("type"))
