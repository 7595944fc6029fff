"""Queries that join suggestions, geometry, platform and captures onto candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, s, sq_parse, table
from webplan.catalog.elements import LM, SECTION, elements, sq, rich_elements, SELECTOR
from webplan.catalog.elements import CHAIN
from webplan.catalog.fields import BOX, REC, SQ_RAW, candidates, raw_candidates, responses, show, SQ_REPLY
from webplan.catalog.naming import registry
from webplan.functions import geometry as G
from webplan.functions import params as P
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import candidates as C
from webplan.operators import dom as D
from webplan.operators import naming as N
from webplan.operators import quality as Q
from webplan.sources import hints as H
from webplan.sources.pages import with_site

FULL = LM + SECTION.replace(CHAIN, "")


def placed_elements(spark, d):
    """Elements of the enriched pages with menu path and platform reason."""
    return elements(spark, d).withColumn("has_menu_path", F.col("tag_id") == 4).withColumn(
        "platform_reason", F.when(F.col("landmark") == "fnb", F.lit("footer.fixed-bottom-nav")).otherwise(F.lit("visible@desktop-viewport")))


def suggestions(spark, d):
    """Suggestions for two thirds of the elements, a few of them vague."""
    e = rich_elements(spark, d)
    rows = D.assign_tag_ids(e).select("page_id", "tag_id").filter("tag_id % 3 <> 0")
    cat = F.when(F.col("tag_id") % 2 == 0, F.lit("unknown")).otherwise(F.lit("추천 상품"))
    return rows.select("page_id", "tag_id", cat.alias("category"), F.lit("click").alias("action"), F.lit("L").alias("label"), F.lit("L").alias("merge_label"),
                       F.lit("찜하기").alias("event_name"), F.array().cast(P.PARAMS).alias("parameters"), F.lit(None).cast("string").alias("reason"))


SQ_PLACED = FULL + f"""pl AS (SELECT ids.*, landmark, section_heading, phase = 2 AS ptr FROM ids JOIN lm USING (page_id, pos) LEFT JOIN sh USING (page_id, pos)),
rule AS (SELECT *, CASE WHEN landmark = 'gnb' OR tag_id = 4 THEN 'global/gnb' WHEN landmark = 'fnb' THEN 'global/fnb' ELSE coalesce(section_heading, 'unknown') END AS rcat FROM pl),
"""


@query("rule_namer", sq(FULL + """z AS (SELECT 1) SELECT page_id, tag_id, CASE landmark WHEN 'gnb' THEN 'global/gnb' WHEN 'fnb' THEN 'global/fnb' ELSE coalesce(section_heading, 'unknown') END AS category,
  CASE landmark WHEN 'gnb' THEN 'click_gnb' WHEN 'fnb' THEN 'click_fnb' ELSE 'click' END AS action, '클릭' AS event_name FROM ids JOIN lm USING (page_id, pos) LEFT JOIN sh USING (page_id, pos)"""))
def _(spark, d):
    return N.rule_namer(elements(spark, d)).select("page_id", "tag_id", "category", "action", "event_name")


@query("namer", sq("""z AS (SELECT 1) SELECT page_id, tag_id, CASE WHEN tag_id % 3 <> 0 THEN '찜하기' ELSE '클릭' END AS event_name FROM ids"""))
def _(spark, d):
    rows = elements(spark, d).select("page_id", "tag_id", "label", "landmark", "section_heading")

    def plug_in(e):
        # a naming step that skips every third element
        return e.filter("tag_id % 3 <> 0").select(
            "page_id", "tag_id", F.lit("추천 상품").alias("category"), F.lit("add_wishlist").alias("action"), "label",
            F.col("label").alias("merge_label"), F.lit("찜하기").alias("event_name"), F.array().cast(P.PARAMS).alias("parameters"),
            F.lit(None).cast("string").alias("reason"))

    return N.apply_namer(rows, plug_in).select("page_id", "tag_id", "event_name")


@query("attach_suggestions", sq(SQ_PLACED + """z AS (SELECT 1) SELECT page_id, tag_id, CASE WHEN tag_id % 3 = 0 THEN rcat WHEN tag_id % 2 = 0 THEN 'unknown' ELSE '추천 상품' END AS category,
  CASE WHEN tag_id % 3 = 0 THEN 'rule' ELSE 'model' END AS source FROM rule"""))
def _(spark, d):
    rows = C.attach_suggestions(placed_elements(spark, d), suggestions(spark, d))
    return rows.select("page_id", "tag_id", "s.category", F.col("s_source").alias("source"))


@query("dom_category_override", sq(SQ_PLACED + """c AS (SELECT *, CASE WHEN tag_id % 3 = 0 THEN rcat WHEN tag_id % 2 = 0 THEN 'unknown' ELSE '추천 상품' END AS c0 FROM rule),
  f AS (SELECT *, CASE WHEN landmark = 'gnb' OR tag_id = 4 THEN 'global/gnb' WHEN landmark = 'fnb' THEN 'global/fnb' ELSE c0 END AS c1 FROM c),
  v AS (SELECT *, CASE WHEN c1 = 'unknown' AND tag_id <> 4 AND section_heading IS NOT NULL THEN section_heading ELSE c1 END AS c2 FROM f)
  SELECT page_id, tag_id, c2 AS category, CASE c2 WHEN 'global/gnb' THEN 'click_gnb' WHEN 'global/fnb' THEN 'click_fnb' ELSE 'click' END AS action FROM v"""))
def _(spark, d):
    rows = C.dom_category_override(C.attach_suggestions(placed_elements(spark, d), suggestions(spark, d)))
    return rows.select("page_id", "tag_id", "s.category", "s.action")


# ---------------------------------------------------------------- positions


def measured(spark, d):
    return candidates(spark, d).withColumn("selector_hint", F.lit("a")).withColumn("has_menu_path", F.col("tag_id") % 6 == 1)


def positions(spark, d):
    """Stored geometry for every second element."""
    c = candidates(spark, d).filter("tag_id % 2 = 1")
    return c.select("page_key", "viewport", "tag_id", F.when(F.col("tag_id") % 3 == 0, F.lit(" ")).otherwise(F.lit("#s")).alias("selector_hint"),
                    F.when(F.col("tag_id") % 5 != 0, G.box(F.lit(1), F.lit(2), F.col("tag_id") * 4, F.lit(10))).alias("bbox"),
                    F.lit("offscreen").alias("hidden_reason"), F.lit("MO").alias("platform"))


KEYS = ["page_key", "viewport", "tag_id"]
# the duplicate page: two pages share one normalised address, so keyed sides are reduced to one row per key
def per_key(df):
    return df.dropDuplicates(KEYS)


ONE = "one AS (SELECT DISTINCT page_key, viewport, tag_id FROM cand),"


@query("apply_positions", SQ_RAW + f""" SELECT page_key, tag_id, CASE WHEN tag_id % 2 = 1 AND tag_id % 3 <> 0 THEN '#s' ELSE 'a' END AS selector_hint,
  CASE WHEN tag_id % 2 = 1 THEN 'MO' ELSE platform END AS platform,
  CASE WHEN tag_id % 2 = 1 THEN CASE WHEN tag_id % 5 <> 0 OR {BOX} THEN 'visible' ELSE 'offscreen' END ELSE hidden_reason END AS hidden_reason,
  CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN tag_id * 4 WHEN boxed THEN w END AS w FROM cand""")
def _(spark, d):
    rows = C.apply_positions(measured(spark, d).filter("tag_id > 0"), per_key(positions(spark, d)), KEYS)
    return rows.select("page_key", "tag_id", "selector_hint", "platform", "hidden_reason", F.col("bbox.w").alias("w"))


SQ_CAP = """ta AS (SELECT *, CASE WHEN boxed THEN w * h ELSE 0 END AS tagged, CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN tag_id * 40 ELSE 0 END AS cap,
  CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN tag_id * 4 END AS cw, CASE WHEN boxed THEN w END AS tw FROM cand)"""


@query("pick_bbox", SQ_RAW + ", " + SQ_CAP + """ SELECT page_key, tag_id, CASE WHEN cap <= 0 THEN tw WHEN tagged <= 0 THEN cw WHEN tag_id % 6 = 1 AND tagged >= cap * 0.5 THEN tw WHEN cap >= tagged * 0.5 THEN cw ELSE tw END AS position_w,
  CASE WHEN cap <= 0 THEN tw WHEN tagged <= 0 THEN cw WHEN tag_id % 6 = 1 AND tagged >= cap * 0.5 THEN tw ELSE cw END AS overlay_w, cap > 0 AS capture_found FROM ta""")
def _(spark, d):
    rows = measured(spark, d).filter("tag_id > 0")
    cap = per_key(positions(spark, d))
    a = C.merge_capture_boxes(rows, cap, KEYS, "positions").select("page_id", "page_key", "tag_id", F.col("bbox.w").alias("position_w"), "capture_found")
    b = C.merge_capture_boxes(rows, cap, KEYS, "overlay").select("page_id", "tag_id", F.col("bbox.w").alias("overlay_w"))
    return a.join(b, ["page_id", "tag_id"]).select("page_key", "tag_id", "position_w", "overlay_w", "capture_found")


@query("cross_viewport_platform", SQ_RAW + """, v AS (SELECT *, hidden_reason = 'visible' AS cur, CASE WHEN tag_id % 4 <> 0 THEN tag_id % 3 = 0 END AS opp, tag_id % 5 = 0 AS weak FROM cand)
  SELECT page_key, tag_id, CASE WHEN opp IS NULL THEN platform WHEN cur AND opp THEN 'All' WHEN cur THEN upper(viewport) WHEN opp THEN CASE viewport WHEN 'mo' THEN 'PC' ELSE 'MO' END
    WHEN weak THEN 'All' ELSE platform END AS platform,
  CASE WHEN opp IS NULL THEN CASE WHEN weak THEN 'ambiguous-no-signal' ELSE 'div.lg+:hidden' END WHEN cur AND opp THEN 'visible_both_viewports' WHEN cur THEN 'visible_current_only' WHEN opp THEN 'visible_opposite_only'
    WHEN weak THEN 'hidden_both_no_signal' ELSE 'div.lg+:hidden' END AS platform_reason FROM v""")
def _(spark, d):
    rows = candidates(spark, d).filter("tag_id > 0").withColumn("is_visible", F.col("hidden_reason") == "visible").withColumn(
        "platform_reason", F.when(F.col("tag_id") % 5 == 0, F.lit("ambiguous-no-signal")).otherwise(F.lit("div.lg+:hidden")))
    opp = per_key(rows.filter("tag_id % 4 <> 0").select(*KEYS, (F.col("tag_id") % 3 == 0).alias("is_visible")))
    return C.cross_viewport_platform(rows, opp, KEYS).select("page_key", "tag_id", "platform", "platform_reason")


PLAT = "(tag_id = 0 OR platform = 'All' OR platform = upper(viewport))"


@query("visible_in_viewport", SQ_RAW + f" SELECT page_key, tag_id, {PLAT} AS visible FROM cand")
def _(spark, d):
    return candidates(spark, d).filter("tag_id > 0").select("page_key", "tag_id", C.visible_in_viewport(F.col("tag_id"), F.col("platform"), F.col("viewport")).alias("visible"))


@query("confirmed_position", SQ_RAW + f" SELECT page_key, tag_id FROM cand WHERE {BOX} UNION ALL SELECT page_key, 0 FROM hinted")
def _(spark, d):
    return candidates(spark, d).filter(C.confirmed_position(F.col("tag_id"), F.col("bbox"))).select("page_key", "tag_id")


@query("is_page_view", SQ_RAW + " SELECT page_key, tag_id, false AS page_view FROM cand UNION ALL SELECT page_key, 0, true FROM hinted")
def _(spark, d):
    return candidates(spark, d).select("page_key", "tag_id", P.is_page_view(F.col("tag_id"), F.col("action_key")).alias("page_view"))


@query("no_capture", SQ_RAW + f" SELECT page_key, tag_id, NOT {BOX} OR hidden_reason = 'zero_size' AS no_capture FROM cand UNION ALL SELECT page_key, 0, true FROM hinted")
def _(spark, d):
    return candidates(spark, d).select("page_key", "tag_id", C.no_capture(F.col("tag_id"), F.col("bbox"), F.col("hidden_reason")).alias("no_capture"))


@query("tiny_decorative", SQ_RAW + f" SELECT page_key, tag_id FROM cand WHERE {BOX} AND tag_id % 3 = 0")
def _(spark, d):
    rows = raw_candidates(spark, d).filter(G.has_bbox(F.col("bbox")))
    small = F.when(F.col("tag_id") % 3 != 1, G.box(F.lit(0), F.lit(0), F.lit(15), F.lit(15))).otherwise(G.box(F.lit(0), F.lit(0), F.lit(16), F.lit(2)))
    tag = F.when(F.col("tag_id") % 3 == 2, F.lit("button")).otherwise(F.lit("a"))
    return rows.filter(C.tiny_decorative(tag, small, F.lit("#"))).select("page_key", "tag_id")


@query("ambiguous_or_all", SQ_RAW + ", m AS (SELECT page_id, bool_or(k % 9 = 0) AS f FROM cand GROUP BY 1) SELECT page_id, tag_id FROM cand JOIN m USING (page_id) WHERE NOT f OR k % 9 = 0")
def _(spark, d):
    rows = raw_candidates(spark, d).withColumn("ambiguous", (F.col("page_id") + F.col("tag_id")) % 9 == 0)
    return C.ambiguous_or_all(rows, ["page_id"]).select("page_id", "tag_id")


@query("attach_captures", SQ_RAW + f""" SELECT page_key, tag_id, CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN 'done' ELSE 'failed' END AS capture_status,
  CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN '/c/' || tag_id END AS element_capture_url, NOT (tag_id % 2 = 1 AND tag_id % 5 <> 0) AS no_capture FROM cand
  UNION ALL SELECT page_key, 0, 'done', NULL, false FROM hinted""")
def _(spark, d):
    shots = per_key(positions(spark, d)).select(*KEYS, (F.col("tag_id") % 5 != 0).alias("ok"), F.concat(F.lit("/c/"), "tag_id").alias("capture_url"), "bbox")
    return C.attach_captures(candidates(spark, d), shots, KEYS).select("page_key", "tag_id", "capture_status", "element_capture_url", "no_capture")


@query("sync_group_members", SQ_RAW + f""" SELECT page_key, tag_id, CASE WHEN tag_id % 2 = 1 THEN 'offscreen' ELSE 'old' END AS hidden_reason,
  CASE WHEN tag_id % 2 = 1 AND tag_id % 5 <> 0 THEN tag_id * 4 ELSE 7 END AS w FROM cand""")
def _(spark, d):
    members = candidates(spark, d).filter("tag_id > 0").select(*KEYS, G.box(F.lit(0), F.lit(0), F.lit(7), F.lit(7)).alias("bbox"), F.lit("old").alias("hidden_reason"))
    return C.sync_group_members(members, per_key(positions(spark, d)), KEYS).select("page_key", "tag_id", "hidden_reason", F.col("bbox.w").alias("w"))


@query("orphans", SQ_RAW + " SELECT page_id, tag_id FROM cand WHERE tag_id % 4 = 0")
def _(spark, d):
    rows = raw_candidates(spark, d)
    return C.orphans(rows, rows.filter("tag_id % 4 <> 0"), ["page_id", "tag_id"]).select("page_id", "tag_id")


@query("lossless_check", SQ_RAW + """ SELECT page_id, count_if(tag_id % 8 = 0) AS missing, max((page_id % 5 = 0)::INT)::BIGINT AS extra FROM cand GROUP BY 1
  HAVING count_if(tag_id % 8 = 0) > 0 OR max((page_id % 5 = 0)::INT) > 0""")
def _(spark, d):
    rows = raw_candidates(spark, d).select("page_id", "tag_id")
    got = rows.filter("tag_id % 8 <> 0").unionByName(rows.filter("page_id % 5 = 0 and tag_id = 1").withColumn("tag_id", F.lit(999)))
    return N.lossless_check(rows, got, ["page_id", "tag_id"], ["page_id"])


@query("apply_alias", SQ_RAW + """, al AS (SELECT DISTINCT page_key FROM hinted WHERE length(page_key) % 2 = 0)
  SELECT page_key, tag_id, CASE WHEN area_raw = 'global/gnb' THEN CASE WHEN al.page_key IS NULL THEN 'GNB' ELSE '메인' END WHEN al.page_key IS NULL THEN page_category ELSE '메인' END AS page_category, area AS action FROM cand LEFT JOIN al USING (page_key)
  UNION ALL SELECT page_key, 0, CASE WHEN al.page_key IS NULL THEN page_category ELSE '메인' END, '' FROM hinted LEFT JOIN al USING (page_key)""")
def _(spark, d):
    rows = candidates(spark, d)
    aliases = rows.select("page_key").distinct().filter(F.length("page_key") % 2 == 0).withColumn("alias", F.lit(" 메인 "))
    return C.apply_alias(rows, aliases).select("page_key", "tag_id", "page_category", "action")


@query("resolve_targets", sq(SELECTOR + """n AS (SELECT page_id, selector_hint, count(*) AS n, min(tag_id) AS t FROM sl GROUP BY ALL),
  sv AS (SELECT page_id, tag_id AS saved_id, CASE WHEN tag_id % 2 = 0 THEN tag_id ELSE tag_id + 1000 END AS tag_id, CASE WHEN tag_id % 5 = 0 THEN '#gone' ELSE selector_hint END AS hint,
    selector_hint AS fb, tag_id % 7 = 0 AS boxed FROM sl)
  SELECT sv.page_id, saved_id, CASE WHEN sv.tag_id < 1000 THEN 'tag_id' WHEN a.n = 1 THEN 'selector_hint' WHEN b.n = 1 THEN 'fallback' WHEN boxed THEN 'bbox_only' ELSE 'none' END AS method,
   CASE WHEN sv.tag_id < 1000 THEN '[data-tag-id="' || sv.tag_id || '"]' WHEN a.n = 1 THEN hint WHEN b.n = 1 THEN fb END AS resolved_selector,
   CASE WHEN sv.tag_id < 1000 THEN sv.tag_id WHEN a.n = 1 THEN a.t WHEN b.n = 1 THEN b.t END AS resolved_tag_id
  FROM sv LEFT JOIN n a ON a.page_id = sv.page_id AND a.selector_hint = hint LEFT JOIN n b ON b.page_id = sv.page_id AND b.selector_hint = fb"""))
def _(spark, d):
    e = elements(spark, d).select("page_id", "tag_id", "selector_hint")
    saved = e.select(
        "page_id", F.col("tag_id").alias("saved_id"), F.when(F.col("tag_id") % 2 == 0, F.col("tag_id")).otherwise(F.col("tag_id") + 1000).alias("tag_id"),
        F.when(F.col("tag_id") % 5 == 0, F.lit("#gone")).otherwise(F.col("selector_hint")).alias("selector_hint"),
        F.array(F.lit(" "), "selector_hint").alias("selectors_fallback"), (F.col("tag_id") % 7 == 0).alias("has_bbox"))
    return C.resolve_targets(saved, e)


# ---------------------------------------------------------------- naming jobs


@query("batches", SQ_RAW + """, b AS (SELECT site, page_id, tag_id, row_number() OVER (PARTITION BY page_id ORDER BY tag_id) - 1 AS i, count(*) OVER (PARTITION BY page_id) AS n FROM cand)
  SELECT page_id, tag_id, (i // 4)::INT AS batch_no, (i // 4 * 4) || '-' || (least(i // 4 * 4 + 4, n) - 1) AS range_label FROM b""")
def _(spark, d):
    return N.batches(raw_candidates(spark, d).select("page_id", "tag_id"), ["page_id"], ["tag_id"], 4)


@query("split_truncated", """WITH b AS (SELECT c_custkey AS batch, 0 AS f, (c_custkey % 7)::INT AS l, (c_nationkey % 7)::INT AS d, list_extract(['ok','truncated','failed'], (c_custkey % 3 + 1)::INT) AS o FROM customer),
  x AS (SELECT *, o = 'truncated' AND l > 0 AND d < 5 AS sp, (ceil((l + 1) / 2.0) - 1)::INT AS mid FROM b)
  SELECT batch, o AS outcome, d AS depth, false AS retry, CASE WHEN o = 'failed' THEN 'retry_exhausted' WHEN o = 'truncated' THEN CASE WHEN d >= 5 THEN 'max_split_depth' ELSE 'truncated_at_size_1' END END AS fallback_reason,
    f AS first, l AS last, f || '-' || l AS range_label FROM x WHERE NOT sp
  UNION ALL SELECT batch, o, d + 1, true, NULL, 0, mid, '0-' || mid FROM x WHERE sp UNION ALL SELECT batch, o, d + 1, true, NULL, mid + 1, l, (mid + 1) || '-' || l FROM x WHERE sp""")
def _(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("batch"), F.lit(0).alias("first"), (k % 7).cast("int").alias("last"), (F.col("c_nationkey") % 7).cast("int").alias("depth"),
                    F.element_at(F.array(*[F.lit(x) for x in ("ok", "truncated", "failed")]), (k % 3 + 1).cast("int")).alias("outcome"))
    return N.split_truncated(rows)


@query("page_category_vote", SQ_REPLY + """, v AS (SELECT page_id, arg_min(CASE WHEN kind = 'wrapped' THEN '메인' END, turn) FILTER (kind = 'wrapped') AS m, max(CASE WHEN page_id % 10 = 0 THEN 'override' END) AS o,
   max(CASE WHEN page_id % 3 = 0 THEN 'hint' END) AS h FROM r GROUP BY 1) SELECT page_id, coalesce(o, m, h, '페이지') AS page_category FROM v""")
def _(spark, d):
    r = responses(spark, d)
    rows = r.select("page_id", F.col("turn").alias("batch_no"), F.when(F.col("kind") == "wrapped", F.lit(" 메인 ")).alias("page_category"),
                    F.when(F.col("page_id") % 10 == 0, F.lit("override")).alias("override"), F.when(F.col("page_id") % 3 == 0, F.lit("hint")).alias("hint"))
    return N.page_category_vote(rows, F.col("override"), F.col("hint"))


@query("registry_delta", """WITH e AS (SELECT event_id, list_extract(['클릭', '찜 하기', '옵션 선택', '리뷰 작성'], (event_id % 4 + 1)::INT) AS n, user_id FROM events)
  SELECT CASE n WHEN '찜 하기' THEN '찜하기' ELSE n END AS event_name, CASE WHEN n IN ('클릭', '찜 하기') THEN 'reused' ELSE 'created' END AS status,
  CASE n WHEN '옵션 선택' THEN 'why-' || arg_min(user_id, event_id) WHEN '리뷰 작성' THEN 'LLM 정의 이벤트' END AS reason FROM e GROUP BY n""")
def _(spark, d):
    n = F.element_at(F.array(*[F.lit(x) for x in ("클릭", "찜 하기", "옵션 선택", "리뷰 작성")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "events").select(n.alias("event_name"), (F.col("event_id") % 4 > 1).alias("registry_created"),
                                            F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("why-"), "user_id")).alias("reason"), F.col("event_id").alias("seq"))
    return N.registry_delta(rows, registry(spark))


# ---------------------------------------------------------------- hints and snapshots

SOURCES = ["stagehand", "skyvern", "scrapegraph"]


def hints(spark, d, offset=0):
    e = table(spark, d, "events")
    return e.select(
        (F.col("user_id") % 50).alias("page_id"), F.get_json_object("props", "$.k").cast("int").alias("tag_id"),
        F.element_at(F.array(*[F.lit(x) for x in SOURCES]), (F.col("event_id") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_name"), (F.col("user_id") % 4 / 4.0).alias("confidence"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n"), "event_id")).alias("note"), F.col("event_id").alias("seq"))


@query("merge_hints", """WITH RECURSIVE h AS (SELECT user_id % 50 AS page_id, json_extract_string(props, '$.k')::INT AS tag_id, event_id % 3 AS src, nullif(event_type, 'error') AS event_name,
    (user_id % 4 / 4.0)::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS note, event_id FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag_id ORDER BY event_id) AS i, CASE src WHEN 0 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS prio,
    CASE src WHEN 0 THEN 'stagehand' WHEN 1 THEN 'skyvern' ELSE 'scrapegraph' END AS source FROM h),
  f AS (SELECT page_id, tag_id, i, source, prio, event_name, confidence, note FROM r WHERE i = 1
    UNION ALL SELECT page_id, tag_id, i, source, prio, event_name, confidence, note FROM (
      SELECT b.page_id, b.tag_id, b.i, unnest([CASE WHEN a.confidence > b.confidence OR (a.confidence = b.confidence AND a.prio >= b.prio)
        THEN {'source': a.source, 'prio': a.prio, 'event_name': coalesce(a.event_name, b.event_name), 'confidence': a.confidence, 'note': nullif(concat_ws(' | ', a.note, b.note), '')}
        ELSE {'source': b.source, 'prio': b.prio, 'event_name': coalesce(b.event_name, a.event_name), 'confidence': b.confidence, 'note': nullif(concat_ws(' | ', b.note, a.note), '')} END], recursive := true)
      FROM f a JOIN r b ON b.page_id = a.page_id AND b.tag_id = a.tag_id AND b.i = a.i + 1))
  SELECT page_id, tag_id, source, event_name, confidence, note FROM f QUALIFY row_number() OVER (PARTITION BY page_id, tag_id ORDER BY i DESC) = 1""")
def _(spark, d):
    return Q.merge_hints(hints(spark, d))


@query("hint_sources", """SELECT user_id % 50 AS page_id, count(*) AS hints, count(DISTINCT json_extract_string(props, '$.k')) AS tags FROM events GROUP BY 1""")
def _(spark, d):
    from functools import reduce

    h = hints(spark, d)
    parts = [h.filter(F.col("source") == x) for x in SOURCES]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    merged = Q.merge_hints(every).groupBy("page_id").agg(F.count(F.lit(1)).alias("tags"))
    return every.groupBy("page_id").agg(F.count(F.lit(1)).alias("hints")).join(merged, "page_id")


def gathered(spark, d):
    """Three sources of hints, of which skyvern fails on an event of type error, one without its table, and one switched off."""
    h = hints(spark, d)
    own = lambda k: h.filter(F.col("source") == SOURCES[k])
    strict = F.when(F.col("event_name").isNull(), F.raise_error(F.lit("hint without a name"))).otherwise(F.col("event_name"))
    return H.gather_hints(spark, {
        "stagehand": lambda: own(0), "scrapegraph": lambda: own(2), "skyvern": lambda: own(1).withColumn("event_name", strict),
        "absent": lambda: table(spark, d, "absent_hints"), "off": None})


@query("hint_source_report", """WITH h AS (SELECT CASE event_id % 3 WHEN 0 THEN 'stagehand' WHEN 1 THEN 'skyvern' ELSE 'scrapegraph' END AS source, event_type,
    json_extract_string(props, '$.k') IS NULL AS lost FROM events),
  g AS (SELECT source, source = 'skyvern' AND bool_or(event_type = 'error') AS bad, count(*) AS n, count_if(lost) AS lost FROM h GROUP BY 1)
  SELECT source, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, CASE WHEN bad THEN 0 ELSE n END AS hints, CASE WHEN bad THEN 0 ELSE lost END AS unplaced, bad AS has_error FROM g
  UNION ALL SELECT 'absent', 'failed', 0, 0, true UNION ALL SELECT 'off', 'off', 0, 0, false""")
def _(spark, d):
    return gathered(spark, d).report.select("source", "status", "hints", "unplaced", F.col("error").isNotNull().alias("has_error"))


@query("surviving_hints", """WITH h AS (SELECT user_id % 50 AS page_id, json_extract_string(props, '$.k')::BIGINT AS tag_id, event_id, (user_id % 4 / 4.0)::DOUBLE AS confidence, event_type,
    CASE event_id % 3 WHEN 0 THEN 'stagehand' WHEN 1 THEN 'skyvern' ELSE 'scrapegraph' END AS source, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS prio FROM events),
  left_over AS (SELECT * FROM h WHERE source <> 'skyvern' OR NOT EXISTS (SELECT 1 FROM h x WHERE x.source = 'skyvern' AND x.event_type = 'error')),
  r AS (SELECT *, count_if(event_id % 2 = 0) OVER (PARTITION BY page_id, tag_id) AS notes,
    row_number() OVER (PARTITION BY page_id, tag_id ORDER BY confidence DESC, prio DESC, event_id) AS i FROM left_over)
  SELECT page_id, tag_id, source, confidence, notes FROM r WHERE i = 1""")
def _(spark, d):
    notes = F.when(F.col("note").isNull(), F.lit(0)).otherwise(F.size(F.split("note", r" \| "))).cast("long")
    return Q.merge_hints(gathered(spark, d).hints).select("page_id", "tag_id", "source", "confidence", notes.alias("notes"))


@query("merge_snapshots", """WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT AS tag_id, event_id, event_type = 'view' AS vis, CASE WHEN event_type <> 'error' THEN (user_id % 7) * (event_id % 5) ELSE 0 END AS area FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, tag_id ORDER BY vis DESC, area DESC, event_id) AS n FROM e) SELECT user_id, tag_id, event_id AS seq, vis AS is_visible FROM r WHERE n = 1""")
def _(spark, d):
    e = table(spark, d, "events")
    box = F.when(F.col("event_type") != "error", G.box(F.lit(0), F.lit(0), F.col("user_id") % 7, F.col("event_id") % 5))
    rows = e.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("tag_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("is_visible"), box.alias("bbox"))
    return Q.merge_snapshots(rows, ["user_id", "tag_id"]).select("user_id", "tag_id", "seq", "is_visible")


@query("finalize_suggestions", """WITH h AS (SELECT user_id % 50 AS page_id, json_extract_string(props, '$.k')::INT AS tag_id, event_id, event_type FROM events),
  m AS (SELECT page_id, tag_id, 'cat' AS category, arg_max('e' || event_id, event_id) AS event_name FROM h WHERE event_type = 'click' AND tag_id % 2 = 0 GROUP BY 1, 2),
  f AS (SELECT DISTINCT page_id, tag_id, 'unknown' AS category, 'unknown_signup' AS event_name FROM h WHERE event_type = 'signup' AND tag_id % 2 = 0)
  SELECT * FROM m UNION ALL SELECT f.* FROM f ANTI JOIN m USING (page_id, tag_id)""")
def _(spark, d):
    h = hints(spark, d)
    allowed = h.select("page_id", "tag_id").distinct().filter("tag_id % 2 = 0")
    clicks = h.filter("event_name = 'click'")
    model = clicks.select("page_id", "tag_id", *[F.lit("cat").alias(k) for k in ("category", "action", "label", "merge_label")],
                          F.concat(F.lit("e"), "seq").alias("event_name"), "seq")
    rest = h.filter("event_name = 'signup'").select("page_id", "tag_id", "event_name").distinct()
    return Q.finalize_suggestions(model, rest, allowed).select("page_id", "tag_id", "category", "event_name")
