"""Queries over naming, labels and keys.  Words come from a fixed pool picked by event id."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, s, table
from webplan.catalog.elements import CHAIN, LM, ONPATH, PLABEL, SECTION, SEGMENT, elements, sq, sq_in
from webplan.catalog.links import SQ_HINTED, pages
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import naming as N

CATEGORIES = [
    "global/gnb/main", "Global/FNB", "hero", "main_banner", "shop/Product_list", "promo slider", "추천 상품", "my_new area",
    " ", "메인 carousel", "cart", "x/y z_w", "top_banner", "GNB", "shop/ Footer ",
]
ACTIONS = ["click_gnb", "click", "slide_nav", "open_menu", "click_buy_now", "view_detail", "Nav_Top", "  ", "상품 담기", "login", "click_"]
NAMES = [
    "클릭", "배너 이동", " 찜 하기", "상세 보기", "click_slug", "메인배너클릭이벤트", "아주긴이름" * 6, "", "a/b", "페이지뷰", "banner_x", "Search", "gnb 메뉴",
]


def pick(values, step):
    i = F.pmod(F.floor(F.col("event_id") / step), F.lit(len(values))) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def sq_pick(values, step):
    return f"list_extract([{', '.join(s(v) for v in values)}], ((event_id // {step}) % {len(values)} + 1)::INT)"


def words(spark, d):
    """event_id, cat, act, name, label: every combination of the word pools occurs."""
    return table(spark, d, "events").select(
        "event_id", "user_id", pick(CATEGORIES, 1).alias("cat"), pick(ACTIONS, 15).alias("act"), pick(NAMES, 165).alias("name"),
        F.concat(F.lit("  Item   "), F.col("user_id"), F.lit(" ")).alias("label"), "props",
    )


WORDS = f"""WITH w AS (SELECT event_id, user_id, props, {sq_pick(CATEGORIES, 1)} AS cat, {sq_pick(ACTIONS, 15)} AS act,
  {sq_pick(NAMES, 165)} AS name, '  Item   ' || user_id || ' ' AS label FROM events)"""


def sq_lookup(mapping, key):
    return f"(CASE {key} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in mapping.items()) + " END)"


def scalar(name, expr, sql, extra=""):
    query(name, f"{WORDS}{extra} SELECT event_id, {sql} FROM w")(lambda spark, d: words(spark, d).select("event_id", *expr()))



sp = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
ck = lambda c: f"lower(regexp_replace({c}, '\\s+', '', 'g'))"
scalar("display_spacing", lambda: [T.display_spacing(F.col("label")).alias("spaced")], "'Item ' || user_id AS spaced")
scalar("compact_key", lambda: [T.compact_key(F.col("label")).alias("compact"), T.compact_key(F.col("cat")).alias("compact_cat")],
       f"'item' || user_id AS compact, {ck('cat')} AS compact_cat")
scalar("canonical_event_name", lambda: [T.canonical_event_name(F.col("name")).alias("canonical")], "regexp_replace(name, '\\s+', '', 'g') AS canonical")

slug = lambda c: (f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), '^_+|_+$', '', 'g'), '_+', '_', 'g')")
GLOBAL_NAV = "regexp_matches(lower(trim(cat)), '^global/(gnb|fnb)')"
scalar("derive_event_name", lambda: [T.derive_event_name(F.col("cat"), F.col("act")).alias("derived")],
       f"""left(CASE WHEN {slug('cat')} = '' AND {slug('act')} = '' THEN 'click_ambiguous_element' WHEN {slug('cat')} = '' THEN {slug('act')}
  WHEN {slug('act')} = '' THEN {slug('cat')} WHEN {GLOBAL_NAV} THEN CASE WHEN {slug('act')} LIKE 'click\\_%' ESCAPE '\\' THEN {slug('act')} ELSE 'click_' || {slug('act')} END
  WHEN {slug('act')} LIKE 'click\\_%' ESCAPE '\\' THEN {slug('cat')} || '_' || substr({slug('act')}, 7) ELSE {slug('cat')} || '_' || {slug('act')} END, 80) AS derived""")

CANON = "regexp_replace(name, '\\s+', '', 'g')"
VALID = (f"(length({CANON}) BETWEEN 1 AND 24 AND NOT regexp_matches({CANON}, '[_/]') AND NOT regexp_matches({CANON}, '(?i)^(slide|click|hero|banner|page)_') "
         f"AND NOT (regexp_matches({CANON}, '(?i)메인|배너|gnb|fnb') AND length({CANON}) > 6) AND regexp_matches({CANON}, '[가-힣]'))")
scalar("is_valid_event_name", lambda: [T.is_valid_event_name(F.col("name")).alias("valid")], f"{VALID} AS valid")

REGISTERED = f"CASE WHEN {CANON} IN {sq_in(T.DEFAULT_REGISTRY)} THEN {CANON} END"


def registry(spark):
    return spark.createDataFrame(list(T.DEFAULT_REGISTRY.items()), "name string, meaning string")


@query("registry_lookup", f"{WORDS} SELECT event_id, {REGISTERED} AS matched FROM w")
def _(spark, d):
    return N.registry_lookup(words(spark, d), "name", registry(spark)).select("event_id", F.col("registry_name").alias("matched"))


@query("sanitize_event_name", f"{WORDS} SELECT event_id, coalesce({REGISTERED}, CASE WHEN {VALID} THEN {CANON} END, '클릭') AS event_name FROM w")
def _(spark, d):
    rows = N.registry_lookup(words(spark, d), "name", registry(spark))
    return rows.select("event_id", T.sanitize_event_name(F.col("name"), F.col("registry_name")).alias("event_name"))


scalar("action_from_event", lambda: [T.action_from_event(T.canonical_event_name(F.col("name"))).alias("action")],
       f"coalesce({sq_lookup(T.EVENT_ACTIONS, CANON)}, 'interact') AS action")

TAIL = "trim(list_extract(string_split(trim(cat), '/'), -1))"
TITLE = lambda x: (f"array_to_string(list_transform(regexp_extract_all({x}, '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') "
                   "THEN upper(w[1]) || w[2:] ELSE w END), '')")
CATSHOW = f"""(CASE WHEN trim(cat) = '' THEN '기타' WHEN {sq_lookup(T.AREA_NAMES, 'lower(trim(cat))')} IS NOT NULL THEN {sq_lookup(T.AREA_NAMES, 'lower(trim(cat))')}
  WHEN {sq_lookup(T.AREA_NAMES, f'lower({TAIL})')} IS NOT NULL THEN {sq_lookup(T.AREA_NAMES, f'lower({TAIL})')}
  WHEN regexp_matches({ck(TAIL)}, '배너|banner|carousel|slider|swiper|hero') THEN CASE WHEN regexp_matches({ck(TAIL)}, '메인|main|hero|top') THEN '메인 배너' ELSE '배너' END
  WHEN regexp_matches({TAIL}, '[가-힣]') THEN {TAIL} ELSE {TITLE(f"replace({TAIL}, '_', ' ')")} END)"""
KEY = "lower(trim(act))"
ACTSHOW = f"""(CASE WHEN {sq_lookup(T.ACTION_NAMES, KEY)} IS NOT NULL THEN {sq_lookup(T.ACTION_NAMES, KEY)}
  WHEN {KEY} = 'click_' THEN '클릭' WHEN starts_with({KEY}, 'click_') THEN replace(substr({KEY}, 7), '_', ' ') || ' 클릭' ELSE replace({KEY}, '_', ' ') END)"""
GENERIC = f"({KEY} = '' OR {KEY} IN {sq_in(T.GENERIC_ACTIONS)} OR starts_with({KEY}, 'click_'))"
scalar("category_display", lambda: [T.category_display(F.col("cat")).alias("shown")], f"{CATSHOW} AS shown")
scalar("action_display", lambda: [T.action_display(F.col("act")).alias("shown")], f"{ACTSHOW} AS shown")
scalar("action_bucket", lambda: [T.action_bucket(F.lit(""), F.col("act"), F.col("name")).alias("bucket"), T.grouping_action_display(F.col("act"), F.col("name")).alias("shown")],
       f"""CASE WHEN trim(act) <> '' AND NOT {GENERIC} THEN trim(act) WHEN trim(name) <> '' THEN 'evt::' || trim(name) WHEN trim(act) <> '' THEN trim(act) ELSE 'click' END AS bucket,
  CASE WHEN {GENERIC} AND trim(name) <> '' THEN trim(name) ELSE {ACTSHOW} END AS shown""")
scalar("is_redundant_action", lambda: [T.is_redundant_action(F.col("cat"), F.col("act")).alias("redundant")],
       f"""({KEY} = '' OR {KEY} IN {sq_in(T.GENERIC_ACTIONS)} OR ({GLOBAL_NAV} AND (starts_with({KEY}, 'click_') OR contains({KEY}, 'nav')))
   OR ({ck(CATSHOW)} <> '' AND replace({ck(ACTSHOW)}, '메뉴', '') <> '' AND (contains(replace({ck(ACTSHOW)}, '메뉴', ''), {ck(CATSHOW)})
   OR contains({ck(CATSHOW)}, replace({ck(ACTSHOW)}, '메뉴', ''))))) AS redundant""")
scalar("group_display_label", lambda: [T.group_display_label(F.col("cat"), F.col("act"), F.col("user_id") % 3, F.col("label")).alias("shown"),
                                       T.group_display_label(F.col("cat"), F.col("act"), F.lit(1), F.lit(" ")).alias("unlabelled")],
       f"""CASE WHEN {GLOBAL_NAV} THEN CASE WHEN starts_with(lower(cat), 'global/fnb') THEN 'Footer' ELSE 'GNB' END
  WHEN user_id % 3 > 1 THEN {CATSHOW} ELSE trim(label) END AS shown,
  CASE WHEN {GLOBAL_NAV} THEN CASE WHEN starts_with(lower(cat), 'global/fnb') THEN 'Footer' ELSE 'GNB' END ELSE {CATSHOW} END AS unlabelled""")

D_ = lambda c: f"coalesce(nullif(trim({c}), ''), '-')"
scalar("key_builders", lambda: [
    T.group_key(F.col("cat"), F.col("act"), F.col("name")).alias("group_key"), T.row_key(F.col("cat"), F.col("name"), F.col("cat"), F.col("act"), F.col("label"), F.lit(None).cast("string")).alias("row_key"),
    T.event_doc_key(F.col("cat"), F.col("name")).alias("doc_key"), T.candidate_key(F.col("cat"), F.col("act"), F.col("label")).alias("candidate_key"),
    T.selection_key(F.concat(F.lit("http://x::"), F.col("user_id")), F.col("event_id")).alias("selection_key"),
    T.parse_selection_key(T.selection_key(F.concat(F.lit("http://x::"), F.col("user_id")), F.col("event_id")))["page_key"].alias("page_key"),
    T.parse_selection_key(T.selection_key(F.concat(F.lit("http://x::"), F.col("user_id")), F.col("event_id")))["tag_id"].alias("tag_id"),
    T.parse_selection_key(F.lit("no-key"))["page_key"].alias("bad")],
       f"""trim(cat) || '::' || trim(act) || CASE WHEN trim(name) <> '' THEN '::' || trim(name) ELSE '' END AS group_key,
  cat || '|' || name || '|' || {D_('cat')} || '|' || {D_('act')} || '|' || {D_('label')} || '|-' AS row_key, cat || '/' || name AS doc_key,
  lower({sp('cat')}) || '|' || lower({sp('act')}) || '|' || lower({sp('label')}) AS candidate_key,
  'http://x::' || user_id || '::' || event_id AS selection_key, 'http://x::' || user_id AS page_key, event_id::INT AS tag_id, NULL::VARCHAR AS bad""")
scalar("cells", lambda: [T.cell(F.col("cat")).alias("cell"), T.taxonomy_display(F.when(F.col("user_id") % 2 == 0, F.lit("FNB")).otherwise(F.col("cat"))).alias("shown")],
       f"{D_('cat')} AS cell, CASE WHEN user_id % 2 = 0 THEN 'Footer' ELSE cat END AS shown")
scalar("safe_names", lambda: [
    T.sheet_name(F.concat(F.col("cat"), F.lit(":[*]?"), F.col("act"), F.col("name"))).alias("sheet"),
    T.snapshot_name(F.concat(F.col("cat"), F.lit(".kr")), F.lit("2024-01-02T03:04:05.678Z")).alias("snapshot"),
    T.action_image_key(F.col("name"), F.col("cat"), F.col("act"), F.col("user_id")).alias("image_key")],
       """left(regexp_replace(cat || ':[*]?' || act || name, '[\\\\/?*\\[\\]:]', '_', 'g'), 31) AS sheet,
  regexp_replace(cat || '.kr', '[^a-zA-Z0-9.-]', '_', 'g') || '-2024-01-02T03-04-05-678Z.json' AS snapshot,
  left(regexp_replace(name || '_' || cat || '_' || act || '_' || user_id, '[^a-zA-Z0-9._-]+', '_', 'g'), 68) || '_sq' AS image_key""")
scalar("hook_slug", lambda: [T.hook_slug(F.concat(F.col("cat"), F.col("name"))).alias("hook"), T.hook_slug(F.lit("!!")).alias("empty")],
       """'data-testid="' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(trim(cat || name)), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 24), ''), 'el') || '"' AS hook,
  'data-testid="el"' AS empty""")
scalar("mask_key", lambda: [T.mask_key(F.concat(F.col("label"), F.col("event_id"))).alias("masked")],
       "CASE WHEN length(trim(label || event_id)) <= 8 THEN '****' ELSE '…' || right(trim(label || event_id), 6) END AS masked")
scalar("resolve_page_category", lambda: [T.resolve_page_category(F.col("name"), F.col("cat")).alias("page_category")],
       "CASE WHEN lower(trim(cat)) LIKE 'global/gnb%' THEN 'GNB' WHEN lower(trim(cat)) LIKE 'global/fnb%' THEN 'Footer' ELSE coalesce(nullif(trim(name), ''), '페이지') END AS page_category")
VIEWS = ["pc", "PC", "mo", "MO", "tablet", ""]
scalar("parse_viewport", lambda: [
    T.parse_viewport(pick(VIEWS, 1)).alias("viewport"), T.platform_label(T.parse_viewport(pick(VIEWS, 1))).alias("platform"),
    F.array_join(T.default_viewports(F.array(pick(VIEWS, 1), pick(VIEWS, 2), F.lit("x"))), ",").alias("defaults")],
       f"""CASE lower({sq_pick(VIEWS, 1)}) WHEN 'pc' THEN 'pc' WHEN 'mo' THEN 'mo' END AS viewport,
  CASE WHEN lower({sq_pick(VIEWS, 1)}) = 'mo' THEN 'MO' ELSE 'PC' END AS platform,
  CASE WHEN {sq_pick(VIEWS, 1)} IN ('pc','mo') AND {sq_pick(VIEWS, 2)} IN ('pc','mo') AND {sq_pick(VIEWS, 1)} <> {sq_pick(VIEWS, 2)}
   THEN {sq_pick(VIEWS, 1)} || ',' || {sq_pick(VIEWS, 2)} WHEN {sq_pick(VIEWS, 1)} IN ('pc','mo') THEN {sq_pick(VIEWS, 1)}
   WHEN {sq_pick(VIEWS, 2)} IN ('pc','mo') THEN {sq_pick(VIEWS, 2)} ELSE 'pc' END AS defaults""")

SECTIONS = ["메인 배너", "추천 상품", "", "Hero Banner zone", "소개", "캐러셀"]
PATHS = ["main>div.swiper>a", "header>nav>a", "main>div.product-card>a", "section>div.main-visual", "div.slick-list>a"]
MARKS = ["main", "content", "gnb"]
NB = "(?i)추천|상품|product|recommend|card|wish|장바구니|혜택|프로모션|이벤트\\s*배너"
BANNER = (f"CASE WHEN sec <> '' AND regexp_matches(sec, {s(NB)}) THEN false WHEN sec <> '' AND regexp_matches(sec, {s(T.BANNER_HEADING_PATTERN)}) THEN true "
          f"WHEN regexp_matches(pth || ' ', {s(NB)}) THEN false ELSE regexp_matches(pth || ' ', {s(T.BANNER_PATH_PATTERN)}) END")


@query("banner_context", f"""{WORDS}, x AS (SELECT event_id, {sq_pick(SECTIONS, 1)} AS sec, {sq_pick(PATHS, 6)} AS pth, {sq_pick(MARKS, 30)} AS lm FROM w),
  y AS (SELECT *, {BANNER} AS b FROM x) SELECT event_id, b AS banner, CASE WHEN b THEN CASE WHEN (lm = 'main' OR regexp_matches(pth, '\\bmain\\b')) AND
  regexp_matches(sec || ' ' || pth, '(?i)메인|main|hero|visual|top|rolling') THEN '메인 배너' ELSE '배너' END END AS category FROM y""")
def _(spark, d):
    sec, pth, lm = pick(SECTIONS, 1), pick(PATHS, 6), pick(MARKS, 30)
    return words(spark, d).select("event_id", T.is_banner_context(sec, pth, F.lit("")).alias("banner"),
                                  T.banner_category(sec, pth, F.lit(""), lm).alias("category"))


@query("infer_role", sq("z AS (SELECT 1) SELECT page_id, tag_id, CASE tag WHEN 'button' THEN 'button' WHEN 'a' THEN 'link' WHEN 'input' THEN 'textbox' END AS role FROM ids"))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", T.infer_role(F.col("tag")).alias("role"))


@query("dom_path_prompt", sq(LM + SECTION.replace(CHAIN, "") + f"""pn AS (SELECT *, {SEGMENT} AS seg, {PLABEL} AS pl FROM ct WHERE {ONPATH}),
  dl AS (SELECT page_id, pos, pl, min(k) AS k FROM pn WHERE pl <> '' GROUP BY ALL),
  l AS (SELECT page_id, pos, array_to_string(list_slice(list(pl ORDER BY k DESC), 1, 6), ', ') AS labels FROM dl GROUP BY ALL),
  p AS (SELECT page_id, pos, string_agg(seg, '>' ORDER BY k DESC) AS path FROM pn GROUP BY ALL)
  SELECT page_id, tag_id, ' dom_path="' || path || '" landmark="' || landmark || '(' || {sq_lookup(T.LANDMARK_NAMES, 'landmark')} || ')"'
   || coalesce(' parent_labels="' || labels || '"', '') || coalesce(' section="' || section_heading || '"', '') AS prompt
  FROM ids JOIN p USING (page_id, pos) JOIN lm USING (page_id, pos) LEFT JOIN l USING (page_id, pos) LEFT JOIN sh USING (page_id, pos)"""))
def _(spark, d):
    line = T.dom_path_prompt(F.col("dom_path"), F.col("landmark"), F.array_join("parent_labels", ", "), F.col("section_heading"))
    return elements(spark, d).select("page_id", "tag_id", line.alias("prompt"))


@query("log_lines", f"""{WORDS} SELECT event_id, '- tag:' || event_id || ' source=skyvern' || CASE WHEN name <> '' THEN ' suggested_name="' || name || '"' ELSE '' END
   || ' confidence=' || printf('%.2f', (user_id % 100) / 100.0) AS hint,
  '- tag:' || event_id || ' — **' || cat || '** (a' || CASE WHEN name <> '' THEN ', ' || name ELSE '' END || ')' AS candidate,
  '[merge] kept=' || event_id || ' merged=[' || user_id || ', 7] reason=' || CASE WHEN user_id % 2 = 0 THEN 'same_href url="' || cat || '"' ELSE 'same_merge_label merge_label="' || name || '"' END AS merged,
  '[merge] kept=' || event_id || ' skipped_diff_area button="' || name || '" (' || cat || ')' AS skipped FROM w""")
def _(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    reason = F.when(u % 2 == 0, F.lit("same_href")).otherwise(F.lit("same_merge_label"))
    return words(spark, d).select(
        "event_id", T.hint_line(i, F.lit("skyvern"), F.col("name"), (u % 100) / 100.0, F.lit("")).alias("hint"),
        T.candidate_line(i, F.col("cat"), F.lit("a"), F.col("name")).alias("candidate"),
        T.merge_line(i, F.array(u.cast("string"), F.lit("7")), reason, F.col("cat"), F.col("name")).alias("merged"),
        T.skip_line(i, F.lit("diff_area"), F.col("name"), F.col("cat")).alias("skipped"),
    )
