"""Queries that turn page source into element tables.

The corpus has plain articles only, so most queries read ``rich_pages``: the same pages with a
block of controls, menus and forms inserted before every article.  The SQL twins rebuild
containment with interval joins, independently of the windows used by the jobs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, s, sq_encode, sq_parse, table
from webplan.catalog.links import SQ_CLEAN, sq_decode
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import dom as D

BLOCK = (
    '<header id="top#ID#" class="gnb-wrap"><a href="/home#ID#" class="btn main">Home <b>now</b></a>'
    '<button aria-haspopup="true" aria-expanded="false">Menu</button><div class="dropdown" style="display:none">'
    '<h3>More</h3><a href="/m1">One</a><a href="/m2" aria-label="Two">2</a></div></header>'
    '<main><section aria-label="Deals #ID#"><div role="button"><a href="https://shop.example.com/p?q=#ID#">'
    '<img src="/i/pic.png?x=1" alt="Pic"></a></div><button id="b#ID#" data-testid="go">Buy &amp; go</button>'
    '<div class="cursor-pointer card"><p>Tap me</p></div><span class="cursor-pointer"><img alt="photo.jpg"></span>'
    '<label>Mail<input type="text" name="mail" placeholder="Mail"></label><input type="hidden" name="h">'
    '<select name="s"><option>1</option></select></section></main>'
    '<div class="drawer hidden lg:hidden"><a href="#">x</a><a href="/d" onclick="go()">Drawer</a></div>'
    '<form><input type="password"></form><footer class="fixed bottom-0"><a>plain</a>'
    '<a href="/home#ID#" class="css-1 foot">Home</a><p>login</p></footer>'
)


def rich_pages(spark, d):
    block = F.replace(F.lit(BLOCK), F.lit("#ID#"), F.col("page_id").cast("string"))
    html = F.replace("html", F.lit("<article>"), F.concat(block, F.lit("<article>")))
    return table(spark, d, "pages").select("page_id", "url", html.alias("html"))


def sq_in(values):
    return "(" + ", ".join(s(v) for v in values) + ")"


def at(name):
    return f"regexp_extract(tok, '\\s{name}=\"([^\"]*)\"', 1)"


def has(name):
    return f"regexp_matches(tok, '\\s{name}=\"')"


def sq_spans(html):
    return f"""WITH rp AS (SELECT page_id, url, {html} AS html FROM pages),
cl AS (SELECT page_id, regexp_replace({SQ_CLEAN.replace("' '", "''")}, '(?i)<!doctype[^>]*>', '', 'g') AS html FROM rp),
tk0 AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+') AS toks FROM cl)),
tk1 AS (SELECT page_id, pos, tok, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:-]*)', 1)) AS tag FROM tk0),
tk AS (SELECT *, CASE WHEN tag = '' THEN 'text' WHEN tok LIKE '</%' THEN 'close' WHEN tag IN {sq_in(D.VOID_TAGS)} THEN 'void'
  ELSE 'open' END AS kind FROM tk1 WHERE tag NOT IN {sq_in(D.FORMAT_TAGS)}),
lv AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS lvl
  FROM tk WHERE kind IN ('open', 'close')),
cl1 AS (SELECT o.page_id, o.pos, o.tag, o.tok, min(c.pos) AS cend FROM lv o LEFT JOIN lv c ON c.page_id = o.page_id AND c.tag = o.tag
  AND c.kind = 'close' AND c.lvl = o.lvl - 1 AND c.pos > o.pos WHERE o.kind = 'open' GROUP BY ALL),
nx AS (SELECT *, CASE WHEN tag IN {sq_in(D.SELF_ENDING_TAGS)} THEN lead(pos) OVER (PARTITION BY page_id, tag ORDER BY pos) END AS nextsame FROM cl1),
sp AS (SELECT o.page_id, o.pos, o.tag, o.tok, coalesce(o.cend, least(coalesce(o.nextsame, {D.PAGE_END}), coalesce(min(c.cend), {D.PAGE_END}))) AS pend
  FROM nx o LEFT JOIN nx c ON o.cend IS NULL AND c.page_id = o.page_id AND c.pos < o.pos AND o.pos < c.cend
  GROUP BY o.page_id, o.pos, o.tag, o.tok, o.cend, o.nextsame),
allel AS (SELECT page_id, pos, tag, tok, pend FROM sp UNION ALL SELECT page_id, pos, tag, tok, NULL FROM tk WHERE kind = 'void'),
anc AS (SELECT e.page_id, e.pos, a.pos AS apos, a.pend AS aend, a.tag AS atag, a.tok AS atok,
  row_number() OVER (PARTITION BY e.page_id, e.pos ORDER BY a.pos DESC) AS k
  FROM allel e JOIN sp a ON a.page_id = e.page_id AND a.pos < e.pos AND e.pos < a.pend),
el AS (SELECT e.*, (SELECT count(*) FROM anc WHERE anc.page_id = e.page_id AND anc.pos = e.pos) + 1 AS depth,
  lower({at('class')}) AS cls, lower(trim({at('role')})) AS role, CASE WHEN {has('href')} THEN trim({sq_decode(at('href'))}) END AS href
  FROM allel e),
tx AS (SELECT e.page_id, e.pos, trim(regexp_replace(string_agg({sq_decode('t.tok')}, '' ORDER BY t.pos), '\\s+', ' ', 'g')) AS txt
  FROM sp e JOIN tk t ON t.page_id = e.page_id AND t.kind = 'text' AND e.pos < t.pos AND t.pos < e.pend GROUP BY ALL),
"""


RICH_HTML = f"replace(html, '<article>', replace({s(BLOCK)}, '#ID#', page_id::VARCHAR) || '<article>')"
PLAIN = sq_spans("html")
SPANS = sq_spans(RICH_HTML)
LEAF = ("((tag IN ('a','area') AND href IS NOT NULL) OR tag IN ('button','select','textarea','summary') OR role IN ('button','link') "
        f"OR (tag = 'input' AND lower({at('type')}) <> 'hidden'))")


def inside(tag):
    return f"EXISTS (SELECT 1 FROM anc x WHERE x.page_id = el.page_id AND x.pos = el.pos AND x.atag = '{tag}')"


ELEMENTS = SPANS + f"""
fl AS (SELECT el.*, coalesce(tx.txt, '') AS txt, {LEAF} AS leaf,
  ({LEAF} OR (tag = 'a' AND (regexp_matches(cls, 'btn|button') OR {inside('nav')} OR {inside('header')} OR {inside('footer')}))
   OR role IN {sq_in(D.CONTROL_ROLES)} OR tag = 'label' OR {has('onclick')} OR {has('data-action')} OR cls LIKE '%swiper-button%') AS inter
  FROM el LEFT JOIN tx ON tx.page_id = el.page_id AND tx.pos = el.pos),
wl AS (SELECT f.*, EXISTS (SELECT 1 FROM fl g WHERE g.page_id = f.page_id AND g.leaf AND f.pos < g.pos AND g.pos < f.pend) AS has_leaf,
  (tag = 'a' AND (coalesce(href,'') NOT IN ('', '#') OR regexp_matches(cls, '\\bbtn\\b|button|link-button'))) OR tag = 'button'
    OR role IN ('button','link') AS kept FROM fl f),
pb AS (SELECT w.*, (SELECT trim(t.txt) FROM allel p JOIN tx t USING (page_id, pos) WHERE p.page_id = w.page_id AND p.tag = 'p' AND w.pos < p.pos
    AND p.pos < w.pend ORDER BY p.pos LIMIT 1) AS ptext FROM wl w),
tg AS (SELECT *, CASE WHEN inter AND NOT (has_leaf AND NOT kept) THEN 1 WHEN NOT inter AND tag IN ('div','span','li')
    AND cls LIKE '%cursor-pointer%' AND NOT has_leaf AND length(coalesce(ptext, '')) >= 2 THEN 2 END AS phase FROM pb),
ids AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY phase, pos)::INT AS tag_id FROM tg WHERE phase IS NOT NULL),
"""


def rich_elements(spark, d):
    return D.page_elements(rich_pages(spark, d))


def sq(body):
    return ELEMENTS + body


@query("page_tokens", PLAIN + f"""z AS (SELECT 1) SELECT page_id, pos::INT AS pos, kind, tag, CASE WHEN kind = 'text' THEN {sq_decode('tok')}
  ELSE tok END AS token FROM tk""")
def _(spark, d):
    return D.page_tokens(table(spark, d, "pages"))


@query("element_spans", PLAIN + """z AS (SELECT 1) SELECT page_id, pos::INT AS start, coalesce(pend, pos)::INT AS "end", depth::INT AS depth,
  tag FROM el""")
def _(spark, d):
    return D.element_spans(table(spark, d, "pages"))


@query("interactive", sq("z AS (SELECT 1) SELECT page_id, pos::INT AS start, tag, leaf FROM fl WHERE inter"))
def _(spark, d):
    return D.interactive(rich_pages(spark, d)).select("page_id", "start", "tag", "leaf")


@query("drop_wrappers", sq("z AS (SELECT 1) SELECT page_id, pos::INT AS start, tag FROM wl WHERE inter AND NOT (has_leaf AND NOT kept)"))
def _(spark, d):
    return D.drop_wrappers(D.interactive(rich_pages(spark, d))).select("page_id", "start", "tag")


@query("pointer_blocks", sq("z AS (SELECT 1) SELECT page_id, pos::INT AS start, tag, ptext AS label FROM tg WHERE phase = 2"))
def _(spark, d):
    rows = rich_elements(spark, d).filter(D.is_pointer_block() & ~F.col("interactive"))
    return rows.select("page_id", "start", "tag", D._pointer_label().alias("label"))


LABEL = f"""left(coalesce(nullif(left(CASE WHEN phase = 2 THEN ptext ELSE txt END, 120), ''), nullif({at('aria-label')}, ''),
  nullif({at('placeholder')}, ''), nullif({at('alt')}, ''), CASE WHEN im.f THEN 'pic.png' END,
  nullif({at('data-testid')}, ''), '[' || tag || CASE WHEN {at('type')} <> '' THEN ' type=' || {at('type')} ELSE '' END || ']'), 120)"""
IMG = "lb AS (SELECT i.*, (tok LIKE '%shop.example%' OR (tag = 'div' AND role = 'button')) AS f FROM ids i),"
CUT = lambda k, n: f"CASE WHEN {at(k)} <> '' THEN '{k}=' || left({at(k)}, {n}) END"
HINTS = (f"left(concat_ws(' | ', {CUT('aria-label', 80)}, {CUT('placeholder', 80)}, CASE WHEN im.f THEN 'img=pic.png' END, {CUT('role', 99)}, "
         f"{CUT('type', 99)}, {CUT('name', 60)}, {CUT('id', 60)}, CASE WHEN {at('href')} <> '' THEN 'href=' || left({sq_decode(at('href'))}, 80) END, "
         f"{CUT('data-testid', 60)}), 240)")


@query("assign_tag_ids", sq("""z AS (SELECT 1)
  SELECT page_id, tag_id, pos::INT AS start, tag, phase, 0 AS dropped_by_cap FROM ids"""))
def _(spark, d):
    return D.assign_tag_ids(rich_elements(spark, d)).select("page_id", "tag_id", "start", "tag", "phase", "dropped_by_cap")


@query("element_label", sq(f"{IMG} z AS (SELECT 1) SELECT page_id, tag_id, {LABEL} AS label FROM lb im"))
def _(spark, d):
    return D.assign_tag_ids(rich_elements(spark, d)).select("page_id", "tag_id", "label")


@query("identification_hints", sq(f"{IMG} z AS (SELECT 1) SELECT page_id, tag_id, {HINTS} AS identification_hints FROM lb im"))
def _(spark, d):
    return D.assign_tag_ids(rich_elements(spark, d)).select("page_id", "tag_id", "identification_hints")


# ---------------------------------------------------------------- ancestors


def elements(spark, d):
    return D.element_table(rich_pages(spark, d))


CHAIN = """ch AS (SELECT page_id, pos, pos AS apos, pend AS aend, tag AS atag, tok, 0 AS k FROM ids
  UNION ALL SELECT i.page_id, i.pos, x.apos, x.aend, x.atag, x.atok, x.k FROM ids i JOIN anc x ON x.page_id = i.page_id AND x.pos = i.pos),
ct AS (SELECT ch.*, coalesce(t.txt, '') AS txt FROM ch LEFT JOIN tx t ON t.page_id = ch.page_id AND t.pos = ch.apos),
"""
STABLE = lambda c: f"({c} <> '' AND NOT regexp_matches({c}, '^[0-9]+$') AND length({c}) <= 64)"
CLASS1 = f"list_extract(list_filter(string_split(trim({at('class')}), ' '), lambda c: c <> '' AND NOT regexp_matches(c, {s(D.UNSTABLE_CLASS)})), 1)"
SEGMENT = f"""CASE WHEN {STABLE(at('id'))} THEN atag || '#' || left({at('id')}, 32)
  WHEN {at('aria-label')} <> '' THEN atag || '.' || left(regexp_replace({at('aria-label')}, '\\s+', '', 'g'), 20)
  WHEN {CLASS1} IS NOT NULL THEN atag || '.' || left({CLASS1}, 24)
  WHEN txt <> '' AND atag IN ('a','button','li','span','label','summary') THEN atag || '.' || regexp_replace(left(txt, 16), '[^\\p{{L}}\\p{{N}}]+', '', 'g')
  ELSE atag END"""
PLABEL = f"""CASE WHEN {at('aria-label')} <> '' THEN left({at('aria-label')}, 40) WHEN atag IN ('nav','header','footer','li','button','a')
  THEN left(txt, 30) ELSE '' END"""
ONPATH = f"""atag <> 'html' AND k < 10 AND (k = 0 OR atag IN {sq_in(D.REGION_TAGS)} OR {STABLE(at('id'))} OR {at('role')} <> ''
  OR atag NOT IN ('html','body','div','span'))"""


@query("dom_path", sq(CHAIN + f"""pn AS (SELECT *, {SEGMENT} AS seg, {PLABEL} AS pl FROM ct WHERE {ONPATH}),
  dl AS (SELECT page_id, pos, pl, min(k) AS k FROM pn WHERE pl <> '' GROUP BY ALL),
  l AS (SELECT page_id, pos, array_to_string(list_slice(list(pl ORDER BY k DESC), 1, 6), '~') AS labels FROM dl GROUP BY ALL),
  p AS (SELECT page_id, pos, string_agg(seg, '>' ORDER BY k DESC) AS path FROM pn GROUP BY ALL)
  SELECT page_id, tag_id, path AS dom_path, coalesce(labels, '') AS parent_labels FROM ids JOIN p USING (page_id, pos) LEFT JOIN l USING (page_id, pos)"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "dom_path", F.array_join("parent_labels", "~").alias("parent_labels"))


LANDMARK = f"""CASE WHEN bool_or(atag = 'header') OR bool_or(regexp_matches(lower({at('class')} || ' ' || {at('aria-label')}), {s(D.DRAWER_PATTERN)})) THEN 'gnb'
  WHEN bool_or(atag = 'footer') THEN 'fnb' WHEN bool_or(atag = 'nav') THEN 'nav' WHEN bool_or(atag = 'main') THEN 'main' ELSE 'content' END"""
LM = CHAIN + f"lm AS (SELECT page_id, pos, {LANDMARK} AS landmark FROM ct WHERE k < 12 GROUP BY ALL),"


@query("landmark", sq(LM + "z AS (SELECT 1) SELECT page_id, tag_id, landmark FROM ids JOIN lm USING (page_id, pos)"))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "landmark")


@query("landmark_from_path", sq(CHAIN + f"""pn AS (SELECT page_id, pos, k, {SEGMENT} AS seg FROM ct WHERE {ONPATH}),
  p AS (SELECT page_id, pos, string_agg(seg, '>' ORDER BY k DESC) AS path FROM pn GROUP BY ALL)
  SELECT page_id, tag_id, CASE WHEN regexp_matches(path, '(?i)\\bheader\\b') THEN 'gnb' WHEN regexp_matches(path, '(?i)\\bfooter\\b') THEN 'fnb'
  WHEN regexp_matches(path, '(?i)\\bnav\\b') THEN 'nav' WHEN regexp_matches(path, '(?i)\\bmain\\b') THEN 'main' ELSE 'content' END AS landmark
  FROM ids JOIN p USING (page_id, pos)"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", D.landmark_from_path(F.col("dom_path")).alias("landmark"))


SECTION = CHAIN + f"""sc AS (SELECT page_id, pos, k, coalesce(nullif({at('aria-label')}, ''), (SELECT t.txt FROM sp h JOIN tx t USING (page_id, pos)
    WHERE h.page_id = ct.page_id AND h.tag IN {sq_in(D.HEADINGS)} AND ct.apos < h.pos AND h.pos < ct.aend ORDER BY h.pos LIMIT 1)) AS title
  FROM ct WHERE k < 8 AND atag IN ('section','main','article','aside')),
sh AS (SELECT page_id, pos, left(arg_min(title, k), 80) AS section_heading FROM sc WHERE title <> '' GROUP BY ALL),
"""


@query("section_heading", sq(SECTION + "z AS (SELECT 1) SELECT page_id, tag_id, section_heading FROM ids LEFT JOIN sh USING (page_id, pos)"))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "section_heading")


@query("parental_context", sq(CHAIN + f"""pc AS (SELECT page_id, pos, string_agg(coalesce(nullif({at('aria-label')}, ''), nullif({at('id')}, ''), atag), ' > '
    ORDER BY k DESC) AS c FROM ct WHERE k BETWEEN 1 AND 4 AND atag IN ('nav','header','footer','main','section','form','aside') GROUP BY ALL)
  SELECT page_id, tag_id, coalesce(c, 'body') AS parental_context FROM ids LEFT JOIN pc USING (page_id, pos)"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "parental_context")


NTH = """par AS (SELECT e.page_id, e.pos, e.tag, x.apos AS parent FROM allel e LEFT JOIN anc x ON x.page_id = e.page_id AND x.pos = e.pos AND x.k = 1),
nt AS (SELECT page_id, pos, tag, row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY pos)::INT AS nth,
  count(*) OVER (PARTITION BY page_id, parent, tag)::INT AS same_tag FROM par),
"""


@query("nth_of_type", PLAIN + NTH + "z AS (SELECT 1) SELECT page_id, pos::INT AS start, nth, same_tag FROM nt")
def _(spark, d):
    return D.with_siblings(D.page_elements(table(spark, d, "pages"))).select("page_id", "start", "nth", "same_tag")


CLASSES = f"list_filter(string_split(trim({at('class')}), ' '), lambda c: c <> '' AND NOT regexp_matches(c, {s(D.UNSTABLE_CLASS)}))"
SELECTOR = NTH + f"""sl AS (SELECT i.*, 
  CASE WHEN {STABLE(at('id'))} THEN '#' || {at('id')} WHEN {at('data-testid')} <> '' THEN '[data-testid="' || {at('data-testid')} || '"]'
   WHEN {at('aria-label')} <> '' THEN i.tag || '[aria-label="' || {at('aria-label')} || '"]'
   WHEN len({CLASSES}) > 0 THEN i.tag || '.' || array_to_string({CLASSES}, '.') ELSE i.tag || ':nth-of-type(' || nth || ')' END AS selector_hint,
  CASE WHEN {STABLE(at('id'))} OR {at('data-testid')} <> '' THEN 'high' WHEN {at('aria-label')} <> '' OR len({CLASSES}) > 0 THEN 'medium' ELSE 'low' END AS stability,
  CASE WHEN {STABLE(at('id'))} OR NOT ({at('data-testid')} <> '' OR {at('aria-label')} <> '' OR len({CLASSES}) > 0) THEN ''
    ELSE i.tag || ':nth-of-type(' || nth || ')' END AS fallbacks
  FROM ids i JOIN nt ON nt.page_id = i.page_id AND nt.pos = i.pos),
"""
HOOK = """'data-testid="' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(txt), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g'), 24), ''), 'el') || '"'"""


@query("selector_package", sq(SELECTOR + f"""z AS (SELECT 1) SELECT page_id, tag_id, selector_hint, stability AS selector_stability, fallbacks AS selectors_fallback,
  CASE WHEN stability <> 'high' THEN {HOOK} END AS recommended_data_hook FROM sl"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "selector_hint", "selector_stability",
                                     F.array_join("selectors_fallback", "~").alias("selectors_fallback"), "recommended_data_hook")


@query("selector_uniqueness", sq(SELECTOR + """z AS (SELECT 1) SELECT page_id, tag_id, count(*) OVER (PARTITION BY page_id, selector_hint)::INT AS hint_match_count,
  count(*) OVER (PARTITION BY page_id, selector_hint) = 1 AS hint_unique FROM sl"""))
def _(spark, d):
    return D.selector_uniqueness(elements(spark, d)).select("page_id", "tag_id", "hint_match_count", "hint_unique")


PSEG = f"""CASE WHEN {STABLE(at('id'))} THEN '#' || {at('id')} ELSE atag || CASE WHEN len({CLASSES}) > 0 THEN '.' ||
  replace(array_to_string(list_slice({CLASSES}, 1, 3), '.'), ':', '\\:') ELSE '' END || CASE WHEN same_tag > 1 THEN ':nth-of-type(' || nth || ')' ELSE '' END END"""


@query("ancestor_selectors", sq(NTH + CHAIN + f"""sg AS (SELECT ct.page_id, ct.pos, k, {PSEG} AS seg FROM ct JOIN nt ON nt.page_id = ct.page_id AND nt.pos = ct.apos
    WHERE k < 6 AND atag <> 'html'),
  mx AS (SELECT page_id, pos, count(*) AS n FROM sg GROUP BY ALL),
  dp AS (SELECT DISTINCT page_id, pos, least(d, n) AS depth FROM mx, (VALUES (2),(3),(4),(5),(6)) v(d)),
  pa AS (SELECT sg.page_id, sg.pos, depth, string_agg(seg, ' > ' ORDER BY k DESC) AS path FROM sg JOIN dp ON dp.page_id = sg.page_id AND dp.pos = sg.pos AND k < depth GROUP BY ALL),
  un AS (SELECT *, count(*) OVER (PARTITION BY page_id, path) AS c FROM pa)
  SELECT page_id, pos::INT AS start, arg_min(path, depth) FILTER (c = 1) AS resolved_selector, min(depth) FILTER (c = 1)::INT AS resolved_depth FROM un GROUP BY ALL"""))
def _(spark, d):
    return D.ancestor_selectors(elements(spark, d)).select("page_id", "start", "resolved_selector", "resolved_depth")


NAV = CHAIN + f"""own AS (SELECT page_id, pos, arg_min({sq_decode(at('href'))}, k) AS href FROM ct WHERE atag = 'a' AND {at('href')} NOT IN ('', '#') GROUP BY ALL),
inn AS (SELECT i.page_id, i.pos, arg_min(e.href, e.pos) AS href FROM ids i JOIN el e ON e.page_id = i.page_id AND e.tag = 'a' AND e.href IS NOT NULL
  AND i.pos < e.pos AND e.pos < i.pend GROUP BY ALL),
tgt AS (SELECT ids.page_id, ids.pos, ids.tag_id, ids.tag, ids.role, coalesce(own.href, inn.href) AS href FROM ids LEFT JOIN own USING (page_id, pos) LEFT JOIN inn USING (page_id, pos)),
""" + sq_parse("u", "pages", "url", "page_id") + f""",
hq AS (SELECT t.*, u.host, split_part(split_part(href, '#', 1), '?', 1) AS p, CASE WHEN contains(href, '?') THEN '?' || split_part(href, '?', 2) ELSE '' END AS q
  FROM tgt t JOIN u USING (page_id)),
lk AS (SELECT *, CASE WHEN href LIKE 'https://%' THEN p || q ELSE ({sq_encode('p', U.PATH_UNSAFE)}) || q END AS link_url FROM hq),
"""


@query("nav_link", sq(NAV + "z AS (SELECT 1) SELECT page_id, tag_id, link_url FROM lk"))
def _(spark, d):
    rows = elements(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    link = D.nav_link(F.col("chain"), F.col("inner_href"), F.col("identification_hints"), F.col("url"))
    return rows.select("page_id", "tag_id", link.alias("link_url"))


@query("same_href_wrappers", sq(NAV + """pr AS (SELECT a.page_id, a.tag_id AS outer_id, b.tag_id AS inner_id, a.link_url FROM lk a JOIN ids ia ON ia.page_id = a.page_id
    AND ia.pos = a.pos JOIN lk b ON b.page_id = a.page_id AND a.pos < b.pos AND b.pos < ia.pend AND a.link_url = b.link_url)
  SELECT page_id, inner_id AS kept, outer_id AS wrapper, link_url FROM pr WHERE link_url <> ''"""))
def _(spark, d):
    rows = elements(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    link = D.nav_link(F.col("chain"), F.col("inner_href"), F.col("identification_hints"), F.col("url"))
    return D.same_href_wrappers(rows.select("page_id", "tag_id", "start", "end", link.alias("link_url")))


SIGNALS = CHAIN + f"""sg AS (SELECT page_id, pos, k, atag || '.' || unnest(CASE WHEN {at('class')} LIKE 'drawer hidden lg:hidden' THEN ['lg+:hidden']
   WHEN {at('class')} = 'fixed bottom-0' THEN ['fixed-bottom-nav'] ELSE []::VARCHAR[] END) AS sig FROM ct WHERE atag NOT IN ('html', 'body')),
mo AS (SELECT page_id, pos, arg_min(sig, k) AS sig FROM sg GROUP BY ALL),
hid AS (SELECT page_id, pos, bool_or(k > 0 AND {at('style')} LIKE '%display:none%') AS h FROM ct GROUP BY ALL),
"""


@query("static_visibility", sq(SIGNALS + """z AS (SELECT 1) SELECT page_id, tag_id, CASE WHEN h THEN 'collapsed_parent' ELSE 'visible' END AS hidden_reason, NOT h AS is_visible
  FROM ids JOIN hid USING (page_id, pos)"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", "hidden_reason", "is_visible")


@query("platform_signals", sq(SIGNALS + sq_parse("u", "pages", "url", "page_id") + """,
  x AS (SELECT ids.page_id, tag_id, sig, h, viewport, upper(viewport) AS side, CASE viewport WHEN 'mo' THEN 'mobile-viewport' ELSE 'desktop-viewport' END AS scr
    FROM ids JOIN hid USING (page_id, pos) LEFT JOIN mo USING (page_id, pos) JOIN u USING (page_id))
  SELECT page_id, tag_id, CASE WHEN sig IS NOT NULL THEN 'MO' ELSE side END AS platform,
   CASE WHEN sig IS NOT NULL THEN sig WHEN h THEN 'collapsed:' ELSE 'visible@' || scr END AS platform_reason FROM x"""))
def _(spark, d):
    rows = elements(spark, d).join(table(spark, d, "pages").select("page_id", U.viewport_of(F.col("url")).alias("viewport")), "page_id")
    return D.with_platform(rows, F.col("viewport"), F.col("hidden_reason"), F.lit("")).select("page_id", "tag_id", "platform", "platform_reason")


@query("collect_priority", sq(SIGNALS + f"""ch2 AS (SELECT page_id, pos, bool_or(atag IN ('header','nav','footer','main')) AS chrome FROM ct GROUP BY ALL)
  SELECT page_id, tag_id, (CASE WHEN h THEN 1000 ELSE 0 END - CASE WHEN tag IN ('a','button') THEN 40 ELSE 0 END
   - CASE WHEN regexp_matches(cls, '\\bbtn\\b|button|link-button') THEN 45 ELSE 0 END - CASE WHEN chrome THEN 30 ELSE 0 END + tag_id * 3)::INT AS priority
  FROM ids JOIN hid USING (page_id, pos) JOIN ch2 USING (page_id, pos)"""))
def _(spark, d):
    return elements(spark, d).select("page_id", "tag_id", D.collect_priority(F.col("is_visible"), F.col("tag_id") * 3).alias("priority"))


@query("expand_triggers", sq("""z AS (SELECT 1) SELECT page_id, pos::INT AS start, 'dom:button:Menu:' AS key, 'Menu' AS label, 70 AS score, 1 AS rank
  FROM fl WHERE tag = 'button' AND txt = 'Menu'
  UNION ALL SELECT page_id, pos::INT, 'dom:div::', 'dom:div::', 15, 2 FROM fl WHERE tag = 'div' AND role = 'button'
  UNION ALL SELECT page_id, pos::INT, 'dom:button:Buy & go:', 'Buy & go', 15, 3 FROM fl WHERE tag = 'button' AND txt = 'Buy & go'"""))
def _(spark, d):
    return D.expand_triggers(rich_elements(spark, d)).select("page_id", "start", "key", "label", "score", "rank")


@query("panel_links", sq(CHAIN + f"""pan AS (SELECT page_id, pos, arg_min(apos, k) AS p, bool_or(regexp_matches(lower({at('class')}), 'dropdown')) AS dd FROM ct
    WHERE atag = 'nav' OR regexp_matches(lower({at('class')}), 'dropdown|submenu|menu-list|gnb') GROUP BY ALL),
  r AS (SELECT ids.page_id, ids.pos, href, txt, CASE WHEN tag = 'a' AND EXISTS (SELECT 1 FROM anc x WHERE x.page_id = ids.page_id AND x.pos = ids.pos
      AND x.atag = 'header') THEN 'More' ELSE 'unmapped' END AS panel, row_number() OVER (PARTITION BY ids.page_id, href ORDER BY ids.pos) AS f
    FROM ids JOIN pan USING (page_id, pos) WHERE tag = 'a' AND coalesce(href, '') NOT IN ('', '#') AND length(txt) BETWEEN 1 AND 80)
  SELECT page_id, pos::INT AS start, href, txt AS text, panel FROM r WHERE f = 1"""))
def _(spark, d):
    return D.panel_links(elements(spark, d))


@query("login_wall", f"""WITH rp AS (SELECT page_id, {RICH_HTML} AS html FROM pages),
  c AS (SELECT page_id, {SQ_CLEAN.replace("' '", "''")} AS html FROM rp),
  b AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM c)
  SELECT page_id FROM b WHERE regexp_matches({sq_decode('t')}, '(?i)login|sign in')""")
def _(spark, d):
    pages = rich_pages(spark, d)
    return D.login_wall(D.page_elements(pages), pages)


@query("tagged_markdown")
def _(spark, d):
    return D.tagged_markdown(rich_pages(spark, d))


@query("link_inventory", PLAIN + "lnk AS (SELECT page_id, pos, href FROM el WHERE tag = 'a' AND href IS NOT NULL),\n"
       + sq_parse("u", "pages", "url", "page_id") + f""",
  q AS (SELECT l.page_id, l.pos, href, u.host, root, txt, split_part(href, '?', 1) AS p, CASE WHEN contains(href, '?') THEN '?' || split_part(href, '?', 2) ELSE '' END AS qs,
   EXISTS (SELECT 1 FROM anc x WHERE x.page_id = l.page_id AND x.pos = l.pos AND x.atag = 'nav' AND x.k <= 11) AS in_nav
   FROM lnk l JOIN u USING (page_id) JOIN tx USING (page_id, pos)),
  n AS (SELECT *, regexp_replace(host, '^www\\.', '') || ({sq_encode('p', U.PATH_UNSAFE)}) || ({sq_encode('qs', U.QUERY_UNSAFE)}) AS nav_path FROM q)
  SELECT page_id, pos::INT AS pos, href, nav_path, txt AS label, true AS internal, CASE WHEN in_nav THEN 'nav' ELSE 'content' END AS landmark FROM n""")
def _(spark, d):
    return D.link_inventory(table(spark, d, "pages"))


SITE_RULES = [(None, "mobile_class", "wide", "advert", 0), ("example.com", "panel_class", "menu", "(?i)<nav", 0), ("example.com", "mobile_class", "promo", "promo|footer", 1),
              ("example.net", "exclude_trigger", "none", "no such thing", 0), ("example.org", "panel_class", "list", "article", 0)]
SQ_SITE_RULES = ", ".join(f"({'NULL' if r is None else repr(r)}, {k!r}, {n!r}, {p!r})" for r, k, n, p, _ in SITE_RULES)


@query("site_rules", PAGES_U + f""", rules AS (SELECT * FROM (VALUES {SQ_SITE_RULES}) r(root, kind, name, pattern))
  SELECT page_id, kind, name FROM u JOIN rules ON rules.root IS NULL OR rules.root = u.root WHERE regexp_matches(html, pattern)""")
def _(spark, d):
    from webplan.operators import sites as SR

    pages = SR.with_site_rules(table(spark, d, "pages"), spark.createDataFrame(SITE_RULES, SR.RULES))
    def of(kind):
        return F.transform(SR.rule_hits(F.col("site_rules"), kind, F.col("html")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    hits = [of(k) for k in SR.KINDS]
    return pages.select("page_id", F.explode(F.concat(*hits)).alias("h")).select("page_id", "h.*")
