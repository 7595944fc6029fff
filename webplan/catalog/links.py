"""Queries over page addresses, sitemap documents and link inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import PAGES_U, query, s, sq_encode, sq_parse, sq_title, table
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import links as L
from webplan.sources import sitemaps as S
from webplan.sources.pages import scan_pages, with_site




def pages(spark, d):
    return scan_pages(spark, f"{d}/pages.parquet")


def urls(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def sq_decode(x):
    """Character references by number, and those names that occur in the corpus or in markup added to it."""
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7"}
    named = " ".join(f"WHEN rtrim(p, ';') = '&{k}' THEN {s(v)}" for k, v in names.items())
    return (
        f"CASE WHEN contains({x}, '&') THEN array_to_string(list_transform(regexp_extract_all({x}, '&#?[A-Za-z0-9]+;?|[^&]+|&'), "
        f"lambda p: CASE {named} WHEN p = '&apos;' THEN chr(39) WHEN regexp_matches(p, '^&#[0-9]+;?$') THEN chr(regexp_extract(p, '[0-9]+')::INT) "
        f"WHEN regexp_matches(p, '^&#[xX][0-9A-Fa-f]+;?$') THEN chr(('0x' || regexp_extract(p, '[xX]([0-9A-Fa-f]+)', 1))::INT) ELSE p END), '') ELSE {x} END"
    )


def scalar(name, expr, sql):
    """A query that is one expression over every page address."""
    query(name, f"{PAGES_U} SELECT page_id, {sql} FROM u")(
        lambda spark, d: urls(spark, d).select("page_id", *expr())
    )


@query("scan_pages", f"SELECT page_id, url, {sq_decode(sq_title())} AS title, '' AS og_title, "
       "length(html)::BIGINT AS n_chars FROM pages")
def _(spark, d):
    return pages(spark, d).select("page_id", "url", "title", "og_title", F.length("html").cast("long").alias("n_chars"))


scalar("normalize_page_url", lambda: [U.normalize_page_url(F.col("url")).alias("page_key")], "page_key")
scalar("canonical_link", lambda: [U.canonical_link(F.concat(F.when(F.col("page_id") % 10 == 3, F.lit("mailto:"))
       .otherwise(F.lit("")), F.col("url"))).alias("link")],
       "CASE WHEN page_id % 10 <> 3 THEN canonical END AS link")
scalar("normalize_seed", lambda: [U.normalize_seed(F.concat(F.lit(" "), U.url_host(F.col("url")), F.lit(").//")))["seed_url"].alias("bare_seed"),
                                  U.normalize_seed(F.col("url"))["seed_url"].alias("seed_url"),
                                  U.normalize_seed(F.lit("nohost"))["seed_error"].alias("seed_error")],
       "'https://' || host || '/' AS bare_seed, CASE WHEN path1 = '/' THEN origin || '/' ELSE origin || path1 END AS seed_url, "
       "'invalid host' AS seed_error")
scalar("root_domain", lambda: [U.root_domain(U.url_host(F.col("url"))).alias("root"),
                               U.root_domain(F.concat(U.url_host(F.col("url")), F.lit(".co.kr"))).alias("kr_root")],
       "root, list_extract(string_split(bare, '.'), -1) || '.co.kr' AS kr_root")
scalar("page_context", lambda: [U.page_context(F.col("url"), F.lit("  t "))[x].alias(x) for x in
                                ("page_location", "page_path", "page_title", "page_referrer")],
       "origin || path || query || frag AS page_location, path || query || frag AS page_path, 't' AS page_title, "
       "'' AS page_referrer")
scalar("path_depth", lambda: [U.path_depth(F.col("url")).alias("depth"), U.path_depth(F.concat(F.lit("x"), F.col("page_id"))).alias("bad")],
       "len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth, 99 AS bad")
scalar("rewrite_onto_seed_host", lambda: [U.rewrite_onto_seed_host(F.col("url"), F.lit("dev.example.com")).alias("rewritten")],
       "CASE WHEN host = 'dev.example.com' THEN canonical WHEN root = 'example.com' AND bare = root "
       "THEN scheme || '://dev.example.com' || port || path1 || query END AS rewritten")
scalar("host_key", lambda: [U.host_key(F.col("url")).alias("host_key")],
       "regexp_replace(host || port, '^www\\.', '') AS host_key")
scalar("locale_hint", lambda: [U.locale_hint(F.regexp_replace(F.col("url"), r"example\.net", "example.co.kr"))["country"].alias("country"),
                               F.array_join(U.locale_hint(F.regexp_replace(F.col("url"), r"example\.net", "example.co.kr"))["languages"], ",").alias("languages")],
       "CASE WHEN host LIKE '%.net' THEN 'KR' END AS country, CASE WHEN host LIKE '%.net' THEN 'ko-KR,ko,en' END AS languages")
scalar("capture_job_id", lambda: [U.capture_job_id(F.concat(F.col("url"), F.lit("/captures/"), F.col("page_id"), F.lit("/a.png"))).alias("job_id"),
                                  U.capture_job_id(F.col("url")).alias("none")],
       "page_id::VARCHAR AS job_id, NULL::VARCHAR AS none")


@query("alias_from_title", f"SELECT page_id, CASE WHEN length(t) > 28 THEN '' ELSE t END AS alias FROM "
       f"(SELECT page_id, {sq_decode(sq_title())} AS t FROM pages)")
def _(spark, d):
    return pages(spark, d).select("page_id", T.alias_from_title(F.col("title")).alias("alias"))


SQ_NAMED = PAGES_U + f""", n AS (SELECT *, {sq_decode(sq_title())} AS title,
  list_extract(list_filter(string_split(path, '/'), lambda x: x <> ''), -1) AS seg FROM u)"""


@query("page_name", SQ_NAMED + """ SELECT page_id, CASE WHEN length(title) >= 2 THEN left(title, 80)
  WHEN seg IS NOT NULL THEN left(url_decode(seg), 80) ELSE left(regexp_replace(host, '^www\\.', ''), 80) END AS name,
  CASE WHEN seg IS NOT NULL THEN left(url_decode(seg), 80) ELSE left(regexp_replace(host, '^www\\.', ''), 80) END AS untitled
  FROM n""")
def _(spark, d):
    return pages(spark, d).select(
        "page_id", U.page_name(F.col("og_title"), F.col("title"), F.col("url")).alias("name"),
        U.page_name(F.lit(None).cast("string"), F.lit(""), F.col("url")).alias("untitled"),
    )


SQ_CAT = """CASE WHEN title <> '' AND length(tc) BETWEEN 2 AND 40 THEN tc WHEN length(sg) >= 2 THEN left(sg, 40)
  ELSE '페이지' END"""
SQ_HINTED = SQ_NAMED + f""", h AS (SELECT *, trim(regexp_replace(regexp_replace(trim(title), '\\s*[|\\-–—]\\s*.+$', ''),
    '\\s*-\\s*.+$', '')) AS tc, regexp_replace(url_decode(seg), '[-_]+', ' ', 'g') AS sg FROM n),
  hinted AS (SELECT *, {SQ_CAT} AS page_category FROM h)"""


@query("page_category_hint", SQ_HINTED + " SELECT page_id, page_category FROM hinted")
def _(spark, d):
    return pages(spark, d).select("page_id", U.page_category_hint(F.col("title"), F.col("url")).alias("page_category"))


@query("site_families", PAGES_U + """, h AS (SELECT root AS site, host, count(*) AS n, min(page_id) AS f FROM u GROUP BY 1, 2)
  SELECT site, arg_max(host, n * 1000000000 - f) AS best_host, sum(n)::BIGINT AS entries, count(*) AS hosts FROM h GROUP BY 1""")
def _(spark, d):
    return L.best_family_match(urls(spark, d).select(U.url_host(F.col("url")).alias("host"), F.col("page_id").alias("seq")))


@query("hosts", PAGES_U + " SELECT regexp_replace(host || port, '^www\\.', '') AS host_key, count(*) AS items FROM u GROUP BY 1")
def _(spark, d):
    return urls(spark, d).groupBy(U.host_key(F.col("url")).alias("host_key")).agg(F.count(F.lit(1)).alias("items"))


# ---------------------------------------------------------------- anchors: hrefs as the pages carry them

HREF = r'(?is)<a\s[^>]*?href="([^"]*)"'


def anchors(spark, d):
    """(page_id, url, href): every anchor destination, outside comments and raw-text elements."""
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")
    return table(spark, d, "pages").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all(clean, F.lit(HREF), F.lit(1))).alias("pos", "href")
    ).withColumn("href", T.decode_entities(F.col("href")))


SQ_CLEAN = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), "
            "'(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), "
            "'(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g')")
SQ_ANCHORS = f"""WITH a0 AS (SELECT page_id, url, regexp_extract_all({SQ_CLEAN}, {s(HREF)}, 1) AS hrefs FROM pages),
a1 AS (SELECT page_id, url, unnest(hrefs) AS href0, generate_subscripts(hrefs, 1) - 1 AS pos FROM a0),
a AS (SELECT page_id, url, pos, {sq_decode('href0')} AS href FROM a1),"""
SQ_HPATH = ("split_part(split_part(href, '#', 1), '?', 1)")
SQ_HQUERY = ("CASE WHEN contains(split_part(href, '#', 1), '?') THEN regexp_extract(split_part(href, '#', 1), '\\?.*$') ELSE '' END")


@query("nav_path", SQ_ANCHORS + sq_parse("u", "a", "url", "page_id, pos, href") + f""",
  p AS (SELECT *, {SQ_HPATH} AS hp, {SQ_HQUERY} AS hq FROM u)
  SELECT page_id, pos::INT AS pos, href, CASE WHEN trim(href) LIKE '/%' THEN regexp_replace(host, '^www\\.', '') ||
    ({sq_encode('hp', U.PATH_UNSAFE)}) || ({sq_encode('hq', U.QUERY_UNSAFE)}) ELSE '' END AS nav_path,
  CASE WHEN trim(href) LIKE '/%' THEN 'local' || ({sq_encode('hp', U.PATH_UNSAFE)}) || ({sq_encode('hq', U.QUERY_UNSAFE)})
  ELSE '' END AS bare_path FROM p""")
def _(spark, d):
    h = F.col("href")
    return anchors(spark, d).select("page_id", "pos", "href", U.nav_path(h, F.col("url")).alias("nav_path"), U.nav_path(h).alias("bare_path"))


@query("is_valid_nav_link", SQ_ANCHORS[:-1] + """ SELECT page_id, pos::INT AS pos, href <> '' AS valid, false AS hash_valid,
  false AS script_valid FROM a""")
def _(spark, d):
    h = F.col("href")
    return anchors(spark, d).select(
        "page_id", "pos", U.is_valid_nav_link(h).alias("valid"),
        U.is_valid_nav_link(F.concat(F.lit(" #"), h)).alias("hash_valid"),
        U.is_valid_nav_link(F.concat(F.lit("JavaScript:"), h)).alias("script_valid"),
    )


@query("resolve_link", SQ_ANCHORS + sq_parse("u", "a", "url", "page_id, pos, href") + f""",
  p AS (SELECT *, ({sq_encode(SQ_HPATH, U.PATH_UNSAFE)}) AS hp, ({sq_encode(SQ_HQUERY, U.QUERY_UNSAFE)}) AS hq FROM u)
  SELECT page_id, pos::INT AS pos, hp || hq AS same_origin, 'https://other.example.org' || hp || hq AS cross_origin,
    path || query AS hash_only, NULL::VARCHAR AS none FROM p""")
def _(spark, d):
    h = F.col("href")
    return anchors(spark, d).select(
        "page_id", "pos", U.resolve_link(h, F.col("url")).alias("same_origin"),
        U.resolve_link(F.concat(F.lit("https://other.example.org"), h), F.col("url")).alias("cross_origin"),
        U.resolve_link(F.lit("#frag"), F.col("url")).alias("hash_only"),
        U.resolve_link(F.when(F.col("pos") % 2 == 0, F.lit("#")).otherwise(F.lit("javascript:void(0)")), F.col("url")).alias("none"),
    )


# ---------------------------------------------------------------- link inventories


def links(spark, d):
    """Every page address and every anchor address of the corpus as one link table.

    Anchor rows get a sequence after all page rows of the same page, so ``seq`` is unique."""
    own = with_site(urls(spark, d)).select("site", "url", (F.col("page_id") * 1000).alias("seq"))
    out = anchors(spark, d).select(
        U.site_of(F.col("url")).alias("site"), U.resolve_url(F.col("href"), F.col("url")).alias("url"),
        (F.col("page_id") * 1000 + F.col("pos") + 1).alias("seq"),
    )
    return own.unionByName(out).select(
        "site", "url", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"),
        F.lit("map").alias("source"), "seq",
    )


SQ_LINKS = SQ_ANCHORS + sq_parse("u0", "pages", "url", "page_id") + f""",
links0 AS (SELECT root AS site, t AS link, page_id * 1000 AS seq FROM u0 UNION ALL
  SELECT root, origin || a.href, a.page_id * 1000 + pos + 1 FROM a JOIN u0 USING (page_id)),
""" + sq_parse("u", "links0", "link", "site, link, seq") + """,
dedup AS (SELECT site, canonical AS url, min(seq) AS seq FROM u GROUP BY 1, 2)"""


@query("dedupe_links", SQ_LINKS + " SELECT site, url, seq FROM dedup")
def _(spark, d):
    return L.dedupe_links(links(spark, d)).select("site", "url", "seq")


SQ_RANKED = SQ_LINKS + ",\n" + sq_parse("v", "dedup", "url", "site, url, seq") + """,
ranked AS (SELECT site, url, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::INT AS depth, seq,
  row_number() OVER (PARTITION BY site ORDER BY (url <> 'https://' || site || '/')::INT,
    (regexp_replace(host, '^www\\.', '') <> site)::INT, len(list_filter(string_split(path, '/'), lambda x: x <> '')), url)::INT AS rank
  FROM v)"""


@query("rank_links", SQ_RANKED + " SELECT site, url, depth, rank FROM ranked WHERE rank <= 200")
def _(spark, d):
    rows = L.dedupe_links(links(spark, d))
    return L.rank_links(rows, None, 200).select("site", "url", "depth", "rank")


SQ_KEEP = f"""is_http AND root = site AND NOT regexp_matches(host, {s(U.AUTH_HOST_PATTERN)})
  AND NOT regexp_matches(path, {s(U.ASSET_PATTERN)}) AND NOT regexp_matches(path, {s(U.SERVICE_PATTERN)})
  AND NOT regexp_matches(path || query, {s(U.AUTH_PATTERN)})"""
# links with some addresses turned into assets, services and sign-in pages
VARIANTS = ["", "/a.png", "/api/x", "/login", "/auth/x", "/auth//x", "/p?next=/login"]


def varied(df):
    arr = F.array(*[F.lit(v) for v in VARIANTS])
    base = F.regexp_replace("url", r"[?#].*$", "")
    return df.withColumn("url", F.concat(base, F.element_at(arr, (F.pmod(F.col("seq"), F.lit(7)) + 1).cast("int"))))


SQ_VARIED = SQ_ANCHORS + sq_parse("u0", "pages", "url", "page_id") + f""",
links0 AS (SELECT root AS site, t AS link, page_id * 1000 AS seq FROM u0 UNION ALL
  SELECT root, origin || a.href, a.page_id * 1000 + pos + 1 FROM a JOIN u0 USING (page_id)),
links1 AS (SELECT site, seq, regexp_replace(link, '[?#].*$', '') ||
  list_extract([{', '.join(s(v) for v in VARIANTS)}], (seq % 7 + 1)::INT) AS link FROM links0),
""" + sq_parse("u", "links1", "link", "site, link, seq")


@query("keep_url", SQ_VARIED + f""" SELECT site, link AS url, seq, {SQ_KEEP} AS keep,
  {SQ_KEEP} AND regexp_replace(host, '^www\\.', '') = site AS keep_same_host FROM u""")
def _(spark, d):
    site = F.col("site")
    return varied(links(spark, d)).select(
        "site", "url", "seq", U.keep_url(F.col("url"), site).alias("keep"),
        U.keep_url(F.col("url"), site, site, subdomains=False).alias("keep_same_host"),
    )


@query("keep_or_rewrite", SQ_VARIED + f""",
  w AS (SELECT *, 'dev.' || site AS seed_host, {SQ_KEEP} AS ok FROM u)
  SELECT site, link AS url, seq, CASE WHEN ok AND host = seed_host THEN canonical WHEN ok AND bare = root
    THEN scheme || '://' || seed_host || port || path1 || query END AS kept_url FROM w""")
def _(spark, d):
    rows = varied(links(spark, d))
    seeds = L.seeds_of(rows).withColumn("seed_host", F.concat(F.lit("dev."), F.col("site")))
    return L.filter_links(rows, seeds).select("site", "url", "seq", "kept_url")


@query("filter_counts", SQ_VARIED + f""" SELECT site, count(*) AS raw_count, count_if({SQ_KEEP}) AS kept,
  count_if(NOT ({SQ_KEEP})) AS filtered_out FROM u GROUP BY 1""")
def _(spark, d):
    rows = varied(links(spark, d))
    out = L.filter_links(rows, None, subdomains=True)
    return out.groupBy("site").agg(
        F.count(F.lit(1)).alias("raw_count"), F.count("kept_url").alias("kept"),
        F.count_if(F.col("kept_url").isNull()).alias("filtered_out"),
    )


@query("discover_union", SQ_LINKS + f""",
  sm AS (SELECT root AS site, t AS url FROM u0 WHERE path LIKE '/en%'),
  full_sites AS (SELECT site FROM sm GROUP BY 1 HAVING count(*) >= 45),
  every AS (SELECT DISTINCT site, 'https://' || site || '/' AS url, 0 AS k, 0 AS seq FROM u UNION ALL
    SELECT site, url, 1, 1 FROM sm UNION ALL
    SELECT site, url, 2, 2 FROM dedup WHERE site NOT IN (SELECT site FROM full_sites)),
""" + sq_parse("e", "every", "url", "site, k") + """,
  d1 AS (SELECT site, canonical AS url, min(k) AS k FROM e GROUP BY 1, 2),
""" + sq_parse("v", "d1", "url", "site, url, k") + """,
  r AS (SELECT site, url, CASE k WHEN 0 THEN 'seed' WHEN 1 THEN 'sitemap' ELSE 'map' END AS source,
  row_number() OVER (PARTITION BY site ORDER BY (url <> 'https://' || site || '/')::INT,
    (regexp_replace(host, '^www\\.', '') <> site)::INT, len(list_filter(string_split(path, '/'), lambda x: x <> '')), url)::INT AS rank
  FROM v) SELECT site, url, source, rank FROM r WHERE rank <= 45""")
def _(spark, d):
    rows = L.dedupe_links(links(spark, d)).select("site", "url", "source", (F.lit(2)).alias("seq"))
    sitemap = with_site(urls(spark, d)).filter(U.url_path(F.col("url")).startswith("/en")).select(
        "site", "url", F.lit("sitemap").alias("source"), F.lit(1).alias("seq")
    )
    seeds = L.seeds_of(links(spark, d))
    found = L.discover_union(seeds, sitemap.withColumn("seq", F.lit(1)), rows, 45)
    return found.select("site", "url", "source", "rank")


@query("clamp_limit", "SELECT event_id, greatest(1, least(5000, CASE WHEN event_type = 'error' THEN 200 WHEN floor(value) = 0 "
       "AND value = 0 THEN 200 ELSE floor(value * 40) END))::INT AS n FROM events")
def _(spark, d):
    n = F.when(F.col("event_type") != "error", F.col("value") * 40)
    return table(spark, d, "events").select("event_id", L.clamp_limit(n, 200).alias("n"))


@query("discovery_steps", SQ_LINKS + """, n AS (SELECT site, count(*) AS n FROM dedup GROUP BY 1),
  st AS (SELECT * FROM (VALUES (0,20),(1,40),(2,80),(3,150),(4,300),(5,500),(6,1000)) AS v(step, cap)),
  x AS (SELECT site, step, cap, least(n, cap) AS total, CASE WHEN step = 0 THEN 0 ELSE
     (SELECT p.cap FROM st p WHERE p.step = st.step - 1) END AS pcap, n FROM n, st)
  SELECT site, step, cap, total::BIGINT AS total, (total - least(n, pcap))::BIGINT AS added FROM x WHERE n >= pcap""")
def _(spark, d):
    n = L.dedupe_links(links(spark, d)).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return L.discovery_steps(n, 1000).select("site", "step", "cap", F.col("total").cast("long"), F.col("added").cast("long"))


# ---------------------------------------------------------------- sitemap documents made from the corpus


def robots_docs(spark, d):
    p = with_site(urls(spark, d))
    body = F.concat_ws("\n", F.lit("User-agent: *\r"), F.lit("Disallow: /private"),
                       F.concat(F.lit("  SiteMap : "), F.col("url")), F.concat(F.lit("sitemap:/s-"), F.col("page_id"), F.lit(".xml next")))
    return p.select("page_id", "site", body.alias("body"))


@query("robots_sitemaps", PAGES_U + """ SELECT page_id, root AS site, 2 AS pos, t AS sitemap_url FROM u UNION ALL
  SELECT page_id, root, 3, '/s-' || page_id || '.xml' FROM u""")
def _(spark, d):
    return S.robots_sitemaps(robots_docs(spark, d))


def sitemap_docs(spark, d):
    """One sitemap per page; every fifth is an index that names the two following indexes."""
    p = with_site(urls(spark, d))
    doc = lambda k: F.concat(F.lit("https://"), F.col("site"), F.lit("/s-"), (F.col("page_id") + k).cast("string"), F.lit(".xml"))
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    index = F.concat(F.lit('<sitemapindex xmlns="x"><sitemap><loc>'), doc(5), F.lit("</loc></sitemap><sitemap><LOC>\n "), doc(10),
                     F.lit(" </LOC></sitemap></sitemapindex>"))
    urlset = F.concat(F.lit("<urlset><url><loc> "), esc, F.lit(" </loc></url><url><loc></loc></url><url><loc><![CDATA["),
                      F.col("page_key"), F.lit("]]></loc></url></urlset>"))
    return p.select("page_id", "site", doc(0).alias("doc_url"),
                    F.when(F.col("page_id") % 5 == 0, index).otherwise(urlset).alias("body"))


@query("sitemap_locs", PAGES_U + """, x AS (SELECT page_id, root AS site, page_id % 5 = 0 AS is_index, t, page_key FROM u)
  SELECT page_id, is_index, 0 AS pos, CASE WHEN is_index THEN 'https://' || site || '/s-' || (page_id + 5) || '.xml' ELSE t END AS loc FROM x
  UNION ALL SELECT page_id, is_index, CASE WHEN is_index THEN 1 ELSE 2 END, CASE WHEN is_index THEN
   'https://' || site || '/s-' || (page_id + 10) || '.xml' ELSE page_key END FROM x""")
def _(spark, d):
    return S.sitemap_locs(sitemap_docs(spark, d)).select("page_id", "is_index", "pos", "loc")


@query("expand_sitemaps", PAGES_U.replace("WITH", "WITH RECURSIVE", 1) + """, docs AS (SELECT root AS site, page_id AS n, page_id % 5 = 0 AS is_index FROM u),
  walk AS (SELECT site, min(n) AS n FROM docs WHERE is_index GROUP BY 1
    UNION SELECT w.site, w.n + t.step FROM walk w JOIN docs d ON d.site = w.site AND d.n = w.n AND d.is_index, (VALUES (5), (10)) t(step))
  SELECT walk.site, 'https://' || walk.site || '/s-' || walk.n || '.xml' AS doc_url, is_index, CASE WHEN is_index THEN 0 WHEN NOT is_index THEN 2 ELSE 0 END::BIGINT AS pages
    FROM walk LEFT JOIN docs ON docs.site = walk.site AND docs.n = walk.n
  UNION ALL SELECT DISTINCT site, 'https://' || site || p, NULL, 0 FROM docs,
    (VALUES ('/sitemap.xml'), ('/sitemap_index.xml'), ('/sitemap-index.xml'), ('/sitemap/sitemap.xml')) v(p)""")
def _(spark, d):
    docs = sitemap_docs(spark, d)
    seeds = docs.select("site").distinct().select("site", F.concat(F.lit("https://"), F.col("site")).alias("origin"))
    robots = docs.filter(F.col("page_id") % 5 == 0).groupBy("site").agg(F.min_by("doc_url", "page_id").alias("sitemap_url")).select(
        "site", F.lit(0).alias("pos"), "sitemap_url")
    return S.expand_sitemaps(S.sitemap_locs(docs), robots, seeds).select("site", "doc_url", "is_index", "pages")


@query("same_root_docs", SQ_VARIED + """ SELECT site, origin || path || query AS url, seq FROM u WHERE root = 'example.com'""")
def _(spark, d):
    rows = varied(links(spark, d)).select("site", "url", "seq", F.lit("example.com").alias("seed_root"))
    return S.same_root_docs(rows, "url", "seed_root").select("site", "url", "seq")


@query("parse_link_payloads", PAGES_U + """ SELECT page_id, 0 AS pos, t AS url, NULL::VARCHAR AS title, NULL::VARCHAR AS description FROM u
  UNION ALL SELECT page_id, 1, page_key, root, NULL FROM u""")
def _(spark, d):
    p = with_site(urls(spark, d))
    items = F.concat(F.lit('[" '), F.col("url"), F.lit(' ",{"url":" '), F.col("page_key"), F.lit('","title":"'), F.col("site"),
                     F.lit('","description":"  "},{"title":"no address"},{"url":5}, 7, ""]'))
    body = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"links":'), items, F.lit("}"))).otherwise(
        F.concat(F.lit('{"links":null,"data":{"links":'), items, F.lit("}}")))
    return S.parse_link_payloads(p.select("page_id", body.alias("body")))
