"""Queries that cluster candidates into groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from webplan.catalog.base import query, table
from webplan.catalog.fields import BOX, SQ_RAW, candidates, raw_candidates
from webplan.functions import geometry as G
from webplan.functions import params as P
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import dom as D
from webplan.operators import grouping as GR
from webplan.operators import links as L

# one page appears twice under its normalised address; grouping is by address, so pages are told
# apart by giving each its own key
def own_pages(spark, d):
    return candidates(spark, d).withColumn("page_key", F.concat("page_key", F.lit("#"), "page_id"))


PK = "page_key || '#' || page_id"
# connected components of the pairwise merge relation, found by repeated minimum propagation over pairs
CLUSTERS = SQ_RAW + f""", c AS (SELECT {PK} AS page_key, site, viewport, page_id, page_category, area, tag_id, text, label, merge_label, coalesce('local' || link_url, '') AS dest,
   platform, boxed, w, CASE WHEN boxed THEN y ELSE 999999 END AS py, CASE WHEN boxed THEN x ELSE 999999 END AS px, event_name, hint FROM cand),
edge AS (SELECT a.page_key, a.tag_id AS a, b.tag_id AS b FROM c a JOIN c b ON a.page_key = b.page_key AND a.viewport = b.viewport AND a.page_category = b.page_category
   AND a.area = b.area AND a.merge_label = b.merge_label AND a.merge_label <> '' AND (a.dest = '' OR b.dest = '' OR a.dest = b.dest)),
s1 AS (SELECT page_key, a, min(b) AS r FROM edge GROUP BY ALL),
s2 AS (SELECT e.page_key, e.a, min(s1.r) AS r FROM edge e JOIN s1 ON s1.page_key = e.page_key AND s1.a = e.b GROUP BY ALL),
s3 AS (SELECT e.page_key, e.a, min(s2.r) AS r FROM edge e JOIN s2 ON s2.page_key = e.page_key AND s2.a = e.b GROUP BY ALL),
cl AS (SELECT c.*, coalesce(s3.r, c.tag_id) AS root FROM c LEFT JOIN s3 ON s3.page_key = c.page_key AND s3.a = c.tag_id),
grp AS (SELECT page_key, site, viewport, page_id, page_category, area, root, count(*)::INT AS member_total,
   CASE WHEN count(*) = count(nullif(trim(merge_label), '')) THEN min(merge_label) ELSE coalesce(min(nullif(trim(label), '')), '(버튼명 없음)') END AS label,
   min(py * 10000000000 + px * 1000 + tag_id) AS first, string_agg(tag_id::VARCHAR, ',' ORDER BY py, px, tag_id) AS members FROM cl GROUP BY ALL),
gp AS (SELECT *, (first // 10000000000)::INT AS sort_y, (first % 10000000000 // 1000)::INT AS sort_x FROM grp)"""


@query("merge_clusters", CLUSTERS + " SELECT page_key, tag_id, root AS cluster FROM cl")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = GR.merge_clusters(own_pages(spark, d))
    first = F.min("tag_id").over(W.partitionBy(*GR.BUCKET, "cluster_key"))
    return rows.select("page_key", "tag_id", first.alias("cluster"))


@query("candidate_groups", CLUSTERS + f""" SELECT page_key, viewport, page_category, area, label, member_total, root AS primary_tag_id, members, sort_y, sort_x FROM gp
  UNION ALL SELECT {PK}, viewport, page_category, '페이지뷰', page_category, 1, 0, '0', -1, -1 FROM hinted""")
def _(spark, d):
    g = GR.label_groups(own_pages(spark, d))
    return g.select("page_key", "viewport", "page_category", "area", "label", "member_total", "primary_tag_id", F.array_join("member_tag_ids", ",").alias("members"),
                    "sort_y", "sort_x")


@query("cluster_label", CLUSTERS + " SELECT page_key, root AS primary_tag_id, label, lower(label) || '::' || area || '::' || sort_y || ':' || sort_x AS label_key FROM gp")
def _(spark, d):
    return GR.label_groups(own_pages(spark, d).filter("tag_id > 0")).select("page_key", "primary_tag_id", "label", GR.label_key().alias("label_key"))


@query("level_totals", CLUSTERS + f""", ge AS (SELECT page_key, page_category, area, member_total, sort_y, sort_x FROM gp UNION ALL SELECT {PK}, page_category, '페이지뷰', 1, -1, -1 FROM hinted)
  SELECT page_key, page_category, area, sum(member_total)::BIGINT AS members, count(*) AS label_groups, min(sort_y)::INT AS sort_y FROM ge GROUP BY 1, 2, 3
  UNION ALL SELECT page_key, page_category, NULL, sum(member_total)::BIGINT, count(*), coalesce(min(sort_y) FILTER (area <> '페이지뷰'), -1) FROM ge GROUP BY 1, 2""")
def _(spark, d):
    return GR.level_totals(GR.label_groups(own_pages(spark, d))).select("page_key", "page_category", "area", "members", "label_groups", "sort_y")


@query("tree_view", CLUSTERS + f""", ge AS (SELECT page_key, page_category, area, label, member_total FROM gp UNION ALL SELECT {PK}, page_category, '페이지뷰', page_category, 1 FROM hinted)
  SELECT page_key, page_category, count(DISTINCT area)::INT AS areas, count(*)::INT AS leaves, sum(member_total)::BIGINT AS member_total FROM ge GROUP BY 1, 2""")
def _(spark, d):
    t = GR.tree_view(GR.label_groups(own_pages(spark, d)))
    leaves = F.aggregate("actions", F.lit(0), lambda n, a: n + F.size(a["label_groups"]))
    return t.select("page_key", "page_category", F.size("actions").alias("areas"), leaves.alias("leaves"), "member_total")


@query("tree_counts", CLUSTERS + f""", ge AS (SELECT page_key, page_category, area, member_total FROM gp UNION ALL SELECT {PK}, page_category, '페이지뷰', 1 FROM hinted)
  SELECT page_key, count(DISTINCT page_category) AS categories, count(DISTINCT (page_category, area)) AS actions, count(*) AS label_groups, sum(member_total)::BIGINT AS members,
   sum(greatest(member_total - 1, 0))::BIGINT AS merged_members, count_if(area <> '페이지뷰') AS click_label_groups, 0::BIGINT AS lost_members FROM ge GROUP BY 1""")
def _(spark, d):
    rows = own_pages(spark, d)
    return GR.tree_counts(GR.label_groups(rows), rows).drop("viewport")


@query("merge_links", CLUSTERS + """ SELECT cl.page_key, cl.root AS kept, cl.tag_id AS merged, cl.merge_label, CASE WHEN cl.dest <> '' AND cl.dest = p.dest THEN 'same_href' ELSE 'same_merge_label' END AS reason
  FROM cl JOIN c p ON p.page_key = cl.page_key AND p.tag_id = cl.root WHERE cl.tag_id <> cl.root""")
def _(spark, d):
    return GR.merge_links(own_pages(spark, d)).select("page_key", "kept", "merged", "merge_label", "reason")


PAIR = """FROM c a JOIN c b ON a.page_key = b.page_key AND a.page_category = b.page_category AND a.area = b.area AND a.merge_label = b.merge_label AND a.merge_label <> '' AND a.tag_id < b.tag_id"""


@query("merge_pairs", CLUSTERS + f""" SELECT a.page_key, a.page_category, a.area, a.merge_label, count_if(a.dest = '' OR b.dest = '' OR a.dest = b.dest) AS mergeable,
  count_if(a.dest <> '' AND b.dest <> '' AND a.dest <> b.dest) AS kept_apart {PAIR} GROUP BY ALL""")
def _(spark, d):
    return GR.mergeable_pairs(own_pages(spark, d)).drop("viewport")


@query("skipped_merges", CLUSTERS + """, p AS (SELECT a.page_key, CASE WHEN a.dest <> '' AND a.dest = b.dest AND a.page_category <> b.page_category THEN 'diff_page_category'
    WHEN a.dest <> '' AND a.dest = b.dest AND a.area <> b.area THEN 'diff_area' WHEN a.dest = '' AND b.dest = '' AND a.merge_label <> '' AND a.merge_label = b.merge_label AND a.area <> b.area THEN 'diff_area_no_link' END AS reason
   FROM c a JOIN c b ON a.page_key = b.page_key AND a.tag_id < b.tag_id) SELECT page_key, reason, count(*) AS pairs FROM p WHERE reason IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return GR.skipped_merges(own_pages(spark, d)).drop("viewport")


@query("primary_member", CLUSTERS + " SELECT page_key, root AS primary_tag_id, member_total FROM gp")
def _(spark, d):
    return GR.label_groups(own_pages(spark, d).filter("tag_id > 0")).select("page_key", "primary_tag_id", "member_total")


@query("member_preview", CLUSTERS + """, g2 AS (SELECT page_key, string_split(members, ',') AS m, root FROM gp) SELECT page_key, root AS primary_tag_id, array_to_string(m[1:2], ',') AS visible, greatest(len(m) - 2, 0)::INT AS hidden_count FROM g2""")
def _(spark, d):
    g = GR.member_preview(GR.label_groups(own_pages(spark, d).filter("tag_id > 0")), 2)
    return g.select("page_key", "primary_tag_id", F.array_join("visible", ",").alias("visible"), "hidden_count")


@query("tree_for_viewport", CLUSTERS + """, v AS (SELECT * FROM cl WHERE (platform = 'All' OR platform = upper(viewport)) AND boxed AND w > 0)
  SELECT page_key, page_category, area, min(tag_id) AS first_tag, count(*)::INT AS member_total FROM v GROUP BY page_key, page_category, area, root""")
def _(spark, d):
    from pyspark.sql import Window as W

    rows = own_pages(spark, d)
    g = GR.tree_for_viewport(rows.filter("tag_id > 0"))
    seen = GR.merge_clusters(rows).filter((F.col("platform") == "All") | (F.col("platform") == T.platform_label(F.col("viewport")))).filter(G.has_bbox(F.col("bbox")))
    first = seen.groupBy(*GR.BUCKET, "cluster_key").agg(F.min("tag_id").alias("first_tag"))
    return g.join(first, [*GR.BUCKET, "cluster_key"]).select("page_key", "page_category", "area", "first_tag", "member_total")


@query("position_order", SQ_RAW + """, p AS (SELECT page_id, tag_id, CASE WHEN boxed THEN y ELSE 999999 END AS y, CASE WHEN boxed THEN x ELSE 999999 END AS x FROM cand
   UNION ALL SELECT page_id, 0, -1, -1 FROM hinted) SELECT page_id, tag_id, row_number() OVER (PARTITION BY page_id ORDER BY y, x, tag_id)::INT AS rank FROM p""")
def _(spark, d):
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("page_id").orderBy(GR.position(F.col)))
    return candidates(spark, d).select("page_id", "tag_id", rank.alias("rank"))


@query("cap_by_priority", SQ_RAW + """, p AS (SELECT page_id, tag_id, (CASE WHEN hidden_reason = 'visible' THEN 0 ELSE 1000 END) + CASE WHEN boxed THEN y ELSE 0 END AS score FROM cand),
   r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, tag_id)::INT AS rank FROM p) SELECT page_id, tag_id, rank, 0 AS dropped_cap FROM r""")
def _(spark, d):
    rows = raw_candidates(spark, d).select("page_id", "tag_id", F.lit("li").alias("tag"), F.lit("").alias("cls"), F.lit("").alias("role"), F.lit(0).alias("n_slide"), F.lit(0).alias("n_chrome"),
                                           "hidden_reason", "bbox")
    score = D.collect_priority(F.col("hidden_reason") == "visible", F.col("bbox.y"))
    return GR.cap_by_priority(rows.withColumn("score", score), None).select("page_id", "tag_id", "rank", "dropped_cap")


WORDS = ["추천 상품", "추천상품 리스트", "추천  상품 더보기", "베스트", "x", "배너", "베스트 상품"]


@query("canonical_category", f"""WITH e AS (SELECT event_id % 1000 AS page_id, event_id, trim(regexp_replace(list_extract([{', '.join("'" + w.replace("'", "''") + "'" for w in WORDS)}],
    (event_id * user_id % 7 + 1)::INT), '\\s+', ' ', 'g')) AS c FROM events),
  n AS (SELECT page_id, c, lower(replace(c, ' ', '')) AS k, count(*) AS n, min(event_id) AS q FROM e WHERE length(c) >= 2 GROUP BY ALL),
  s AS (SELECT page_id, arg_min(c, (length(k), length(c), q)) AS short, arg_min(k, (length(k), length(c), q)) AS start, arg_min(c, (-n, length(c), length(k), q)) AS frequent FROM n GROUP BY 1),
  p AS (SELECT n.page_id, bool_and(starts_with(k, start)) AS every FROM n JOIN s USING (page_id) GROUP BY 1)
  SELECT page_id, count(*) AS members, coalesce(any_value(CASE WHEN every THEN short ELSE frequent END), 'unknown') AS canonical
  FROM e LEFT JOIN s USING (page_id) LEFT JOIN p USING (page_id) GROUP BY page_id""")
def _(spark, d):
    e = table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.pmod(F.col("event_id") * F.col("user_id"), F.lit(7)) + 1).cast("int"))
    rows = e.select((F.col("event_id") % 1000).alias("page_id"), name.alias("name"), "event_id")
    return GR.canonical_category(rows, ["page_id"], "name", "event_id")


@query("unify_categories", SQ_RAW + """, g AS (SELECT page_id, tag_id, CASE WHEN tag_id % 2 = 0 THEN '추천 상품' ELSE '추천상품 리스트' END AS category, CASE WHEN page_id % 3 = 0 THEN 'main' ELSE 'content' END AS landmark,
   CASE WHEN tag_id % 5 = 0 THEN '' WHEN tag_id % 3 = 0 THEN '추천' ELSE '추 천 상품' END AS sec FROM cand),
  nn AS (SELECT page_id, sec, count(*) AS n, count(DISTINCT category) AS d, min(category) AS c FROM g GROUP BY ALL)
  SELECT page_id, tag_id, CASE WHEN sec <> '' AND n >= 2 AND d = 2 THEN '추천 상품' ELSE category END AS category FROM g JOIN nn USING (page_id, sec)""")
def _(spark, d):
    t = F.col("tag_id")
    rows = raw_candidates(spark, d).select(
        "page_id", "tag_id", F.when(t % 2 == 0, F.lit("추천 상품")).otherwise(F.lit("추천상품 리스트")).alias("category"),
        F.when(F.col("page_id") % 3 == 0, F.lit("main")).otherwise(F.lit("content")).alias("landmark"),
        F.when(t % 5 == 0, F.lit("")).when(t % 3 == 0, F.lit("추천")).otherwise(F.lit("추 천 상품")).alias("section_heading"))
    return GR.unify_categories(rows).select("page_id", "tag_id", "category")
