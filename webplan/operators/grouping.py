"""Grouping equivalent candidates: page → area → cluster.

All work is per page (bounded by the element cap), so windows and lists over one page are safe.
The transitive merge relation is never enumerated pair by pair; its closed form gives the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import params as P
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.session import settle

FAR = 999999
PAGE = ["page_key", "viewport"]
BUCKET = PAGE + ["page_category", "area"]


def position(c) -> Column:
    """struct(y, x, tag_id) used for reading order; page views first, unplaced elements last."""
    placed = F.coalesce((c("bbox")["w"] > 0) | (c("bbox")["h"] > 0), F.lit(False))
    view = P.is_page_view(c("tag_id"), c("action_key"))
    at = lambda k: F.when(view, F.lit(-1)).when(placed, c("bbox")[k]).otherwise(F.lit(FAR)).cast("int")
    return F.struct(at("y").alias("y"), at("x").alias("x"), c("tag_id").alias("tag_id"))


def destination(link_url: Column) -> Column:
    return F.coalesce(U.nav_path(F.trim(link_url)), F.lit(""))


def merge_buckets(candidates: DataFrame) -> DataFrame:
    """Element rows (no page views) with area, merge label (blank is null), destination, position."""
    rows = candidates.filter(~P.is_page_view(F.col("tag_id"), F.col("action_key")))
    area = P.tagging_area(F.col("tag_id"), F.col("action_key"), F.col("action"), F.col("parameters"), F.col("page_category"))
    return rows.withColumns({
        "area": area, "_label": T.blank_null(F.col("merge_label")), "_dest": destination(F.col("link_url")),
        "_pos": position(F.col),
    })


def merge_clusters(candidates: DataFrame) -> DataFrame:
    """Adds cluster_key.  Within one area, equal merge labels form one cluster when any of them has no
    destination (it bridges the others), else one cluster per destination; no label, no merge."""
    rows = merge_buckets(candidates)
    open_end = F.max(F.col("_dest") == "").over(W.partitionBy(*BUCKET, "_label"))
    rows = rows.withColumn("_open", open_end)
    key = (
        F.when(F.col("_label").isNull(), F.concat(F.lit("tag:"), "tag_id"))
        .when(F.col("_open"), F.concat(F.lit("label:"), "_label"))
        .otherwise(F.concat(F.lit("link:"), "_label", F.lit(" "), "_dest"))
    )
    return rows.withColumn("cluster_key", key)


def cluster_label() -> Column:
    """Aggregate: the merge label all members share, else the shortest label."""
    shown = F.coalesce(T.blank_null(F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("text"))), F.lit(None))
    shortest = F.min(F.when(shown.isNotNull(), F.struct(F.length(shown).alias("n"), shown.alias("v"))))["v"]
    shared = (F.count("_label") == F.count(F.lit(1))) & (F.min("_label") == F.max("_label"))
    return F.when(shared, F.min("_label")).otherwise(F.coalesce(shortest, F.lit(T.NO_BUTTON_LABEL)))


def _sort_of(first: str) -> list[Column]:
    far = F.col(f"{first}.y") >= FAR
    return [F.when(far, F.lit(FAR)).otherwise(F.col(f"{first}.{k}")).alias(f"sort_{k}") for k in ("y", "x")]


def label_groups(candidates: DataFrame) -> DataFrame:
    """One row per cluster, plus one per page view (its own action, placed first)."""
    candidates = settle(candidates)
    rows = merge_clusters(candidates)
    groups = rows.groupBy(*BUCKET, "cluster_key").agg(
        cluster_label().alias("label"), F.count(F.lit(1)).cast("int").alias("member_total"),
        F.min("_pos").alias("_first"), F.min("tag_id").alias("primary_tag_id"),
        F.transform(F.array_sort(F.collect_list("_pos")), lambda p: p["tag_id"]).alias("member_tag_ids"),
    )
    groups = groups.select(*BUCKET, "cluster_key", "label", "member_total", "primary_tag_id", "member_tag_ids", *_sort_of("_first"))
    views = candidates.filter(P.is_page_view(F.col("tag_id"), F.col("action_key"))).select(
        *PAGE, "page_category", F.lit(T.PAGE_VIEW_EVENT).alias("area"), F.lit("page_view").alias("cluster_key"),
        F.coalesce(F.when(T.nz(F.col("label")) != "", F.col("label")), F.col("text"), F.lit(T.PAGE_VIEW_EVENT)).alias("label"),
        F.lit(1).alias("member_total"), F.col("tag_id").alias("primary_tag_id"), F.array("tag_id").alias("member_tag_ids"),
        F.lit(-1).alias("sort_y"), F.lit(-1).alias("sort_x"),
    )
    return groups.unionByName(views)


def label_key() -> Column:
    return F.concat(F.lower("label"), F.lit("::"), "area", F.lit("::"), "sort_y", F.lit(":"), "sort_x")


def level_totals(groups: DataFrame) -> DataFrame:
    """Member totals and reading position of every page category and of every area in it."""
    first = F.min(F.struct("sort_y", "sort_x"))
    areas = groups.groupBy(*BUCKET).agg(
        F.sum("member_total").alias("members"), F.count(F.lit(1)).alias("label_groups"), first.alias("_at")
    )
    cats = groups.groupBy(*PAGE, "page_category").agg(
        F.sum("member_total").alias("members"), F.count(F.lit(1)).alias("label_groups"),
        F.min(F.when(F.col("area") != T.PAGE_VIEW_EVENT, F.struct("sort_y", "sort_x"))).alias("_at"),
    ).withColumn("area", F.lit(None).cast("string"))
    return areas.unionByName(cats.select(*areas.columns)).select(
        *BUCKET, "members", "label_groups", F.coalesce("_at.sort_y", F.lit(-1)).alias("sort_y"),
        F.coalesce("_at.sort_x", F.lit(-1)).alias("sort_x"),
    )


def tree_view(groups: DataFrame) -> DataFrame:
    """Nested page tree: category → areas → label groups, every level in reading order."""
    leaf = F.array_sort(F.collect_list(F.struct("sort_y", "sort_x", "label", "member_total", "member_tag_ids")))
    areas = groups.groupBy(*BUCKET).agg(leaf.alias("label_groups"), F.sum("member_total").alias("member_total"))
    areas = areas.withColumn("_at", F.col("label_groups")[0])
    node = F.struct(F.col("_at.sort_y"), F.col("_at.sort_x"), "area", "member_total", "label_groups")
    return areas.groupBy(*PAGE, "page_category").agg(
        F.array_sort(F.collect_list(node)).alias("actions"), F.sum("member_total").alias("member_total")
    )


def tree_counts(groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts per page; ``lost_members`` must be 0."""
    total = candidates.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("candidates"))
    per_area = groups.groupBy(*BUCKET).agg(
        F.count(F.lit(1)).alias("g"), F.sum("member_total").alias("m"), F.sum(F.greatest(F.col("member_total") - 1, F.lit(0))).alias("d"),
        F.sum(F.when(F.col("area") != T.PAGE_VIEW_EVENT, 1).otherwise(0)).alias("c"),
    )
    per_cat = per_area.groupBy(*PAGE, "page_category").agg(
        F.count(F.lit(1)).alias("a"), *[F.sum(k).alias(k) for k in "gmdc"]
    )
    counts = per_cat.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("categories"), F.sum("a").alias("actions"), F.sum("g").alias("label_groups"),
        F.sum("m").alias("members"), F.sum("d").alias("merged_members"), F.sum("c").alias("click_label_groups"),
    )
    return counts.join(total, PAGE).withColumn("lost_members", F.col("candidates") - F.col("members")).drop("candidates")


def merge_links(candidates: DataFrame) -> DataFrame:
    """(kept, merged, reason): every merged element tied to the smallest tag of its cluster.

    A star instead of all pairs, so a cluster of n elements gives n - 1 rows."""
    rows = merge_clusters(candidates)
    w = W.partitionBy(*BUCKET, "cluster_key")
    rows = rows.withColumn("_p", F.min(F.struct("tag_id", "_dest")).over(w))
    same = (F.col("_dest") != "") & (F.col("_dest") == F.col("_p._dest"))
    return rows.filter(F.col("tag_id") != F.col("_p.tag_id")).select(
        *BUCKET, F.col("_p.tag_id").alias("kept"), F.col("tag_id").alias("merged"),
        F.when(same, F.lit("same_href")).otherwise(F.lit("same_merge_label")).alias("reason"),
        F.col("_label").alias("merge_label"),
    )


def mergeable_pairs(candidates: DataFrame) -> DataFrame:
    """Number of directly mergeable pairs and of pairs kept apart by different destinations, per
    (page, area, merge label) — counted from group sizes, not by listing pairs."""
    rows = merge_buckets(candidates).filter(F.col("_label").isNotNull())
    per_dest = rows.groupBy(*BUCKET, "_label", "_dest").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    linked = F.when(F.col("_dest") != "", F.col("n")).otherwise(0)
    out = per_dest.groupBy(*BUCKET, F.col("_label").alias("merge_label")).agg(
        F.sum("n").alias("n"), F.sum(linked).alias("l"), F.sum(pairs(linked)).alias("same")
    )
    apart = pairs(F.col("l")) - F.col("same")
    return out.select(
        *BUCKET, "merge_label", (pairs(F.col("n")) - apart).cast("long").alias("mergeable"), apart.cast("long").alias("kept_apart")
    ).filter("mergeable + kept_apart > 0")


def skipped_merges(candidates: DataFrame) -> DataFrame:
    """Pairs of one page that look alike but stay apart, counted by reason: same destination under
    another page category or area, or the same label without destination in another area."""
    rows = settle(merge_buckets(candidates))
    pairs = lambda n: n * (n - 1) / 2

    def across(df, same: list[str], differ: list[str], reason: str):
        fine = df.groupBy(*PAGE, *same, *differ).agg(F.count(F.lit(1)).alias("n"))
        return fine.groupBy(*PAGE, *same).agg(
            (pairs(F.sum("n")) - F.sum(pairs(F.col("n")))).cast("long").alias("pairs")
        ).filter("pairs > 0").groupBy(*PAGE).agg(F.sum("pairs").alias("pairs")).select(*PAGE, F.lit(reason).alias("reason"), "pairs")

    linked = rows.filter("_dest <> ''")
    bare = rows.filter("_dest = '' and _label is not null")
    return (
        across(linked, ["_dest"], ["page_category"], "diff_page_category")
        .unionByName(across(linked, ["_dest", "page_category"], ["area"], "diff_area"))
        .unionByName(across(bare, ["_label"], ["area"], "diff_area_no_link"))
    )


def tree_for_viewport(candidates: DataFrame) -> DataFrame:
    """Groups as a reviewer sees them: members of the other platform or without confirmed position
    disappear, empty levels vanish, totals are recounted."""
    p = F.coalesce("platform", F.lit("All"))
    seen = (F.col("tag_id") == 0) | ((p == "All") | (p == T.platform_label(F.col("viewport")))) & G.has_bbox(F.col("bbox"))
    rows = merge_clusters(candidates).filter(seen)
    first = F.min("_pos")
    groups = rows.groupBy(*BUCKET, "cluster_key").agg(
        F.count(F.lit(1)).cast("int").alias("member_total"), cluster_label().alias("label"), first.alias("_first")
    )
    return groups.select(*BUCKET, "cluster_key", "label", "member_total", *_sort_of("_first"))


def cap_by_priority(rows: DataFrame, cap: int | None) -> DataFrame:
    """Elements of a page ranked by ``score``, the first ``cap`` of them with the number left out, or all."""
    w = W.partitionBy("page_id")
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy("score", "tag_id")))
    if cap is None:
        return ranked.withColumn("dropped_cap", F.lit(0))
    return (
        ranked.withColumn("dropped_cap", F.greatest(F.count(F.lit(1)).over(w) - cap, F.lit(0)).cast("int"))
        .filter(F.col("rank") <= cap)
    )


def member_preview(groups: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` members of a group and how many are not shown."""
    return groups.withColumn("visible", F.slice("member_tag_ids", 1, n)).withColumn(
        "hidden_count", F.greatest(F.size("member_tag_ids") - n, F.lit(0))
    )


def canonical_category(rows: DataFrame, keys: list[str], name: str, seq: str) -> DataFrame:
    """Per key: the shortest spelling when its compact form starts all others, else the most frequent
    spelling (shorter, then earlier, on a tie); ``unknown`` when no name has two characters."""
    c = T.display_spacing(F.col(name))
    k = T.compact_key(F.col("_c"))
    spell = rows.withColumn("_c", c).groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_q"))
    spell = spell.withColumn("_k", F.when(F.length("_c") >= 2, k)).withColumn("_c", F.when(F.length("_c") >= 2, F.col("_c")))
    kl, cl = F.length("_k"), F.length("_c")
    out = spell.groupBy(*keys).agg(
        F.sum("_n").alias("members"), F.min("_k").alias("lo"), F.max("_k").alias("hi"),
        F.min(F.when(F.col("_c").isNotNull(), F.struct(kl.alias("a"), cl.alias("b"), F.col("_q"), F.col("_c"), F.col("_k")))).alias("s"),
        F.max(F.when(F.col("_c").isNotNull(), F.struct(F.col("_n"), (-cl).alias("b"), (-kl).alias("a"), (-F.col("_q")).alias("q"), F.col("_c")))).alias("m"),
    )
    # every key lies between lo and hi, so both ends sharing the prefix means all do
    prefix = F.col("lo").startswith(F.col("s._k")) & F.col("hi").startswith(F.col("s._k"))
    return out.select(
        *keys, "members", F.coalesce(F.when(prefix, F.col("s._c")).otherwise(F.col("m._c")), F.lit("unknown")).alias("canonical")
    )


def unify_categories(rows: DataFrame) -> DataFrame:
    """One category per (page, landmark, section) of at least two elements.

    rows(page_id, tag_id, landmark, section_heading, category)."""
    section = T.compact_key(T.nz(F.col("section_heading")))
    key = F.when(section != "", F.concat(F.coalesce("landmark", F.lit("content")), F.lit("|"), section))
    rows = rows.withColumn("section_key", key)
    best = canonical_category(rows.filter("section_key is not null"), ["page_id", "section_key"], "category", "tag_id")
    best = best.filter("members >= 2").drop("members")
    return rows.join(best, ["page_id", "section_key"], "left").withColumn(
        "category", F.coalesce("canonical", "category")
    ).drop("canonical", "section_key")
