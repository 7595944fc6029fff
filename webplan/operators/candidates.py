"""Candidate assembly: suggestions, geometry, platform and capture results joined onto elements.

Rows are keyed by (page, tag_id), so no key is ever hot beyond the size of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import params as P
from webplan.functions import text as T
from webplan.session import settle

KEYS = ["page_id", "tag_id"]
# Hidden reasons without a capture, and area names too vague to keep.
NO_CAPTURE_REASONS = ["display_none", "visibility_hidden", "opacity_zero", "zero_size"]
VAGUE_AREAS = ["unknown", "배너", "메인 배너", "banner", "hero"]


def fallback_suggestion(elements: DataFrame) -> Column:
    """Rule-based suggestion struct of one element: banner, header or menu, footer, bottom bar,
    section heading, unknown — in that order."""
    labels = F.array_join("parent_labels", " ")
    banner = T.banner_category(F.col("section_heading"), F.col("dom_path"), labels, F.col("landmark"))
    area = (
        F.when(banner.isNotNull(), banner)
        .when((F.col("landmark") == "gnb") | F.col("has_menu_path"), F.lit("global/gnb"))
        .when((F.col("landmark") == "fnb") | F.col("platform_reason").contains("fixed-bottom-nav"), F.lit("global/fnb"))
        .otherwise(F.coalesce(T.blank_null(F.col("section_heading")), F.lit("unknown")))
    )
    action = F.when(area == "global/gnb", F.lit("click_gnb")).when(area == "global/fnb", F.lit("click_fnb")).otherwise(
        F.lit("click")
    )
    name = F.trim(T.nz(F.col("label")))
    label = F.when(banner.isNotNull() & name.rlike(r"(?i)^배너\d*$"), F.lit("배너")).when(name != "", name).otherwise(
        F.lit("[button]")
    )
    return F.struct(
        area.alias("category"), action.alias("action"), label.alias("label"), label.alias("merge_label"),
        F.lit(T.CLICK_EVENT).alias("event_name"), F.array().cast(P.PARAMS).alias("parameters"),
        F.lit("ambiguous — manual review (pipeline_fallback)").alias("reason"),
    )


SUGGESTION = ["category", "action", "label", "merge_label", "event_name", "parameters", "reason"]


def attach_suggestions(elements: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every element with exactly one suggestion (``s`` struct); ``s_source`` tells where it came from.

    Of several suggestions for an element the last by ``seq`` stays, or without one the greatest."""
    order = F.struct(*(["seq"] if "seq" in suggestions.columns else []), *SUGGESTION)
    one = suggestions.groupBy(*KEYS).agg(F.max_by(F.struct(*SUGGESTION), order).alias("_s"))
    rows = elements.join(one, KEYS, "left")
    return rows.withColumn("s", F.coalesce("_s", fallback_suggestion(elements))).withColumn(
        "s_source", F.when(F.col("_s").isNull(), F.lit("rule")).otherwise(F.lit("model"))
    ).drop("_s")


def dom_category_override(rows: DataFrame) -> DataFrame:
    """Where an element sits overrules a vague area: landmark, menu path and bottom bar force the
    global areas, otherwise a section heading replaces a vague name outside banners."""
    start = F.coalesce(T.blank_null(F.col("s.category")), F.lit("unknown"))
    forced = (
        F.when((F.col("landmark") == "gnb") | F.col("has_menu_path"), F.lit("global/gnb"))
        .when((F.col("landmark") == "fnb") | F.col("platform_reason").contains("fixed-bottom-nav"), F.lit("global/fnb"))
        .otherwise(start)
    )
    heading = T.blank_null(F.col("section_heading"))
    in_banner = T.is_banner_context(F.col("section_heading"), F.col("dom_path"), F.array_join("parent_labels", " "))
    rows = rows.withColumn("_c", forced)
    vague = F.col("_c").isin(VAGUE_AREAS) & ~F.col("has_menu_path") & heading.isNotNull() & ~in_banner
    rows = rows.withColumn("_c", F.when(vague, heading).otherwise(F.col("_c")))
    action = F.when(F.col("_c") == "global/gnb", F.lit("click_gnb")).when(
        F.col("_c") == "global/fnb", F.lit("click_fnb")
    ).otherwise(F.col("s.action"))
    return rows.withColumn("s", F.col("s").withField("category", F.col("_c")).withField("action", action)).drop("_c")


def canonical_fields(rows: DataFrame, page_category: Column, area: Column, label: Column, merge_label: Column,
                     event_name: Column, action_key: Column, platform: Column, context: Column, link_url: Column,
                     extras: Column | None = None) -> DataFrame:
    """Sets page_category, category, action, action_key, label, merge_label, event_name, parameters
    consistently."""
    page = F.coalesce(T.blank_null(page_category), F.lit(T.DEFAULT_PAGE))
    # in two steps, so that page and area are worked out once per row
    rows = rows.withColumns({"_page": page, "_area": T.category_display(area), "_context": context})
    page, shown = F.col("_page"), F.col("_area")
    return rows.withColumns({
        "parameters": P.click_params(page, shown, label, platform, F.col("_context"), link_url, extras),
        "page_category": page, "category": page, "action": shown, "action_key": action_key, "label": label,
        "merge_label": F.coalesce(T.blank_null(merge_label), F.trim(label)), "event_name": event_name,
    }).drop("_page", "_area", "_context")


def page_view_rows(pages: DataFrame) -> DataFrame:
    """One synthetic tag 0 row per (page, viewport).

    pages(page_key, url, viewport, page_category, context)."""
    page = F.coalesce(T.blank_null(F.col("page_category")), F.lit(T.DEFAULT_PAGE))
    platform = T.platform_label(F.col("viewport"))
    pages = pages.withColumn("page_category", page)
    page = F.col("page_category")
    return pages.select(
        *[c for c in pages.columns if c not in ("page_category", "context")],
        F.lit(0).alias("tag_id"), page.alias("text"), F.lit("document").alias("selector_hint"),
        page.alias("page_category"), page.alias("category"), F.lit("").alias("action"), F.lit("page_view").alias("action_key"),
        F.lit("").alias("label"), F.lit("").alias("merge_label"), F.lit(T.PAGE_VIEW_EVENT).alias("event_name"),
        F.lit("page").alias("event_type"), platform.alias("platform"),
        P.page_view_params(page, platform, F.col("context")).alias("parameters"),
    )


# ------------------------------------------------------------------ geometry and platform


def apply_positions(candidates: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Stored geometry wins where it says something; the hidden reason is worked out again."""
    p = positions.select(*keys, F.struct("selector_hint", "bbox", "hidden_reason", "platform").alias("_p"))
    rows = candidates.join(p, keys, "left")
    box = F.coalesce("_p.bbox", "bbox")
    reason = G.reconcile_hidden(F.coalesce("_p.hidden_reason", "hidden_reason"), box)
    return rows.withColumns({
        "selector_hint": F.coalesce(T.blank_null(F.col("_p.selector_hint")), F.col("selector_hint")),
        "hidden_reason": F.when(F.col("_p").isNotNull(), reason).otherwise(F.col("hidden_reason")),
        "bbox": box,
        "platform": F.coalesce("_p.platform", "platform"),
    }).drop("_p")


def merge_capture_boxes(candidates: DataFrame, captured: DataFrame, keys: list[str], mode: str = "overlay") -> DataFrame:
    """Tagging-time box against capture-time box; adds capture_found."""
    c = captured.select(*keys, F.col("bbox").alias("_cap"))
    rows = candidates.join(c, keys, "left")
    box = F.when(F.col("tag_id") == 0, F.col("bbox")).otherwise(
        G.pick_bbox(F.col("bbox"), F.col("_cap"), F.col("has_menu_path"), mode)
    )
    rows = rows.withColumn("_box", box)
    return rows.withColumns({
        "hidden_reason": F.when(F.col("tag_id") == 0, F.col("hidden_reason"))
        .otherwise(G.reconcile_hidden(F.col("hidden_reason"), F.col("_box"))),
        "capture_found": (G.bbox_area(F.col("_cap")) > 0) & (F.col("tag_id") != 0),
        "bbox": F.col("_box"),
    }).drop("_cap", "_box")


def cross_viewport_platform(current: DataFrame, opposite: DataFrame, keys: list[str]) -> DataFrame:
    """Platform from visibility in both viewports; rows unknown to the other viewport stay as they are."""
    rows = current.join(opposite.select(*keys, F.col("is_visible").alias("_opp")), keys, "left")
    cur, opp = F.coalesce("is_visible", F.lit(False)), F.col("_opp")
    weak = F.col("platform_reason").isNull() | F.col("platform_reason").rlike("^(ambiguous|zero_size@|collapsed:$|$)")
    own = T.platform_label(F.col("viewport"))
    other = F.when(F.col("viewport") == "mo", F.lit("PC")).otherwise(F.lit("MO"))
    s = lambda p, r: F.struct(p.alias("p"), F.lit(r).alias("r"))
    new = F.when(opp.isNotNull(), (
        F.when(cur & opp, s(F.lit("All"), "visible_both_viewports")).when(cur & ~opp, s(own, "visible_current_only"))
        .when(opp, s(other, "visible_opposite_only")).when(weak, s(F.lit("All"), "hidden_both_no_signal"))
    ))
    return rows.withColumn("_n", new).withColumns({
        "platform": F.coalesce("_n.p", "platform"), "platform_reason": F.coalesce("_n.r", "platform_reason"),
    }).drop("_n", "_opp")


def visible_in_viewport(tag_id: Column, platform: Column, viewport: Column) -> Column:
    p = F.coalesce(platform, F.lit("All"))
    return (tag_id == 0) | (p == "All") | (p == T.platform_label(viewport))


def confirmed_position(tag_id: Column, bbox: Column) -> Column:
    return (tag_id == 0) | G.has_bbox(bbox)


def no_capture(tag_id: Column, bbox: Column, hidden_reason: Column) -> Column:
    return (tag_id == 0) | ~G.has_bbox(bbox) | F.coalesce(hidden_reason.isin(NO_CAPTURE_REASONS), F.lit(False))


def tiny_decorative(tag: Column, bbox: Column, href: Column) -> Column:
    """Under 16 by 16 and neither a form control nor a real link."""
    real = (tag == "a") & F.coalesce((F.trim(href) != "") & (F.trim(href) != "#"), F.lit(False))
    control = tag.isin("button", "input", "select", "textarea")
    return G.has_bbox(bbox) & (bbox["w"] < 16) & (bbox["h"] < 16) & ~control & ~real


def ambiguous_or_all(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ambiguous rows of a page when it has any, else all of its rows."""
    flags = rows.groupBy(*keys).agg(F.max("ambiguous").alias("_any"))
    return rows.join(flags, keys).filter(~F.col("_any") | F.col("ambiguous")).drop("_any")


# ------------------------------------------------------------------ captures, aliases, edits


def attach_captures(candidates: DataFrame, captures: DataFrame, keys: list[str]) -> DataFrame:
    """capture_status done or failed for every element; page views stay untouched."""
    c = captures.select(*keys, F.struct("ok", "capture_url", "bbox").alias("_c"))
    rows = candidates.join(c, keys, "left")
    ok = F.coalesce("_c.ok", F.lit(False))
    view = F.col("tag_id") == 0
    return rows.withColumns({
        "capture_status": F.when(view, F.lit("done")).when(ok, F.lit("done")).otherwise(F.lit("failed")),
        "element_capture_url": F.when(ok & ~view, F.col("_c.capture_url")),
        "capture_found": ok & ~view,
        "no_capture": ~ok & ~view,
        "bbox": F.when(ok & ~view, F.coalesce("_c.bbox", "bbox")).otherwise(F.col("bbox")),
    }).drop("_c")


def sync_group_members(members: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Group members with the newest geometry of their candidate."""
    fresh = candidates.select(*keys, F.col("bbox").alias("_b"), F.col("hidden_reason").alias("_h"))
    rows = members.join(fresh, keys, "left")
    return rows.withColumns({
        "bbox": F.coalesce("_b", "bbox"), "hidden_reason": F.coalesce("_h", "hidden_reason"),
    }).drop("_b", "_h")


def orphans(candidates: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(elements.select(*keys), keys, "left_anti")


def apply_alias(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """A page alias replaces the page category of its candidates; global header and footer areas keep
    their own tab; page views are rebuilt.  aliases(page_key, alias)."""
    rows = candidates.join(aliases.select("page_key", T.blank_null(F.col("alias")).alias("_a")), "page_key", "left")
    view = P.is_page_view(F.col("tag_id"), F.col("action_key"))
    area = F.coalesce(
        T.blank_null(P.tagging_area(F.col("tag_id"), F.col("action_key"), F.col("action"), F.col("parameters"),
                                    F.col("page_category"))), F.lit(T.OTHER_AREA))
    page = F.when(view, F.col("_a")).otherwise(T.resolve_page_category(F.col("_a"), area))
    has = F.col("_a").isNotNull()
    fresh = {"page_category": page, "category": page, "page_name": F.col("_a")}
    patched = F.transform(F.col("parameters"), lambda p: F.when(
        p["name"].isin("page_category") | (p["name"].isin("category", "page_name")),
        p.withField("value_hint", page)).otherwise(p))
    return rows.withColumns({
        "page_category": F.when(has, fresh["page_category"]).otherwise(F.col("page_category")),
        "category": F.when(has, fresh["category"]).otherwise(F.col("category")),
        "text": F.when(has & view, F.col("_a")).otherwise(F.col("text")),
        "parameters": F.when(has, patched).otherwise(F.col("parameters")),
    }).drop("_a")


def resolve_targets(saved: DataFrame, elements: DataFrame) -> DataFrame:
    """Find saved elements again in a newer snapshot.

    saved(page_id, saved_id, tag_id, selector_hint, selectors_fallback, has_bbox),
    elements(page_id, tag_id, selector_hint).  Order: tag id, hint that occurs once, first fallback
    that occurs once, box only, none."""
    saved, elements = settle(saved), settle(elements)
    unique = elements.groupBy("page_id", F.col("selector_hint").alias("_sel")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("tag_id").alias("_tag")
    ).filter("_n = 1").drop("_n")
    ids = elements.select("page_id", "tag_id", F.lit(True).alias("_by_id"))
    tries = saved.select(
        "page_id", "saved_id",
        F.posexplode(F.concat(F.array(F.trim("selector_hint")), F.coalesce("selectors_fallback", F.array().cast("array<string>"))))
        .alias("_pos", "_sel"),
    ).filter(F.trim("_sel") != "")
    first = tries.join(unique, ["page_id", "_sel"]).groupBy("page_id", "saved_id").agg(
        F.min(F.struct("_pos", "_sel", "_tag")).alias("_hit")
    )
    rows = saved.join(ids, KEYS, "left").join(first, ["page_id", "saved_id"], "left")
    method = (
        F.when(F.col("_by_id"), F.lit("tag_id")).when(F.col("_hit._pos") == 0, F.lit("selector_hint"))
        .when(F.col("_hit").isNotNull(), F.lit("fallback")).when(F.col("has_bbox"), F.lit("bbox_only")).otherwise(F.lit("none"))
    )
    return rows.select(
        "page_id", "saved_id", method.alias("method"),
        F.when(F.col("_by_id"), F.concat(F.lit('[data-tag-id="'), "tag_id", F.lit('"]'))).otherwise(F.col("_hit._sel"))
        .alias("resolved_selector"),
        F.when(F.col("_by_id"), F.col("tag_id")).otherwise(F.col("_hit._tag")).alias("resolved_tag_id"),
    )
