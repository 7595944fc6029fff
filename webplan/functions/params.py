"""Event parameter arrays, payload structs and element locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import text as T
from webplan.functions.base import let

PARAMS = "array<struct<name:string,value_hint:string>>"
# The only extra parameter a naming step may add.
EXTRA_PARAMS = ["direction"]


def param(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value_hint"))


def param_value(params: Column, name: str) -> Column:
    """Value of the first entry called ``name``."""
    return F.get(F.filter(params, lambda p: p["name"] == name), F.lit(0))["value_hint"]


def dedupe_params(params: Column) -> Column:
    """First entry per name, order kept."""
    names = F.array_distinct(F.transform(params, lambda p: p["name"]))
    return F.transform(names, lambda n: F.get(F.filter(params, lambda p: p["name"] == n), F.lit(0)))


def allow_extras(params: Column) -> Column:
    return F.filter(params, lambda p: p["name"].isin(EXTRA_PARAMS))


def click_params(page_category: Column, action: Column, label: Column, platform: Column, context: Column,
                 link_url: Column, extras: Column | None = None) -> Column:
    """Ordered parameters of a click; ``context`` is urls.page_context(...)."""
    page = F.coalesce(T.blank_null(page_category), F.lit(T.DEFAULT_PAGE))
    return let(
        F.struct(page.alias("page"), action.alias("action"), label.alias("label")),
        lambda v: _click_params(v["page"], v["action"], v["label"], platform, context, link_url, extras),
    )


def _click_params(page: Column, action: Column, label: Column, platform: Column, context: Column, link_url: Column,
                  extras: Column | None) -> Column:
    fixed = F.array(
        param("platform", platform),
        param("page_location", context["page_location"]),
        param("page_path", context["page_path"]),
        param("page_title", F.when(context["page_title"] != "", context["page_title"])),
        param("page_category", page),
        param("category", page),
        param("action", F.coalesce(T.blank_null(action), F.lit(T.OTHER_AREA))),
        param("label", label),
        param("link_url", link_url),
    )
    # the fixed names are distinct already, so only extras can repeat
    return fixed if extras is None else dedupe_params(F.concat(fixed, allow_extras(extras)))


def page_view_params(page_category: Column, platform: Column, context: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    fields = lambda page: F.array(
        param("platform", platform),
        param("page_location", context["page_location"]),
        param("page_path", context["page_path"]),
        param("page_title", blank(context["page_title"])),
        param("page_referrer", blank(context["page_referrer"])),
        param("page_category", page),
        param("page_name", page),
    )
    return let(F.coalesce(T.blank_null(page_category), F.lit(T.DEFAULT_PAGE)), fields)


# ------------------------------------------------------------------ reading a candidate row


def is_page_view(tag_id: Column, action_key: Column) -> Column:
    return (tag_id == 0) | (F.coalesce(action_key, F.lit("")) == "page_view")


def tagging_page_category(page_category: Column, params: Column, category: Column) -> Column:
    return F.coalesce(
        T.blank_null(page_category), T.blank_null(param_value(params, "page_category")), T.blank_null(category),
        F.lit(T.OTHER_AREA),
    )


def tagging_area(tag_id: Column, action_key: Column, action: Column, params: Column, page: Column) -> Column:
    """Screen area of a candidate; ``page`` is its tagging_page_category."""
    shown = let(T.blank_null(action), lambda own: F.when(~own.isin(T.INTERNAL_ACTIONS), own))
    old = let(T.blank_null(param_value(params, "category")), lambda c: F.when(c != page, c))
    return F.when(is_page_view(tag_id, action_key), F.lit("")).otherwise(
        F.coalesce(shown, T.blank_null(param_value(params, "action")), old, F.lit(T.OTHER_AREA))
    )


def tagging_action_key(action_key: Column, action: Column) -> Column:
    return F.coalesce(T.blank_null(action_key), T.blank_null(action), F.lit("click"))


# Keys of the payload, in order.
PAYLOAD_KEYS = [
    "page_category", "page_name", "category", "action", "label", "platform", "link_url", "direction", "page_location",
    "page_path", "page_title", "page_referrer",
]


def transmission_payload(c) -> Column:
    """Flat payload struct of a candidate; ``c(name)`` returns its column.

    Page views carry page_name and no category, action or label."""
    params = c("parameters")
    of = lambda name: param_value(params, name)
    label = F.coalesce(F.when(T.nz(c("label")) != "", c("label")), c("text"), F.lit(""))

    def build(v):
        page, view = v["page"], v["view"]
        click = lambda value: F.when(~view, value)
        area = tagging_area(c("tag_id"), c("action_key"), c("action"), params, page)
        default = F.when(view, F.lit(T.PAGE_VIEW_EVENT)).otherwise(F.lit(T.CLICK_EVENT))
        return F.struct(
            F.coalesce(T.blank_null(c("event_name")), default).alias("event_name"),
            page.alias("page_category"),
            F.when(view, F.coalesce(T.blank_null(of("page_name")), page)).alias("page_name"),
            click(page).alias("category"), click(area).alias("action"), click(F.trim(label)).alias("label"),
            F.coalesce(of("platform"), c("platform")).alias("platform"),
            click(of("link_url")).alias("link_url"), click(of("direction")).alias("direction"),
            *[of(k).alias(k) for k in ("page_location", "page_path", "page_title", "page_referrer")],
        )

    page = tagging_page_category(c("page_category"), params, c("category"))
    return let(F.struct(page.alias("page"), is_page_view(c("tag_id"), c("action_key")).alias("view")), build)


def params_record(payload: Column) -> Column:
    """Payload as map<string,string> without the event name and without blank values."""
    pairs = lambda p: F.array(*[F.struct(F.lit(k), F.trim(p[k])) for k in PAYLOAD_KEYS])
    return F.map_filter(F.map_from_entries(let(payload, pairs)), lambda k, v: F.coalesce(v, F.lit("")) != "")


def element_location(tag_id: Column, selector: Column, fallbacks: Column, bbox: Column, platform: Column,
                     hidden_reason: Column, text: Column, label: Column) -> Column:
    default = F.concat(F.lit('[data-tag-id="'), tag_id, F.lit('"]'))
    return F.struct(
        tag_id.alias("tag_id"),
        F.coalesce(T.blank_null(selector), default).alias("selector_hint"),
        F.when(F.size(fallbacks) > 0, fallbacks).alias("selectors_fallback"),
        bbox.alias("bbox"), platform.alias("platform"),
        G.reconcile_hidden(hidden_reason, bbox).alias("hidden_reason"),
        F.substring(F.coalesce(F.when(T.nz(text) != "", text), label, F.lit("")), 1, 120).alias("text"),
    )


def merge_location(base: Column, row: Column) -> Column:
    """``row`` wins field by field where it has a value; the hidden reason is worked out again."""
    bbox = F.coalesce(row["bbox"], base["bbox"])
    merged = F.struct(
        F.coalesce(row["tag_id"], base["tag_id"]).alias("tag_id"),
        F.coalesce(T.blank_null(row["selector_hint"]), base["selector_hint"]).alias("selector_hint"),
        F.when(F.size(row["selectors_fallback"]) > 0, row["selectors_fallback"])
        .otherwise(base["selectors_fallback"]).alias("selectors_fallback"),
        bbox.alias("bbox"), F.coalesce(row["platform"], base["platform"]).alias("platform"),
        G.reconcile_hidden(F.coalesce(row["hidden_reason"], base["hidden_reason"]), bbox).alias("hidden_reason"),
        F.coalesce(row["text"], base["text"]).alias("text"),
    )
    return F.when(row.isNull(), base).otherwise(merged)
