"""From candidates to the event taxonomy: selection, action rows, common actions, documentation,
variable dictionary, summary and exports.

A taxonomy covers one ``site``.  One site may own a third of all rows, so everything keyed by
site is an aggregate with map-side combine, and member lists stay flat tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import params as P
from webplan.functions import text as T
from webplan.operators import candidates as C
from webplan.operators import grouping as GR
from webplan.session import settle

BUTTON_LABEL = "{{버튼명}}"
COMMON = "공통"
# Variables every event shares.
VARIABLES = ["platform", "page_location", "page_path", "page_title", "page_referrer", "page_category", "page_name"]
NUMBER_PATTERN = r"^-?\d+(\.\d+)?$"
PAGE = ["site", "page_key", "viewport"]


def shown(c: Column) -> Column:
    return F.regexp_replace(F.trim(T.nz(c)), "(?i)^fnb$", "Footer")


def is_page_view(c=F.col) -> Column:
    return P.is_page_view(c("tag_id"), c("action_key")) | (F.coalesce(c("event_name"), F.lit("")) == T.PAGE_VIEW_EVENT)


def with_selection(candidates: DataFrame, selection: DataFrame) -> DataFrame:
    """selected = false only where the selection says so."""
    s = selection.select("page_key", "tag_id", F.col("selected").alias("_s"))
    return candidates.join(s, ["page_key", "tag_id"], "left").withColumn("selected", F.coalesce("_s", F.lit(True))).drop("_s")


def action_members(candidates: DataFrame) -> DataFrame:
    """Visible and selected elements with their area, the reading position of their cluster and the
    taxonomy row they belong to.  ``candidates`` carries site, page_name and selected."""
    rows = GR.merge_clusters(candidates)
    first = F.min("_pos").over(W.partitionBy(*GR.BUCKET, "cluster_key"))
    rows = rows.withColumn("_at", first).filter(
        C.visible_in_viewport(F.col("tag_id"), F.col("platform"), F.col("viewport")) & F.col("selected")
        & (F.coalesce("event_name", F.lit("")) != T.PAGE_VIEW_EVENT)
    )
    return rows.withColumn("page_category", shown(F.col("page_category"))).withColumn("area", shown(T.category_display(F.col("area"))))


def label_rows(candidates: DataFrame) -> DataFrame:
    """One row per (page, viewport, page category, area) and one per selected page view."""
    candidates = settle(candidates)
    members = action_members(candidates)
    direction = T.blank_null(P.param_value(F.col("parameters"), "direction"))
    event = F.coalesce(T.blank_null(F.col("event_name")), F.lit(T.CLICK_EVENT))
    rows = members.groupBy(*PAGE, "page_category", "area").agg(
        F.min(F.struct("tag_id", event.alias("event_name"), direction.alias("direction"))).alias("p"),
        F.min("_at.y").alias("sort_y"), F.min("_at.x").alias("sort_x"), F.count(F.lit(1)).alias("member_count"),
    )
    clicks = rows.select(
        *PAGE, "page_category", "p.event_name", F.col("page_category").alias("category"), F.col("area").alias("action"),
        F.lit(BUTTON_LABEL).alias("label"), "p.direction", "sort_y", "sort_x", "member_count",
    )
    views = candidates.filter(is_page_view() & F.col("selected")).groupBy(*PAGE).agg(
        # two snapshots of one address: the first in the order of their names
        F.min(F.struct("tag_id", "page_category", "page_name")).alias("v")
    )
    page = shown(F.col("v.page_category"))
    name = F.coalesce(T.blank_null(shown(F.col("v.page_name"))), T.blank_null(page), F.lit(T.DEFAULT_PAGE))
    views = views.select(
        *PAGE, page.alias("page_category"), F.lit(T.PAGE_VIEW_EVENT).alias("event_name"),
        F.concat(F.lit("페이지명 : "), name).alias("category"), F.lit("").alias("action"), F.lit("").alias("label"),
        F.lit(None).cast("string").alias("direction"), F.lit(-1).alias("sort_y"), F.lit(-1).alias("sort_x"),
        F.lit(1).cast("long").alias("member_count"),
    )
    return clicks.unionByName(views)


def action_key() -> Column:
    return F.lower(shown(F.col("action")))


def common_actions(rows: DataFrame) -> DataFrame:
    """(site, viewport, action_key) present on every page of that site and viewport (two at least).

    Relational division by counting: pages per action against pages in all."""
    rows = settle(rows)
    used = rows.filter(F.col("event_name") != T.PAGE_VIEW_EVENT).select(*PAGE, action_key().alias("action_key")).distinct()
    pages = used.select(*PAGE).distinct().groupBy("site", "viewport").agg(F.count(F.lit(1)).alias("pages"))
    per_key = used.filter("action_key <> ''").groupBy("site", "viewport", "action_key").agg(F.count(F.lit(1)).alias("on_pages"))
    return per_key.join(pages.filter("pages >= 2"), ["site", "viewport"]).filter("on_pages = pages").drop("on_pages")


def _reading_order() -> Column:
    return F.struct(F.col("sort_y"), F.col("sort_x"), F.col("event_name"), F.col("category"), F.col("action"), F.col("label"),
                    F.col("page_key"), F.col("page_category"))


def partition_rows(rows: DataFrame) -> DataFrame:
    """Label rows with ``is_common``."""
    rows = settle(rows)
    common = common_actions(rows).select("site", "viewport", "action_key", F.lit(True).alias("_c"))
    return rows.withColumn("action_key", action_key()).join(common, ["site", "viewport", "action_key"], "left").withColumn(
        "is_common", F.coalesce("_c", F.lit(False)) & (F.col("event_name") != T.PAGE_VIEW_EVENT)
    ).drop("_c")


def common_rows(rows: DataFrame) -> DataFrame:
    """Label rows after the common ones of all pages were merged into one per (site, viewport, action)."""
    parts = settle(partition_rows(rows))
    merged = parts.filter("is_common").groupBy("site", "viewport", "action_key").agg(
        F.min_by(F.struct("page_key", "page_category", "category", "event_name", "action", "direction"), _reading_order()).alias("p"),
        F.min("sort_y").alias("sort_y"), F.min("sort_x").alias("sort_x"), F.sum("member_count").alias("member_count"),
    )
    page = F.coalesce(T.blank_null(shown(F.col("p.page_category"))), shown(F.col("p.category")))
    merged = merged.select(
        "site", "p.page_key", "viewport", page.alias("page_category"), "p.event_name", F.lit(COMMON).alias("category"),
        shown(F.col("p.action")).alias("action"), F.lit(BUTTON_LABEL).alias("label"), "p.direction", "sort_y", "sort_x", "member_count",
        F.lit(True).alias("is_common"),
    )
    return merged.unionByName(parts.filter("not is_common").select(*merged.columns))


# ------------------------------------------------------------------ documentation


def row_key(df_col=F.col) -> Column:
    return T.row_key(*[df_col(c) for c in ("page_category", "event_name", "category", "action", "label", "direction")])


def _usable(docs: DataFrame) -> DataFrame:
    return docs.filter((T.nz(F.col("trigger")) != "") | (T.nz(F.col("description")) != ""))


def attach_docs(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """trigger, description, note by exact row key, else by the key without its first part, else a
    generated sentence.  rows has row_key; docs(key, trigger, description, note, seq)."""
    body = F.struct(F.coalesce("trigger", F.lit("")).alias("trigger"), F.coalesce("description", F.lit("")).alias("description"),
                    F.coalesce("note", F.lit("")).alias("note"))
    rows, good = settle(rows), settle(_usable(docs))
    exact = good.groupBy(F.col("key").alias("row_key")).agg(F.max_by(body, F.col("seq")).alias("_e"))
    suffix = F.regexp_extract("key", r"(?s)^[^|]*\|(.*)$", 1)
    long_key = F.size(F.split("key", r"\|", -1)) >= 6
    loose = good.filter(long_key).groupBy(suffix.alias("_suffix")).agg(F.min_by(body, F.col("seq")).alias("_l"))
    area = F.coalesce(T.blank_null(shown(F.coalesce(T.blank_null(F.col("category")), F.col("action")))), F.lit("화면"))
    label = F.coalesce(T.blank_null(F.col("label")), F.lit("요소"))
    page = F.coalesce(T.blank_null(F.col("page_category")), F.lit(T.DEFAULT_PAGE))
    view = F.col("event_name") == T.PAGE_VIEW_EVENT
    made = F.struct(
        F.when(view, F.concat(page, F.lit(" 페이지가 로드·노출되었을 때")))
        .otherwise(F.concat(area, F.lit("에서 '"), label, F.lit("'을(를) 클릭했을 때"))).alias("trigger"),
        F.when(view, F.concat(page, F.lit(" 페이지 조회를 측정합니다.")))
        .otherwise(F.concat(area, F.lit("의 "), label, F.lit(" 클릭을 측정합니다."))).alias("description"),
        F.lit("-").alias("note"),
    )
    cols = [c for c in rows.columns if c not in ("trigger", "description", "note")]
    return (
        rows.select(*cols).withColumn("_suffix", F.regexp_extract("row_key", r"(?s)^[^|]*\|(.*)$", 1))
        .join(exact, "row_key", "left").join(loose, "_suffix", "left")
        .select(*cols, F.coalesce("_e", "_l", made).alias("_d")).select(*cols, "_d.*")
    )


def taxonomy_members(candidates: DataFrame, rows: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """(site, viewport, row_key, page_key, tag_id, link_url, params, own_event): the elements behind every taxonomy row;
    own_event is the event of their page's row, which may differ from that of the common row it was merged into.

    rows are the candidates' label rows; ``final`` is their ``keyed_rows`` where the caller has it already."""
    candidates, rows = settle(candidates), settle(rows)
    parts = partition_rows(rows).select(*PAGE, "page_category", "action", "action_key", "is_common", "event_name")
    final = settle(keyed_rows(rows) if final is None else final)
    common = final.filter("is_common").select("site", "viewport", action_key().alias("action_key"), F.col("row_key").alias("_ck"))
    own = final.filter("not is_common").select(*PAGE, "page_category", "action", "event_name", F.col("row_key").alias("_ok"))
    clicks = action_members(candidates).select(*PAGE, "page_category", F.col("area").alias("action"), "tag_id", *_payload_cols())
    views = candidates.filter(is_page_view() & F.col("selected")).select(
        *PAGE, shown(F.col("page_category")).alias("page_category"), F.lit("").alias("action"), "tag_id", *_payload_cols())
    rows_ = clicks.unionByName(views).join(parts, [*PAGE, "page_category", "action"])
    return (
        rows_.join(common, ["site", "viewport", "action_key"], "left")
        .join(own, [*PAGE, "page_category", "action", "event_name"], "left")
        .select("site", "viewport", F.when(F.col("is_common"), F.col("_ck")).otherwise(F.col("_ok")).alias("row_key"),
                "page_key", "tag_id", F.col("_link").alias("link_url"), F.col("_params").alias("params"), F.col("event_name").alias("own_event"))
    )


def _payload_cols() -> list[Column]:
    record = P.params_record(P.transmission_payload(F.col))
    return [record.alias("_params"), T.blank_null(P.param_value(F.col("parameters"), "link_url")).alias("_link")]


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Common and other label rows with their row key."""
    return common_rows(rows).withColumn("row_key", row_key())


def taxonomy_rows(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """The event table: one row per action (or page view) with tab, documentation and examples."""
    candidates = settle(candidates)
    rows = settle(label_rows(candidates))
    final = settle(keyed_rows(rows))
    return documented_rows(final, taxonomy_members(candidates, rows, final), docs)


def documented_rows(final: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """Keyed rows with tab, documentation and the examples that their members give."""
    first = lambda v: F.min_by(v, F.when(v.isNotNull(), F.struct("tag_id", "page_key")))
    examples = members.groupBy("site", "viewport", "row_key").agg(
        first(F.col("params")["platform"]).alias("platform"), first(F.col("link_url")).alias("link_url_example"),
    )
    suffix = F.upper("viewport")
    tab = F.when(F.col("is_common"), F.lit(COMMON)).otherwise(F.col("page_category"))
    final = final.withColumn("tab_label", F.concat(tab, F.lit("_"), suffix)).withColumn(
        "tab_id", F.when(F.col("is_common"), F.concat(F.lit("common:"), "viewport")).otherwise(
            F.concat("viewport", F.lit(":"), "page_category"))
    )
    # rows of several pages may share one key; they stay separate rows, as do their members
    return attach_docs(final, docs).join(examples, ["site", "viewport", "row_key"], "left").withColumn("scope", F.col("viewport"))


def taxonomy_order(rows: DataFrame) -> DataFrame:
    """Rows in reading order: tabs (common first, then by name in Korean order, 기타 last, PC before
    MO), then page views, position and names."""
    ko = lambda c: F.collate(F.col(c), "ko")
    return rows.orderBy(
        "site", F.when(F.col("viewport") == "pc", 0).otherwise(1), F.when(F.col("is_common"), 0).otherwise(1),
        F.when(F.col("page_category") == T.OTHER_AREA, 1).otherwise(0), ko("page_category"),
        F.when(F.col("event_name") == T.PAGE_VIEW_EVENT, 0).otherwise(1), "sort_y", "sort_x", ko("event_name"), ko("category"),
        ko("action"), ko("label"), "row_key", "page_key",
    )


# ------------------------------------------------------------------ variables and summary


def infer_param_type(values: Column) -> Column:
    """Aggregate: Double when every non-blank value is a number, else String."""
    v = T.blank_null(values)
    return F.when(F.coalesce(F.every(F.when(v.isNotNull(), v.rlike(NUMBER_PATTERN))), F.lit(False)), F.lit("Double")).otherwise(
        F.lit("String")
    )


def variable_dictionary(candidates: DataFrame, properties: DataFrame) -> DataFrame:
    """Seven shared variables per site with type, sample and the events that use them.

    properties(name, description, note)."""
    candidates = settle(candidates)
    chosen = action_members(candidates).select("site", "page_key", "tag_id", "event_name", *_payload_cols()).unionByName(
        candidates.filter(is_page_view() & F.col("selected")).select(
            "site", "page_key", "tag_id", F.lit(T.PAGE_VIEW_EVENT).alias("event_name"), *_payload_cols())
    )
    cells = chosen.select(
        "site", "page_key", "tag_id", F.coalesce(T.blank_null(F.col("event_name")), F.lit(T.CLICK_EVENT)).alias("event_name"),
        F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col("_params")[v].alias("value")) for v in VARIABLES])).alias("c"),
    ).select("site", "page_key", "tag_id", "event_name", "c.*")
    value = T.blank_null(F.col("value"))
    found = cells.groupBy("site", "name").agg(
        infer_param_type(F.col("value")).alias("type"),
        F.min_by(value, F.when(value.isNotNull(), F.struct("page_key", "tag_id", value))).alias("sample_value"),
    )
    # event names come from a registry, so the distinct set per variable is small
    used = cells.filter(value.isNotNull()).select("site", "name", "event_name").distinct().groupBy("site", "name").agg(
        F.array_sort(F.collect_list("event_name")).alias("used_events")
    )
    return found.join(used, ["site", "name"], "left").join(properties, "name", "left").select(
        "site", "name", "type", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("note", F.lit("")).alias("note"),
        "sample_value", F.coalesce("used_events", F.array().cast("array<string>")).alias("used_events"),
    )


def taxonomy_summary(candidates: DataFrame) -> DataFrame:
    """Counts per site.  Rows and candidates are counted under separate names."""
    candidates = settle(candidates)
    rows = settle(label_rows(candidates))
    events = common_rows(rows).groupBy("site").agg(F.count(F.lit(1)).alias("event_count"))
    picked = rows.groupBy("site").agg(F.count(F.lit(1)).alias("selected_rows"))
    total = candidates.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if("selected").alias("selected_candidates")
    )
    return total.join(events, "site", "left").join(picked, "site", "left").select(
        "site", "total_count", "selected_candidates", (F.col("total_count") - F.col("selected_candidates")).alias("excluded_candidates"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"), F.coalesce("selected_rows", F.lit(0)).alias("selected_rows"),
        (F.col("total_count") - F.coalesce("selected_rows", F.lit(0))).alias("excluded_rows"),
        F.lit(len(VARIABLES)).alias("parameter_count"),
    )


def value_list(members: DataFrame) -> DataFrame:
    """How often each parameter value occurs.  members has ``params``."""
    return members.select("site", F.explode("params").alias("name", "value")).groupBy("site", "name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


# ------------------------------------------------------------------ edits and older tables


def copy_by_row_key(rows: DataFrame, previous: DataFrame, column: str) -> DataFrame:
    """Carry a non-null attribute of earlier rows to the rebuilt ones."""
    old = previous.filter(F.col(column).isNotNull()).groupBy("site", "row_key").agg(F.max(column).alias("_v"))
    return rows.join(old, ["site", "row_key"], "left").withColumn(column, F.coalesce("_v", column)).drop("_v")


def propagate_row_edits(candidates: DataFrame, members: DataFrame, patches: DataFrame) -> DataFrame:
    """An edited taxonomy row changes every element behind it, on every page.

    patches(site, row_key, page_category, action, label, event_name, direction); null means unchanged."""
    candidates, members = settle(candidates), settle(members)
    fields = ["page_category", "action", "label", "event_name", "direction"]
    hit = members.join(patches, ["site", "row_key"]).groupBy("page_key", "viewport", "tag_id").agg(
        F.min_by(F.struct(*fields), "row_key").alias("_p")
    ).filter("tag_id <> 0")
    rows = candidates.join(hit, ["page_key", "viewport", "tag_id"], "left")
    edited = F.col("_p").isNotNull()
    new = lambda f, *rest: F.coalesce(T.blank_null(F.col(f"_p.{f}")), *[T.blank_null(r) for r in rest])
    label = new("label", F.coalesce(F.when(T.nz(F.col("label")) != "", F.col("label")), F.col("text")), F.lit("버튼"))
    page = new("page_category", F.col("page_category"), F.lit(T.OTHER_AREA))
    area = T.category_display(new("action", F.col("action"), F.lit(T.OTHER_AREA)))
    event = new("event_name", F.col("event_name"), F.concat(label, F.lit("_클릭")))
    direction = F.coalesce(T.blank_null(F.col("_p.direction")), P.param_value(F.col("parameters"), "direction"))
    fresh = {"page_category": page, "category": page, "action": area, "label": label}
    rows = rows.withColumn("_new", F.struct(*[v.alias(k) for k, v in fresh.items()], event.alias("event_name"), direction.alias("direction")))
    swap = F.transform(
        F.filter("parameters", lambda p: p["name"] != "direction"),
        lambda p: F.when(p["name"].isin(list(fresh)), p.withField("value_hint", F.when(p["name"] == "page_category", F.col("_new.page_category"))
                  .when(p["name"] == "category", F.col("_new.category")).when(p["name"] == "action", F.col("_new.action"))
                  .otherwise(F.col("_new.label")))).otherwise(p),
    )
    with_dir = F.when(F.col("_new.direction").isNotNull(), F.concat(swap, F.array(P.param("direction", F.col("_new.direction"))))).otherwise(swap)
    pick = lambda f: F.when(edited, F.col(f"_new.{f}")).otherwise(F.col(f))
    return rows.withColumn("parameters", F.when(edited, with_dir).otherwise(F.col("parameters"))).withColumns({
        **{f: pick(f) for f in fresh}, "event_name": pick("event_name"),
        "merge_label": F.when(edited, F.col("_new.label")).otherwise(F.col("merge_label")),
    }).drop("_p", "_new")


def changed_rows(base: DataFrame, draft: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose merged draft differs from the base in any of ``fields``."""
    d = draft.select("row_key", *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = base.join(d, "row_key")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~T.nz(F.col(f)).eqNullSafe(T.nz(F.coalesce(f"_d_{f}", f)))
    return joined.filter(differs).select("row_key", *[F.coalesce(f"_d_{f}", f).alias(f) for f in fields])


def display_name(c: Column) -> Column:
    """Trimmed text in which FNB reads Footer."""
    return F.regexp_replace(F.regexp_replace(F.trim(T.nz(c)), "(?i)^fnb$", "Footer"), r"\bFNB\b", "Footer")


def regroup_tabs(rows: DataFrame) -> DataFrame:
    """Rows of older taxonomy tables under the current tab layout; value lists and variable tabs drop out.

    rows(kind, scope, tab_id, tab_label, member_viewport, platform, page_category, category, action, event_name, …)."""
    name = display_name(F.col("tab_label"))
    old = (F.coalesce("scope", F.lit("")) == "common") | (F.trim("tab_label") == COMMON) | (F.col("tab_id") == "events:common")
    by_platform = F.when(F.lower(T.nz(F.col("platform"))).contains("mo"), F.lit("mo")).otherwise(F.lit("pc"))
    member = F.when(F.col("member_viewport").isin("pc", "mo"), F.col("member_viewport"))
    viewport = F.coalesce(F.when(~old & F.col("scope").isin("pc", "mo"), F.col("scope")), member, by_platform)
    out = rows.filter("kind = 'page_category'").withColumn("_old", old).withColumn("viewport", viewport)
    up = F.upper("viewport")
    label = F.when(F.col("_old"), F.concat(F.lit(COMMON + "_"), up)).when(name.rlike("(?i)_(PC|MO)$"), name).otherwise(
        F.concat(F.coalesce(T.blank_null(name), F.lit(T.OTHER_AREA)), F.lit("_"), up))
    common = F.col("_old") | F.col("tab_id").startswith("common:") | F.trim("tab_label").startswith(COMMON + "_")
    view = F.col("event_name") == T.PAGE_VIEW_EVENT
    page = F.coalesce(T.blank_null(display_name(F.col("page_category"))), F.lit(T.DEFAULT_PAGE))
    known = T.blank_null(display_name(F.col("category")))
    category = F.when(view, F.coalesce(F.when(known != "-", known), F.concat(F.lit("페이지명 : "), page))).when(
        common, F.lit(COMMON)).otherwise(known)
    out = out.withColumns({
        "_label": label, "category": category, "action": T.blank_null(display_name(F.col("action"))),
        "page_category": display_name(F.col("page_category")),
    })
    tab_id = F.when(F.col("_old"), F.concat(F.lit("common:"), "viewport")).otherwise(F.concat_ws(":", "viewport", "_label"))
    return out.withColumns({"tab_id": tab_id, "tab_label": F.col("_label")}).drop("_old", "_label")


# ------------------------------------------------------------------ exports


def export_sheets(rows: DataFrame, apart: bool = False) -> DataFrame:
    """Six display columns per row with sheet name and sheet order (common first, PC before MO, then
    by name).  Write with ``partitionBy("sheet")``.

    Names are cut, so tabs of PC and MO may share one: they are one sheet, or two of that name if ``apart``
    (then write with ``partitionBy("sheet_no")``)."""
    view = F.col("event_name") == T.PAGE_VIEW_EVENT
    dash = F.lit("-")
    keys = settle(rows).select(
        "site", "viewport", "is_common", T.sheet_name(F.col("tab_label")).alias("sheet"), "sort_y", "sort_x", "row_key", "page_key",
        F.col("event_name").alias("이벤트명"), T.cell(F.col("trigger")).alias("시점"), T.cell(shown(F.col("category"))).alias("카테고리"),
        F.when(view, dash).otherwise(T.cell(shown(F.col("action")))).alias("액션"),
        F.when(view, dash).otherwise(T.cell(F.col("label"))).alias("라벨"), T.cell(F.col("description")).alias("설명"),
    )
    # sheets are few, so they are ranked on their own small table and joined back
    one = ["site", "viewport", "sheet"] if apart else ["site", "sheet"]
    sheets = keys.groupBy(*one).agg(
        F.min(F.struct(F.when(F.col("is_common"), 0).otherwise(1).alias("c"), F.when(F.col("viewport") == "pc", 0).otherwise(1).alias("v"),
                       F.when(F.col("sheet").startswith(T.OTHER_AREA + "_"), 1).otherwise(0).alias("o"), F.col("sheet"))).alias("k"))
    order = F.row_number().over(W.partitionBy("site").orderBy("k"))
    return keys.join(sheets.select(*one, order.alias("sheet_no")), one)


def descriptions_from_taxonomy(rows: DataFrame, variables: DataFrame) -> DataFrame:
    """Documentation lookups recovered from a finished taxonomy; the last row of a key wins."""
    body = F.struct("trigger", "description", "note")
    events = rows.groupBy(F.col("row_key").alias("key")).agg(F.max_by(body, F.struct("seq")).alias("d")).select(
        F.lit("event").alias("kind"), "key", "d.*")
    props = variables.groupBy(F.col("name").alias("key")).agg(
        F.max_by(F.struct("description", "note"), F.struct("seq")).alias("d")
    ).select(F.lit("property").alias("kind"), "key", F.lit(None).cast("string").alias("trigger"), "d.description", "d.note")
    return events.unionByName(props)


def merge_registries(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Later parts win per key."""
    rest = [c for c in parts.columns if c not in keys and c != order]
    return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("v")).select(*keys, "v.*")


def missing_keys(expected: DataFrame, docs: DataFrame) -> DataFrame:
    """Keys that no document covers with a non-blank trigger or description."""
    covered = docs.filter((F.trim(T.nz(F.col("trigger"))) != "") | (F.trim(T.nz(F.col("description"))) != "")).select("key")
    return expected.select("key").distinct().join(covered, "key", "left_anti")
