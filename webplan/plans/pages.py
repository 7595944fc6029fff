"""From page snapshots to the event taxonomy in one job."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import text as T
from webplan.functions import urls as U
from webplan.operators import candidates as C
from webplan.operators import dom as D
from webplan.operators import sites as SR
from webplan.plans import taxonomy as X
from webplan.session import settle
from webplan.sources.pages import with_titles

FIELDS = ["page_id", "site", "page_key", "viewport", "page_name", "tag_id", "text", "page_category", "category", "action", "action_key",
          "label", "merge_label", "event_name", "event_type", "platform", "parameters", "link_url", "bbox", "hidden_reason"]
BOX = "struct<x:int,y:int,w:int,h:int>"


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, title, site, viewport, page_key, hint (page category) and context of every page."""
    rows = with_titles(pages).select("page_id", "url", "title")
    return rows.select(
        "*", U.site_of(F.col("url")).alias("site"), U.viewport_of(F.col("url")).alias("viewport"),
        U.normalize_page_url(F.col("url")).alias("page_key"), U.page_category_hint(F.col("title"), F.col("url")).alias("hint"),
        U.page_context(F.col("url"), F.col("title")).alias("context"),
    )


def page_candidates(pages: DataFrame, suggestions: DataFrame | None = None, measurements: DataFrame | None = None,
                    rules: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url, html) -> canonical candidates, one page view per page included.

    ``suggestions`` name elements (see attach_suggestions; rules name the rest), ``measurements`` (page_id, tag_id, bbox,
    hidden_reason) place them, ``rules`` are site rules.  Without measurements elements have no box and the page source
    decides what is hidden."""
    spark = pages.sparkSession
    facts = page_facts(pages)
    els = D.element_table(pages).drop("url").join(facts, "page_id")
    els = SR.with_site_rules(els, SR.default_rules(spark) if rules is None else rules)
    if measurements is None:
        els = els.withColumn("bbox", F.lit(None).cast(BOX))
    else:
        seen = measurements.select("page_id", "tag_id", F.col("bbox").alias("_b"), F.col("hidden_reason").alias("_h"))
        els = els.join(seen, C.KEYS, "left").withColumn("bbox", F.col("_b")).withColumn(
            "hidden_reason", G.reconcile_hidden(F.coalesce("_h", "hidden_reason"), F.col("_b"))).drop("_b", "_h")
    els = D.with_platform(els, F.col("viewport"), F.col("hidden_reason"), F.lit(""))
    els = els.withColumn("has_menu_path", F.lit(False)).withColumn(
        "link", D.nav_link(F.col("chain"), F.col("inner_href"), F.col("identification_hints"), F.col("url")))
    els = els.select("page_id", "url", "site", "viewport", "page_key", "hint", "context", "tag_id", "text", "label", "landmark", "section_heading",
                     "dom_path", "parent_labels", "has_menu_path", "platform", "platform_reason", "hidden_reason", "bbox", "link")
    if suggestions is None:
        named = els.withColumn("s", C.fallback_suggestion(els))
    else:
        named = C.attach_suggestions(els, suggestions)
    named = C.dom_category_override(named)
    own = "s.category"
    rows = C.canonical_fields(
        named, T.resolve_page_category(F.col("hint"), F.col(own)), F.col(own), F.col("s.label"), F.col("s.merge_label"), F.col("s.event_name"),
        F.col("s.action"), F.col("platform"), F.col("context"), F.col("link"))
    rows = rows.withColumns({"event_type": F.lit("click"), "page_name": F.col("hint"), "link_url": F.col("link")})
    views = C.page_view_rows(facts.select("page_id", "site", "page_key", "viewport", F.col("hint").alias("page_name"), F.col("hint").alias("page_category"), "context"))
    views = views.withColumns({"link_url": F.lit(None).cast("string"), "bbox": F.lit(None).cast(BOX), "hidden_reason": F.lit(None).cast("string")})
    return rows.select(*FIELDS).unionByName(views.select(*FIELDS))


def chosen_candidates(pages: DataFrame, selection: DataFrame | None = None, **inputs) -> DataFrame:
    """Candidates of the pages with ``selected``; see site_taxonomy."""
    rows = page_candidates(pages, **inputs)
    return rows.withColumn("selected", F.lit(True)) if selection is None else X.with_selection(rows, selection)


def site_taxonomy(pages: DataFrame, selection: DataFrame | None = None, **inputs) -> DataFrame:
    """Pages -> event rows of every site: site, viewport, page_key, page_category, event_name, category, action, label,
    direction, sort_y, sort_x, member_count, is_common, row_key.

    selection(page_key, tag_id, selected); without one everything is selected.  ``inputs`` as in page_candidates."""
    return X.keyed_rows(X.label_rows(chosen_candidates(pages, selection, **inputs)))


class SitePlan:
    """The plan of every site from its pages; each table is computed when it is first asked for, and only once.

    docs(key, trigger, description, note, seq) and properties(name, description, note) may be empty: events without
    documentation get generated sentences.  ``selection`` and ``inputs`` as in site_taxonomy."""

    def __init__(self, pages: DataFrame, docs: DataFrame, properties: DataFrame, selection: DataFrame | None = None, **inputs):
        self._pages, self._docs, self._properties, self._selection, self._inputs = pages, docs, properties, selection, inputs

    @cached_property
    def candidates(self) -> DataFrame:
        """Elements and page views with ``selected``."""
        return settle(chosen_candidates(self._pages, self._selection, **self._inputs))

    @cached_property
    def _rows(self) -> DataFrame:
        return settle(X.label_rows(self.candidates))

    @cached_property
    def _keyed(self) -> DataFrame:
        return settle(X.keyed_rows(self._rows))

    @cached_property
    def members(self) -> DataFrame:
        """The elements behind every event row, with their parameters."""
        return settle(X.taxonomy_members(self.candidates, self._rows, self._keyed))

    @cached_property
    def events(self) -> DataFrame:
        """Event rows with tab, documentation and examples."""
        return settle(X.documented_rows(self._keyed, self.members, self._docs))

    @cached_property
    def variables(self) -> DataFrame:
        """The variable dictionary per site."""
        return X.variable_dictionary(self.candidates, self._properties)

    @cached_property
    def values(self) -> DataFrame:
        """How often each value of each parameter occurs."""
        return X.value_list(self.members)

    @cached_property
    def sheets(self) -> DataFrame:
        """Display columns of the events with sheet name and order."""
        return X.export_sheets(self.events)

    @cached_property
    def summary(self) -> DataFrame:
        """Counts per site."""
        return X.taxonomy_summary(self.candidates)
