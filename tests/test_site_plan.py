import pytest
from pyspark.sql import functions as F

from webplan.plans import pages as PG

PAGE = """<html><head><title>{title}</title></head><body><nav><a href="/one">One</a><a href="/two">Two</a></nav>
<main><section aria-label="{area}"><button>Buy</button></section></main></body></html>"""
PAGES = [(1, "https://www.x.com/a", PAGE.format(title="Alpha", area="Deals")), (2, "https://www.x.com/b", PAGE.format(title="Beta", area="News")),
         (3, "https://m.y.com/c", PAGE.format(title="Gamma", area="Deals")), (4, "https://m.y.com/empty", None)]


@pytest.fixture(scope="module")
def plan(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    docs = spark.createDataFrame([("Beta|페이지뷰|페이지명 : Beta|-|-|-", "when Beta opens", "counts Beta", None, 1)],
                                 "key string, trigger string, description string, note string, seq int")
    properties = spark.createDataFrame([("platform", "device", "-")], "name string, description string, note string")
    return PG.SitePlan(pages, docs, properties)


def test_every_element_has_a_row_and_every_row_its_elements(plan):
    candidates = {(r["page_key"], r["tag_id"]) for r in plan.candidates.collect()}
    members = [(r["page_key"], r["tag_id"]) for r in plan.members.collect()]
    assert set(members) == candidates and len(members) == len(candidates) == 13
    keys = ["site", "viewport", "row_key"]
    counted = {tuple(r)[:3]: r["n"] for r in plan.members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()}
    listed = {tuple(r)[:3]: r["n"] for r in plan.events.groupBy(*keys).agg(F.sum("member_count").alias("n")).collect()}
    assert counted == listed


def test_common_and_own_events_are_documented(plan):
    rows = plan.events.collect()
    assert len(rows) == plan.sheets.count()
    common = [r for r in rows if r["is_common"]]
    assert {r["site"] for r in common} == {"x.com"} and all(r["tab_id"] == "common:pc" for r in common)
    views = {r["page_category"]: r for r in rows if r["event_name"] == "페이지뷰"}
    assert views["Beta"]["trigger"] == "when Beta opens" and views["Alpha"]["trigger"] == "Alpha 페이지가 로드·노출되었을 때"
    assert all(r["trigger"] and r["description"] for r in rows)


def test_variables_and_values_cover_all_elements(plan):
    variables = {(r["site"], r["name"]): r for r in plan.variables.collect()}
    assert len(variables) == 14 and variables["x.com", "platform"]["description"] == "device"
    assert variables["y.com", "platform"]["sample_value"] == "MO" and variables["x.com", "page_referrer"]["used_events"] == []
    values = {(r["site"], r["value"]): r["n"] for r in plan.values.filter("name = 'platform'").collect()}
    assert values == {("x.com", "PC"): 8, ("y.com", "MO"): 5}


def test_selection_reaches_all_tables(spark, plan):
    pages = spark.createDataFrame(PAGES[:1], "page_id long, url string, html string")
    key = plan.candidates.filter("page_id = 1").first()["page_key"]
    out = spark.createDataFrame([(key, 1, False)], "page_key string, tag_id int, selected boolean")
    none = spark.createDataFrame([], "key string, trigger string, description string, note string, seq int")
    rest = PG.SitePlan(pages, none, spark.createDataFrame([], "name string, description string, note string"), out)
    assert sorted(r["tag_id"] for r in rest.members.collect()) == [0, 2, 3]
    assert rest.summary.first()["excluded_candidates"] == 1
