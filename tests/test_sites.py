from pyspark.sql import functions as F

from webplan.operators import dom as D
from webplan.operators import sites as SR


def test_rules_hold_for_their_site_alone(spark):
    rules = spark.createDataFrame(
        [("a.com", "panel_class", "own", "zone", 2), (None, "panel_class", "all", "z", 5), ("b.com", "mobile_class", "m", "^only-b", 0)], SR.RULES)
    pages = spark.createDataFrame([("https://www.a.com/x",), ("http://b.com/",), ("http://c.com",), (None,)], "url string")
    got = {r["url"]: r["site_rules"] for r in SR.with_site_rules(pages, rules).collect()}
    names = lambda url, kind: [x["name"] for x in got[url][kind]]
    assert names("https://www.a.com/x", "panel_class") == ["all", "own"] and names("http://c.com", "panel_class") == ["all"]
    assert names("http://b.com/", "mobile_class") == ["m"] and names("https://www.a.com/x", "mobile_class") == [] and len(got) == 4


def test_platform_follows_the_rules_of_the_site(spark):
    html = '<body><div class="only-b"><button>go</button></div></body>'
    pages = spark.createDataFrame([(1, "https://a.com/", html), (2, "https://b.com/", html)], "page_id bigint, url string, html string")
    rules = spark.createDataFrame([("b.com", "mobile_class", "m", "^only-b", 0)], SR.RULES)
    rows = SR.with_site_rules(D.element_table(pages).join(pages.select("page_id", "url"), "page_id"), rules)
    got = {r["page_id"]: (r["platform"], r["platform_reason"]) for r in D.with_platform(rows, F.lit("pc"), F.lit("visible"), F.lit("")).collect()}
    assert got == {1: ("PC", "visible@desktop-viewport"), 2: ("MO", "div.m")}


def test_wrapper_hooks(spark):
    rows = spark.createDataFrame([(1, 1, 10, 50, "/x"), (1, 2, 20, 30, "/x")], "page_id bigint, tag_id int, start int, end int, go string")
    kept = lambda **k: [(r["kept"], r["wrapper"]) for r in D.same_href_wrappers(rows, destination=F.col("go"), **k).collect()]
    assert kept() == [(2, 1)] and kept(priority=-F.col("tag_id")) == [(1, 2)]
