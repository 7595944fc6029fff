import html

import pytest
from pyspark.sql import functions as F

from webplan.functions import text as T
from webplan.operators import candidates as C
from webplan.operators import naming as N
from webplan.sources import pages as P

TEXTS = ["Fish &amp; Chips &#x2019; &copy; &middot;&nbsp;A", "&#8211;&#150;&#x80;", "&#0; &#xD800; &#1114112; &#99999999999;", "a & b &unknown; &amp", "&lt;b&gt; &NotEqualTilde; &AMP;",
         "plain", "", "&", "&#;", "&#x;", "&eacute;t&eacute"]


@pytest.mark.parametrize("text", TEXTS)
def test_references_are_read_as_by_the_standard(one, text):
    assert one(T.decode_entities(F.lit(text))) == html.unescape(text)


def test_white_space_of_any_kind_is_trimmed(spark, one):
    assert one(T.blank_null(F.lit("\n 　"))) is None and one(T.blank_null(F.lit("\n x "))) == "x"
    assert one(T.display_spacing(F.lit(" a   b\n"))) == "a b"
    page = spark.createDataFrame([("<title>\n  A &#8211; B\n</title>",)], "html string")
    assert P.with_titles(page).first()["title"] == "A – B"


def test_registry_takes_the_collapsed_spelling_before_a_spaced_twin(spark):
    registry = spark.createDataFrame([("찜 하기", 1), ("찜하기", 2), ("b  a", 3), ("b a", 4)], "name string, seq int")
    names = spark.createDataFrame([("찜  하기",), ("찜 하기",), ("b   a",), ("b a",), ("none",), ("",)], "name string")
    got = {r["name"]: r["registry_name"] for r in N.registry_lookup(names, "name", registry).collect()}
    assert got == {"찜  하기": "찜하기", "찜 하기": "찜 하기", "b   a": "b  a", "b a": "b a", "none": None, "": None}


def test_the_last_of_several_suggestions_stays(spark):
    rows = [(1, 1, v, s) for s, v in enumerate(["x", "z", "y"])]
    df = spark.createDataFrame(rows, "page_id bigint, tag_id int, category string, seq int")
    for c in ("action", "label", "merge_label", "event_name", "reason"):
        df = df.withColumn(c, F.col("category"))
    df = df.withColumn("parameters", F.array().cast(C.P.PARAMS)).repartition(3)
    els = spark.createDataFrame([(1, 1, "a", "", False, "main", "t")], "page_id bigint, tag_id int, tag string, section_heading string, has_menu_path boolean, landmark string, label string")
    els = els.withColumns({"text": F.lit("t"), "dom_path": F.lit(""), "parent_labels": F.array(F.lit("")), "platform_reason": F.lit(""), "identification_hints": F.lit("")})
    assert C.attach_suggestions(els, df).first()["s"]["category"] == "y"
    assert N.last_per_key(df.select("page_id", "tag_id", "category", "seq"), ["page_id", "tag_id"]).first()["category"] == "y"
