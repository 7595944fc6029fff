"""Hints of several sources, some of which fail."""

import os

import pytest
from pyspark.sql import functions as F

from webplan.operators import quality as Q
from webplan.sources import hints as H

ROW = "page_id long, tag_id long, event_name string, confidence double, note string, seq long"


def source(spark, *rows):
    return lambda: spark.createDataFrame(list(rows), ROW)


def told(found):
    return {r["source"]: (r["status"], r["hints"], r["unplaced"]) for r in found.report.collect()}


def test_a_source_that_raises_leaves_the_others(spark):
    """One fails while its rows are computed, after a first task that went well; one when asked; one is not there at all."""
    def late():
        rows = spark.range(2000, numPartitions=4).select(
            F.lit(1).alias("page_id"), F.col("id").alias("tag_id"), F.col("id").alias("seq"),
            F.when(F.col("id") == 1999, F.raise_error(F.lit("broken page"))).otherwise(F.lit("x")).alias("event_name"))
        return rows

    def early():
        raise ValueError("no key for this service\nsecond line")

    found = H.gather_hints(spark, {
        "stagehand": source(spark, (1, 1, "a", 0.5, "s", 7), (1, 2, None, None, None, 8), (None, 3, "b", 0.1, None, 9)),
        "late": late, "early": early, "absent": lambda: spark.read.parquet("/tmp/absent-hints-of-a-test"), "off": None,
        "skyvern": source(spark, (1, 1, "z", 0.9, "k", 0)), "none": source(spark)})
    assert told(found) == {
        "stagehand": ("done", 3, 1), "late": ("failed", 0, 0), "early": ("failed", 0, 0), "absent": ("failed", 0, 0), "off": ("off", 0, 0),
        "skyvern": ("done", 1, 0), "none": ("done", 0, 0)}
    errors = {r["source"]: r["error"] for r in found.report.collect()}
    assert errors["early"] == "no key for this service" and errors["late"] and errors["absent"]
    assert errors["stagehand"] is errors["off"] is None
    assert [r["source"] for r in found.report.collect()][:3] == ["stagehand", "late", "early"]
    assert {r["source"] for r in found.hints.collect()} == {"stagehand", "skyvern"} and found.hints.count() == 4
    merged = {(r["page_id"], r["tag_id"]): (r["source"], r["event_name"], r["note"]) for r in Q.merge_hints(found.hints).collect()}
    assert merged[1, 1] == ("skyvern", "z", "k | s") and merged[1, 2] == ("stagehand", None, None)


def test_earlier_sources_come_first_whatever_their_numbers(spark):
    """Equal worth: the first source asked wins, though its seq is the largest."""
    found = H.gather_hints(spark, {"one": source(spark, (1, 1, "a", 0.5, "n1", (1 << 48) - 1)), "two": source(spark, (1, 1, "b", 0.5, "n2", 0))})
    (row,) = Q.merge_hints(found.hints).collect()
    assert (row["source"], row["event_name"], row["note"]) == ("one", "a", "n1 | n2")


@pytest.mark.parametrize("seq", [None, -1, 1 << 48])
def test_rows_without_a_place_in_the_order_fail_their_source(spark, seq):
    found = H.gather_hints(spark, {"bad": source(spark, (1, 1, "a", 0.5, None, 1), (1, 2, "a", 0.5, None, seq)), "good": source(spark, (1, 1, "a", 0.5, None, 1))})
    assert told(found) == {"bad": ("failed", 0, 0), "good": ("done", 1, 0)}


def test_layouts_of_sources(spark):
    """Other types, absent, additional and clashing columns; repeated rows stay; a value that cannot be cast fails its source."""
    odd = lambda v: lambda: spark.createDataFrame([(v, "2", "5", "mine", "x")] * 2, "page_id string, tag_id string, seq string, source string, `a.b` string")
    found = H.gather_hints(spark, {"odd": odd("1"), "wrong": odd("one"), "unordered": lambda: spark.range(3)})
    assert told(found) == {"odd": ("done", 2, 0), "wrong": ("failed", 0, 0), "unordered": ("failed", 0, 0)}
    rows = found.hints.collect()
    assert found.hints.columns == H.HINT.names and len(rows) == 2 and rows[0] == rows[1]
    assert rows[0].asDict() == {"page_id": 1, "tag_id": 2, "source": "odd", "event_name": None, "confidence": None, "note": None, "parameters": None, "seq": 5}


def test_no_sources_and_none_that_works(spark):
    for sources in ({}, {"off": None}, {"absent": lambda: spark.read.parquet("/tmp/absent-hints-of-a-test")}):
        found = H.gather_hints(spark, sources)
        assert found.report.count() == len(sources) and found.hints.count() == 0 and Q.merge_hints(found.hints).count() == 0
        found.discard()


def test_discard_removes_the_stored_hints(spark):
    found = H.gather_hints(spark, {"one": source(spark, (1, 1, "a", 0.5, None, 0))})
    (folder,) = found.folders
    assert os.path.exists(folder)
    found.discard()
    assert not os.path.exists(folder)
