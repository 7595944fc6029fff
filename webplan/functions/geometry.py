"""Boxes, progress percentages and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Percentage range covered by each job stage.
STAGE_RANGES = {
    "crawling": (0, 15), "collecting": (15, 40), "tagging": (40, 55), "naming": (55, 90), "grouping": (90, 100),
    "waiting_mo": (95, 95), "done": (100, 100), "failed": (0, 0),
}


def js_round(c: Column) -> Column:
    """Half-up rounding toward +infinity."""
    return F.floor(c + 0.5)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("int").alias(k) for k, v in zip("xywh", (x, y, w, h))])


def bbox_area(b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), b["w"]) * F.greatest(F.lit(0), b["h"]), F.lit(0))


def has_bbox(b: Column) -> Column:
    return F.coalesce((b["w"] > 0) & (b["h"] > 0), F.lit(False))


def reconcile_hidden(reason: Column, b: Column) -> Column:
    return F.when(
        has_bbox(b),
        F.when(reason.isin("offscreen", "collapsed_parent"), F.lit("visible")).otherwise(F.coalesce(reason, F.lit("visible"))),
    ).when(F.coalesce(reason, F.lit("")).isin("", "visible"), F.lit("zero_size")).otherwise(reason)


def pick_bbox(tagged: Column, captured: Column, has_menu_path: Column, mode: str = "positions") -> Column:
    """One box from the tagging-time and the capture-time measurement.

    ``positions`` accepts the captured box only when it is at least half as large as the tagged one;
    ``overlay`` has no such guard."""
    ta, ca = bbox_area(tagged), bbox_area(captured)
    prefer = (ca >= ta * 0.5) if mode == "positions" else F.lit(True)
    return (
        F.when(ca <= 0, tagged).when(ta <= 0, captured).when(has_menu_path & (ta >= ca * 0.5), tagged)
        .when(prefer, captured).otherwise(tagged)
    )


def stage_percent(stage: Column, current: Column, total: Column) -> Column:
    start = F.lit(None).cast("int")
    end = F.lit(None).cast("int")
    for name, (a, b) in STAGE_RANGES.items():
        start = F.when(stage == name, F.lit(a)).otherwise(start)
        end = F.when(stage == name, F.lit(b)).otherwise(end)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), current / total))
    return (
        F.when(stage == "done", F.lit(100)).when((stage == "failed") | (total <= 0), start)
        .otherwise(js_round(start + ratio * (end - start))).cast("int")
    )


def crop_square(b: Column, img_w: Column, img_h: Column) -> Column:
    """struct(left, top, size): square crop around a union box, inside the image."""
    w, h = F.greatest(F.lit(1), b["w"]), F.greatest(F.lit(1), b["h"])
    longest = F.greatest(w, h)
    pad = F.when(longest < 40, F.lit(180)).otherwise(F.greatest(F.lit(80), js_round(longest * 0.45).cast("int")))
    wanted = longest + pad * 2
    side = F.greatest(F.least(F.lit(320), img_w, img_h), F.least(wanted, img_w, img_h))
    at = lambda lo, n, img: F.greatest(
        F.lit(0), F.least(js_round((lo + lo + n) / 2 - side / 2).cast("int"), (img - side).cast("int"))
    )
    left, top = at(b["x"], b["w"], img_w), at(b["y"], b["h"], img_h)
    size = F.greatest(F.lit(2), F.least(F.least(side, img_w - left), F.least(side, img_h - top)))
    return F.struct(left.alias("left"), top.alias("top"), size.cast("int").alias("size"))


def is_short_capture(png_h: Column, doc_h: Column, device_h: Column) -> Column:
    return F.when((png_h <= 0) | (doc_h <= 0), F.lit(True)).when(
        doc_h <= device_h + 40, png_h < device_h * 0.85
    ).otherwise(png_h < doc_h * 0.85)


def position_issue(b: Column, width: Column, height: Column) -> Column:
    """struct(status, reason) or null."""
    issue = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    outside = (b["x"] < 0) | (b["y"] < 0) | (b["x"] + b["w"] > width + 2) | (b["y"] + b["h"] > height + 2)
    return F.when(b.isNotNull(), (
        F.when(outside, issue("wrong", "박스가 캡처 이미지 범위를 벗어났습니다."))
        .when((b["w"] < 3) | (b["h"] < 3), issue("wrong", "박스 크기가 지나치게 작습니다."))
        .when(b["w"].cast("long") * b["h"] > width.cast("long") * height * 0.8,
              issue("suspicious", "단일 요소 박스가 페이지 대부분을 덮습니다."))
    ))


def recency_bucket(ts: Column, now: Column) -> Column:
    """오늘, 어제, n일 전 or month and day; '' when there is no time."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    day = 86400000000
    return (
        F.when(ts.isNull(), F.lit(""))
        .when((age >= 0) & (age < day), F.lit("오늘"))
        .when((age >= 0) & (age < 2 * day), F.lit("어제"))
        .when((age >= 0) & (age < 7 * day), F.concat(F.floor(age / day), F.lit("일 전")))
        .otherwise(F.concat(F.month(ts), F.lit(". "), F.dayofmonth(ts), F.lit(".")))
    )
