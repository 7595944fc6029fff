"""Text, naming and key expressions (all Column in, Column out)."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from webplan.functions.base import let

# ------------------------------------------------------------------ fixed values

PAGE_VIEW_EVENT = "페이지뷰"
CLICK_EVENT = "클릭"
DEFAULT_PAGE = "페이지"
OTHER_AREA = "기타"
NO_BUTTON_LABEL = "(버튼명 없음)"

# Event names known before any run, with their meaning.
DEFAULT_REGISTRY = {
    "페이지뷰": "페이지 진입 시 발생",
    "클릭": "일반 버튼/링크 이동",
    "배너이동": "캐러셀·슬라이더 좌우 이동",
    "찜하기": "위시리스트(하트) 추가",
}

# Area key to display name.
AREA_NAMES = {
    "global/gnb": "GNB", "global/fnb": "Footer", "hero": "배너", "main_banner": "메인 배너", "main": "메인",
    "banner": "배너", "product_list": "상품 목록", "product": "상품", "recommendation": "추천 상품",
    "recommend": "추천 상품", "search": "검색", "footer": "푸터", "header": "헤더", "popup": "팝업",
    "modal": "모달", "cart": "장바구니", "wishlist": "찜", "login": "로그인", "signup": "회원가입",
    "lounge": "라운지", "store": "스토어",
}

# Action key to display name.
ACTION_NAMES = {
    "click_gnb": "GNB 메뉴", "click_fnb": "Footer 메뉴", "slide_nav": "슬라이드 이동",
    "add_to_cart": "장바구니 담기", "add_wishlist": "찜하기", "view_detail": "상세 보기", "navigate": "이동",
    "open_menu": "메뉴 열기", "search": "검색", "login": "로그인", "signup": "회원가입",
}

# Actions that say nothing beyond "something was pressed".
GENERIC_ACTIONS = [
    "navigate", "click", "interact", "menu", "open_menu", "nav_link", "link", "click_gnb", "click_fnb",
]
# Action words used internally, never shown as a screen area.
INTERNAL_ACTIONS = ["click", "slide_nav", "page_view", "add_wishlist", "interact"]
# Event name to action key.
EVENT_ACTIONS = {"배너이동": "slide_nav", "찜하기": "add_wishlist", "클릭": "click", "페이지뷰": "page_view"}

# Wording that marks carousels, their headings, and product lists that only look like one.
BANNER_PATH_PATTERN = (
    r"(?i)swiper|carousel|slider|slick|splide|hero[-_]?banner|main[-_]?banner|rolling[-_]?banner"
    r"|visual[-_]?banner|main[-_]?visual|배너"
)
BANNER_HEADING_PATTERN = (
    r"(?i)^(메인\s*)?배너|main\s*banner|hero\s*banner|visual\s*banner|rolling\s*banner|캐러셀|슬라이드"
    r"|carousel|slider|swiper"
)
NOT_BANNER_PATTERN = r"(?i)추천|상품|product|recommend|card|wish|장바구니|혜택|프로모션|이벤트\s*배너"
HERO_PATTERN = r"(?i)메인|main|hero|visual|top|rolling"

HANGUL_PATTERN = "[가-힣]"

# White space as browsers' scripts know it.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# What the references to the numbers 128 to 159 stand for on the web.
C1_NUMBERS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
C1_MEANING = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
REFERENCE = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), key)


def trimmed(c: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank_null(c: Column) -> Column:
    """Trimmed text, with blank turned into null (so coalesce can pick the next source)."""
    return F.get(F.filter(F.array(trimmed(c)), lambda x: x != ""), F.lit(0))


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _character(number: Column) -> Column:
    """The character of a reference's number; one that stands for none gives the replacement character."""
    none = (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.isNull() | none, F.lit("\ufffd")).otherwise(F.translate(char, C1_NUMBERS, C1_MEANING))


def _referred(piece: Column) -> Column:
    """What a piece of text stands for: a character reference by number or name, or itself."""
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9A-Fa-f]{1,8});?$", 1)
    decimal = F.regexp_extract(piece, r"^&#0*([0-9]{1,10});?$", 1)
    number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).otherwise(decimal).try_cast("bigint")
    # a map is searched entry by entry, so the names are kept by their first letter
    names: dict[str, dict[str, str]] = {}
    for name, meaning in html.entities.html5.items():
        names.setdefault(name[0], {})[name] = meaning
    listed = F.from_json(F.lit(json.dumps(names)), "map<string,map<string,string>>")
    named = F.try_element_at(F.try_element_at(listed, F.substring(piece, 2, 1)), F.substring(piece, 2, 64))
    return F.when(piece.rlike("^&#"), _character(number)).when(piece.rlike("^&[A-Za-z]"), F.coalesce(named, piece)).otherwise(piece)


def decode_entities(c: Column) -> Column:
    """Character references replaced, by number or by the names of the standard (without its semicolon only where the
    name may stand so and no letter or digit follows)."""
    pieces = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, _referred), "")).otherwise(c)


def display_spacing(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def compact_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, f"{SPACE}+", ""))


def canonical_event_name(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def _slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "_")
    return F.regexp_replace(F.regexp_replace(s, r"^_+|_+$", ""), r"_+", "_")


def is_global_nav(category: Column) -> Column:
    return F.lower(F.trim(category)).rlike(r"^global/(gnb|fnb)")


def derive_event_name(category: Column, action: Column) -> Column:
    def name(v):
        cat, act = v["cat"], v["act"]
        clicked = act.startswith("click_")
        return (
            F.when((cat == "") & (act == ""), F.lit("click_ambiguous_element"))
            .when(cat == "", act)
            .when(act == "", cat)
            .when(v["nav"], F.when(clicked, act).otherwise(F.concat(F.lit("click_"), act)))
            .otherwise(F.concat_ws("_", cat, F.regexp_replace(act, r"^click_", "")))
        )

    parts = F.struct(_slug(category).alias("cat"), _slug(action).alias("act"), is_global_nav(category).alias("nav"))
    return F.substring(let(parts, name), 1, 80)


def is_valid_event_name(c: Column) -> Column:
    return let(canonical_event_name(nz(c)), _valid_name)


def _valid_name(n: Column) -> Column:
    return (
        F.length(n).between(1, 24)
        & ~n.rlike("[_/]")
        & ~n.rlike(r"(?i)^(slide|click|hero|banner|page)_")
        & ~(n.rlike(r"(?i)메인|배너|gnb|fnb") & (F.length(n) > 6))
        & n.rlike(HANGUL_PATTERN)
    )


def sanitize_event_name(c: Column, matched: Column, fallback: str = CLICK_EVENT) -> Column:
    """``matched`` is the registry name found for ``c`` (see operators.naming.registry_lookup)."""
    canon = canonical_event_name(c)
    return F.coalesce(matched, F.when(is_valid_event_name(c), canon), F.lit(fallback))


def action_from_event(c: Column) -> Column:
    return F.coalesce(lookup(EVENT_ACTIONS, c), F.lit("interact"))


def _title_words(c: Column) -> Column:
    """Upper-case the first character of every run of ASCII word characters, leave the rest."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100000))
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[a-z]"), cap(w)).otherwise(w)), "")


def category_display(c: Column) -> Column:
    def show(v):
        raw, tail = v["raw"], v["tail"]
        compact = compact_key(tail)
        carousel = compact.rlike("배너|banner|carousel|slider|swiper|hero")
        return F.coalesce(
            F.when(raw == "", F.lit(OTHER_AREA)),
            lookup(AREA_NAMES, F.lower(raw)),
            lookup(AREA_NAMES, F.lower(tail)),
            F.when(carousel, F.when(compact.rlike("메인|main|hero|top"), F.lit("메인 배너")).otherwise(F.lit("배너"))),
            F.when(tail.rlike(HANGUL_PATTERN), tail),
            _title_words(F.regexp_replace(tail, "_", " ")),
        )

    last = lambda raw: F.struct(raw.alias("raw"), F.trim(F.element_at(F.split(raw, "/", -1), -1)).alias("tail"))
    return let(let(F.trim(nz(c)), last), show)


def action_display(c: Column) -> Column:
    def show(key):
        rest = F.regexp_replace(F.substring(key, 7, 100000), "_", " ")
        return F.coalesce(
            lookup(ACTION_NAMES, key),
            F.when(key.startswith("click_"), F.when(rest != "", F.concat(rest, F.lit(" 클릭"))).otherwise(F.lit("클릭"))),
            F.regexp_replace(key, "_", " "),
        )

    return let(F.lower(F.trim(nz(c))), show)


def is_generic_action(c: Column) -> Column:
    return F.lower(F.trim(nz(c))).rlike("^(" + "|".join(GENERIC_ACTIONS) + ")?$|^click_")


def grouping_action_display(action: Column, event_name: Column) -> Column:
    return F.when(is_generic_action(action) & blank_null(event_name).isNotNull(), F.trim(event_name)).otherwise(
        action_display(action)
    )


def action_bucket(action_key: Column, action: Column, event_name: Column) -> Column:
    def choose(raw):
        return F.coalesce(
            F.when(~is_generic_action(raw), raw), F.concat(F.lit("evt::"), blank_null(event_name)), raw, F.lit("click")
        )

    return let(F.coalesce(blank_null(action_key), blank_null(action)), choose)


def is_redundant_action(category: Column, action: Column) -> Column:
    act = F.lower(F.trim(nz(action)))
    names = F.struct(
        compact_key(category_display(category)).alias("c"),
        F.regexp_replace(compact_key(action_display(action)), "메뉴", "").alias("a"),
    )
    alike = let(names, lambda n: (n["c"] != "") & (n["a"] != "") & (n["a"].contains(n["c"]) | n["c"].contains(n["a"])))
    return (
        (act == "")
        | act.isin(GENERIC_ACTIONS)
        | (is_global_nav(category) & (act.startswith("click_") | act.contains("nav")))
        | alike
    )


def group_display_label(category: Column, action: Column, members: Column, first_label: Column) -> Column:
    """Header text of a group with ``members`` rows whose first member shows ``first_label``."""
    return (
        F.when(is_global_nav(category), F.when(F.lower(category).startswith("global/fnb"), F.lit("Footer"))
               .otherwise(F.lit("GNB")))
        .when(members > 1, category_display(category))
        .otherwise(F.coalesce(blank_null(first_label), blank_null(category_display(category)), action_display(action)))
    )


# ------------------------------------------------------------------ keys


def group_key(category: Column, action: Column, event_name: Column) -> Column:
    return F.concat_ws("::", F.trim(category), F.trim(action), blank_null(event_name))


def row_key(page: Column, event: Column, category: Column, action: Column, label: Column, direction: Column) -> Column:
    dash = lambda c: F.coalesce(blank_null(c), F.lit("-"))
    return F.concat_ws("|", nz(page), nz(event), dash(category), dash(action), dash(label), dash(direction))


def event_doc_key(page: Column, event: Column) -> Column:
    return F.concat(page, F.lit("/"), event)


def candidate_key(page: Column, area: Column, label: Column) -> Column:
    return F.concat_ws("|", *[F.lower(display_spacing(nz(c))) for c in (page, area, label)])


def selection_key(page_key: Column, tag_id: Column) -> Column:
    return F.concat(page_key, F.lit("::"), tag_id.cast("string"))


def parse_selection_key(key: Column) -> Column:
    """struct(page_key, tag_id); both null when the key has no usable last ``::``."""
    pattern = r"(?s)^(.+)::\s*([+-]?\d+)[^:]*$"
    ok = key.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(key, pattern, 1)).alias("page_key"),
        F.when(ok, F.regexp_extract(key, pattern, 2)).try_cast("int").alias("tag_id"),
    )


def cell(c: Column) -> Column:
    return F.coalesce(blank_null(c), F.lit("-"))


def taxonomy_display(c: Column) -> Column:
    return F.when(c == "FNB", F.lit("Footer")).otherwise(c)


def sheet_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, r"[\\/?*\[\]:]", "_"), 1, 31)


def snapshot_name(site: Column, stamp: Column) -> Column:
    safe = F.regexp_replace(site, r"[^a-zA-Z0-9.-]", "_")
    return F.concat(safe, F.lit("-"), F.regexp_replace(stamp, r"[:.]", "-"), F.lit(".json"))


def action_image_key(event: Column, category: Column, action: Column, members: Column) -> Column:
    raw = F.concat_ws("_", nz(event), nz(category), nz(action), members.cast("string"))
    slug = F.substring(F.regexp_replace(raw, r"[^a-zA-Z0-9._-]+", "_"), 1, 68)
    return F.concat(F.when(slug == "", F.lit("action")).otherwise(slug), F.lit("_sq"))


def hook_slug(text: Column) -> Column:
    slug = F.regexp_replace(F.lower(F.trim(nz(text))), "[^a-z0-9가-힣]+", "-")
    slug = F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 24)
    return F.concat(F.lit('data-testid="'), F.when(slug == "", F.lit("el")).otherwise(slug), F.lit('"'))


def mask_key(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) <= 8, F.lit("****")).otherwise(F.concat(F.lit("…"), F.right(t, F.lit(6))))


def resolve_page_category(page: Column, area: Column) -> Column:
    key = F.lower(F.trim(nz(area)))
    return (
        F.when(key.startswith("global/gnb"), F.lit("GNB"))
        .when(key.startswith("global/fnb"), F.lit("Footer"))
        .otherwise(F.coalesce(blank_null(page), F.lit(DEFAULT_PAGE)))
    )


def infer_role(tag: Column) -> Column:
    return F.when(tag == "button", F.lit("button")).when(tag == "a", F.lit("link")).when(
        tag == "input", F.lit("textbox")
    )


def is_banner_context(section: Column, path: Column, labels: Column) -> Column:
    head = display_spacing(nz(section))
    trail = F.concat(nz(path), F.lit(" "), nz(labels))
    return (
        F.when((head != "") & head.rlike(NOT_BANNER_PATTERN), F.lit(False))
        .when((head != "") & head.rlike(BANNER_HEADING_PATTERN), F.lit(True))
        .when(trail.rlike(NOT_BANNER_PATTERN), F.lit(False))
        .otherwise(trail.rlike(BANNER_PATH_PATTERN))
    )


def banner_category(section: Column, path: Column, labels: Column, landmark: Column) -> Column:
    """'메인 배너', '배너' or null when the element is not inside a banner."""
    in_main = (landmark == "main") | nz(path).rlike(r"(?i)\bmain\b")
    hero = F.concat_ws(" ", display_spacing(nz(section)), nz(path)).rlike(HERO_PATTERN)
    return F.when(
        is_banner_context(section, path, labels),
        F.when(in_main & hero, F.lit("메인 배너")).otherwise(F.lit("배너")),
    )


def parse_viewport(c: Column) -> Column:
    return F.when(c.isin("pc", "PC"), F.lit("pc")).when(c.isin("mo", "MO"), F.lit("mo"))


def platform_label(viewport: Column) -> Column:
    return F.when(viewport == "mo", F.lit("MO")).otherwise(F.lit("PC"))


def default_viewports(raw: Column) -> Column:
    kept = F.array_distinct(F.filter(raw, lambda v: v.isin("pc", "mo")))
    return F.when(raw.isNull() | (F.size(kept) == 0), F.array(F.lit("pc"))).otherwise(kept)


def alias_from_title(title: Column) -> Column:
    t = F.trim(nz(title))
    return F.when((t == "") | (t == "시드 URL") | (F.length(t) > 28), F.lit("")).otherwise(t)


# Landmark name shown to a naming step.
LANDMARK_NAMES = {
    "gnb": "GNB(상단 헤더)", "fnb": "Footer(하단 푸터)", "nav": "내비게이션", "main": "본문 콘텐츠",
    "content": "일반 콘텐츠",
}


def dom_path_prompt(path: Column, landmark: Column, labels: Column, section: Column) -> Column:
    """One-line description of where an element sits, for prompts and logs."""
    quoted = lambda key, c: F.when(c != "", F.concat(F.lit(f'{key}="'), c, F.lit('"')))
    shown = F.concat(landmark, F.lit("("), lookup(LANDMARK_NAMES, landmark), F.lit(")"))
    line = F.concat(
        F.lit(" "),
        F.concat_ws(" ", quoted("dom_path", path), quoted("landmark", shown), quoted("parent_labels", labels),
                    quoted("section", nz(section))),
    )
    return F.when(nz(path) == "", F.lit("")).otherwise(line)


def hint_line(tag_id: Column, source: Column, event_name: Column, confidence: Column, note: Column) -> Column:
    """One line of the hints block."""
    return F.concat_ws(
        " ", F.concat(F.lit("- tag:"), tag_id), F.concat(F.lit("source="), source),
        F.when(nz(event_name) != "", F.concat(F.lit('suggested_name="'), event_name, F.lit('"'))),
        F.concat(F.lit("confidence="), F.format_string("%.2f", confidence)),
        F.when(nz(note) != "", F.concat(F.lit('note="'), note, F.lit('"'))),
    )


def candidate_line(tag_id: Column, name: Column, tag: Column, reason: Column) -> Column:
    """One line of the list of ambiguous candidates."""
    why = F.coalesce(F.concat(F.lit(", "), F.when(reason != "", reason)), F.lit(""))
    return F.concat(F.lit("- tag:"), tag_id, F.lit(" — **"), name, F.lit("** ("), tag, why, F.lit(")"))


def merge_line(kept: Column, merged: Column, reason: Column, url: Column, label: Column) -> Column:
    """Log line of one merge; ``merged`` is an array of tag ids."""
    head = F.concat(F.lit("[merge] kept="), kept, F.lit(" merged=["), F.array_join(merged, ", "), F.lit("] reason="))
    return F.when(reason == "same_href", F.concat(head, F.lit('same_href url="'), nz(url), F.lit('"'))).otherwise(
        F.concat(head, F.lit('same_merge_label merge_label="'), nz(label), F.lit('"'))
    )


def skip_line(kept: Column, reason: Column, label: Column, detail: Column) -> Column:
    """Log line of a pair that was not merged."""
    why = F.when(reason.isin("diff_page_category", "diff_area"), reason).otherwise(F.lit("diff_merge_label"))
    return F.concat(F.lit("[merge] kept="), kept, F.lit(" skipped_"), why, F.lit(' button="'), label, F.lit('" ('),
                    nz(detail), F.lit(")"))
