import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from webplan.operators import grouping as GR
from webplan.operators import naming as N
from webplan.operators import quality as Q
from webplan.plans import taxonomy as X


def make(spark, rows):
    """rows: (page, tag_id, merge_label, link)"""
    data = [(p, "pc", t, lab or "x", lab, "메인", "배너", "click", "클릭", link) for p, t, lab, link in rows]
    df = spark.createDataFrame(data, "page_key string, viewport string, tag_id int, label string, merge_label string, page_category string, action string, "
                                     "action_key string, event_name string, link_url string")
    return df.withColumns({"parameters": F.array().cast("array<struct<name:string,value_hint:string>>"), "text": F.lit(""), "category": F.col("page_category"),
                           "bbox": F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"), "platform": F.lit("All")})


def test_closed_form_equals_union_find(spark):
    rng = random.Random(7)
    rows = [(f"p{p}", t + 1, rng.choice(["a", "b", "c", ""]), rng.choice([None, "/1", "/2", "/3", "/1"])) for p in range(60) for t in range(rng.randint(1, 9))]
    got = defaultdict(set)
    for r in GR.merge_clusters(make(spark, rows)).collect():
        got[(r["page_key"], r["cluster_key"])].add(r["tag_id"])
    by_page = defaultdict(list)
    for r in rows:
        by_page[r[0]].append(r)
    want, pairs = [], 0
    for page, members in by_page.items():
        parent = {m[1]: m[1] for m in members}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, a in enumerate(members):
            for b in members[i + 1:]:
                if a[2] and a[2] == b[2] and (not a[3] or not b[3] or a[3] == b[3]):
                    pairs += 1
                    parent[find(b[1])] = find(a[1])
        sets = defaultdict(set)
        for m in members:
            sets[find(m[1])].add(m[1])
        want += [(page, frozenset(x)) for x in sets.values()]
    assert sorted((k[0], sorted(v)) for k, v in got.items()) == sorted((p, sorted(x)) for p, x in want)
    assert GR.mergeable_pairs(make(spark, rows)).agg(F.sum("mergeable")).collect()[0][0] == pairs
    assert GR.merge_links(make(spark, rows)).count() == len(rows) - len(want)


def test_canonical_category_equals_direct_rule(spark):
    rng = random.Random(3)
    pool = ["추천 상품", "추천상품 리스트", "추천 상품 더보기", "베스트", "x", "배너", "베스트 상품", "추천  상품"]
    rows = [(g, rng.choice(pool), i) for g in range(120) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "g int, name string, seq int")
    got = {r["g"]: r["canonical"] for r in GR.canonical_category(df, ["g"], "name", "seq").collect()}
    groups = defaultdict(list)
    for g, n, _ in rows:
        groups[g].append(" ".join(n.split()))
    for g, names in groups.items():
        names = [n for n in names if len(n) >= 2]
        if not names:
            assert got[g] == "unknown"
            continue
        keyed = sorted(((n.replace(" ", "").lower(), n) for n in names), key=lambda x: (len(x[0]), len(x[1])))
        first = next((n for k, n in keyed if all(o.startswith(k) or k.startswith(o) for o, _ in keyed)), None)
        if first is None:
            counts = Counter(n for _, n in keyed)
            top = max(counts.values())
            best = [n for n in counts if counts[n] == top]
            first = min(best, key=len)
            ok = {n for n in best if len(n) == len(first)}
            assert got[g] in ok
        else:
            assert got[g] == first


def test_hint_fold_equals_sequential_fold(spark):
    rng = random.Random(5)
    src = list(Q.HINT_RANK)
    rows = [(1, t, rng.choice(src), rng.choice([None, "e1", "e2"]), rng.choice([0.2, 0.5, 0.5, 0.9]), rng.choice([None, "n1", "n2"]), i)
            for t in range(80) for i in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "page_id int, tag_id int, source string, event_name string, confidence double, note string, seq int")
    got = {r["tag_id"]: (r["source"], r["event_name"], r["confidence"], r["note"]) for r in Q.merge_hints(df).collect()}
    want = {}
    for _, t, s, e, c, n, _i in rows:
        if t not in want:
            want[t] = (s, e, c, n)
            continue
        a, b = want[t], (s, e, c, n)
        if not (a[2] > b[2] or (a[2] == b[2] and Q.HINT_RANK[a[0]] >= Q.HINT_RANK[b[0]])):
            a, b = b, a
        want[t] = (a[0], a[1] or b[1], a[2], " | ".join(x for x in (a[3], b[3]) if x) or None)
    assert got == want


def test_common_actions_need_every_page(spark):
    rows = [("s", "p1", "pc", "메뉴"), ("s", "p2", "pc", "메뉴"), ("s", "p1", "pc", "배너"), ("s", "p3", "mo", "메뉴")]
    df = spark.createDataFrame(rows, "site string, page_key string, viewport string, action string").withColumn("event_name", F.lit("클릭"))
    assert [(r["viewport"], r["action_key"]) for r in X.common_actions(df).collect()] == [("pc", "메뉴")]


def test_lossless_namer(spark):
    e = spark.createDataFrame([(1, 1, "gnb", None, "A"), (1, 2, "content", "S", "")], "page_id int, tag_id int, landmark string, section_heading string, label string")
    named = N.apply_namer(e, lambda rows: N.rule_namer(rows).filter("tag_id = 1").unionByName(N.rule_namer(rows).filter("tag_id = 1").withColumn("tag_id", F.lit(99))))
    rows = {r["tag_id"]: r["category"] for r in named.collect()}
    assert rows == {1: "global/gnb", 2: "S"}
    assert N.lossless_check(e, named, ["page_id", "tag_id"], ["page_id"]).count() == 0


def taxonomy_candidates(spark, rows):
    """rows: (page, tag_id, event, category, viewport) -> candidates of one site, all selected."""
    data = [("s", f"p{page}", view, view, t, "x", "x", cat, "배너", "click", event, None, "", cat, None, "All", True, "n") for page, t, event, cat, view in rows]
    df = spark.createDataFrame(data, "site string, page_key string, viewport string, v string, tag_id int, label string, merge_label string, page_category string, action string, "
                                     "action_key string, event_name string, link_url string, text string, category string, hidden_reason string, platform string, selected boolean, page_name string")
    return df.withColumns({"parameters": F.array().cast("array<struct<name:string,value_hint:string>>"), "area": F.col("action"),
                           "bbox": F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")})


def test_members_know_the_event_of_their_own_row(spark):
    """Two pages share an area, so their rows are merged; each element still tells its page's event, whatever its names hold."""
    rows = taxonomy_candidates(spark, [(1, 1, "클릭", "a | b", "pc"), (2, 1, "문의", "c", "pc")])
    got = {(r["page_key"], r["own_event"]) for r in X.taxonomy_members(rows, X.label_rows(rows)).collect()}
    assert got == {("p1", "클릭"), ("p2", "문의")}


def test_tabs_of_one_cut_name_may_be_numbered_apart(spark):
    long = "x" * 40
    rows = spark.createDataFrame([("s", v, False, f"{long}_{v.upper()}", 0, 0, v, "p", "클릭", "t", "c", "a", "l", "d") for v in ("mo", "pc")],
                                 "site string, viewport string, is_common boolean, tab_label string, sort_y int, sort_x int, row_key string, page_key string, event_name string, "
                                 "trigger string, category string, action string, label string, description string")
    assert {r["sheet_no"] for r in X.export_sheets(rows).collect()} == {1}
    assert {(r["viewport"], r["sheet_no"]) for r in X.export_sheets(rows, apart=True).collect()} == {("pc", 1), ("mo", 2)}
