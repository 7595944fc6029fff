import datetime as dt
import json
import random
import tempfile

from pyspark.sql import functions as F

from webplan.catalog import load, tables
from webplan.operators import quality as Q
from webplan.operators.links import dedupe_links, discovery_steps, rank_links, seeds_of
from webplan.sources import sitemaps as S
from webplan.sources import tables as TB


def test_sitemap_walk_is_breadth_first_and_capped(spark):
    host = "https://a.com"
    locs = [("a.com", f"{host}/sitemap.xml", True, 0, f"{host}/i1.xml"), ("a.com", f"{host}/sitemap.xml", True, 1, "https://other.com/x.xml"),
            ("a.com", f"{host}/r.xml", True, 0, f"{host}/sitemap.xml")]
    locs += [("a.com", f"{host}/i1.xml", True, k, f"{host}/s{k}.xml") for k in range(13)]
    locs += [("a.com", f"{host}/s{k}.xml", False, j, f"{host}/p{k}-{j}") for k in range(13) for j in range(2)]
    df = spark.createDataFrame(locs, "site string, doc_url string, is_index boolean, pos int, loc string")
    robots = spark.createDataFrame([("a.com", 0, f"{host}/r.xml")], "site string, pos int, sitemap_url string")
    seeds = spark.createDataFrame([("a.com", host)], "site string, origin string")
    rows = S.expand_sitemaps(df, robots, seeds, 1000, 12).orderBy("ord").collect()
    assert [r["doc_url"].replace(host, "") for r in rows] == [
        "/r.xml", "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/i1.xml", "/s0.xml", "/s1.xml", "/s2.xml", "/s3.xml", "/s4.xml", "/s5.xml"]
    # two pages per document: with a limit of 0.1 pages (2 raw) the walk stops after the first page document
    short = S.expand_sitemaps(df, robots, seeds, 0.1, 12).orderBy("ord").collect()
    assert short[-1]["doc_url"].endswith("/s0.xml")


def test_link_ranking(spark):
    rows = [("a.com", u, None, None, "map", i) for i, u in enumerate(["https://a.com/x/y", "https://b.a.com/", "https://a.com/z", "https://a.com/z/", "https://a.com/#top"])]
    df = spark.createDataFrame(rows, "site string, url string, title string, description string, source string, seq int")
    once = dedupe_links(df)
    ranked = rank_links(once, seeds_of(once), 10).orderBy("rank").collect()
    assert [r["url"] for r in ranked] == ["https://a.com/", "https://a.com/z", "https://a.com/x/y", "https://b.a.com/"]
    steps = discovery_steps(spark.createDataFrame([("a", 50)], "site string, n int"), 100).orderBy("step").collect()
    assert [(r["cap"], r["total"], r["added"]) for r in steps] == [(20, 20, 20), (40, 40, 20), (80, 50, 10)]


def test_unreadable_geometry_is_absent(spark):
    path = tempfile.mkdtemp(prefix="spark-pos-", dir="/tmp") + "/t"
    rows = spark.createDataFrame([("j1", "pc", "u", 2, "#a"), ("j1", "pc", "u", 1, "#b"), ("j1", "pc", "u", 0, "#c")], "job_id string, viewport string, page_url string, tag_id int, selector_hint string")
    rows = rows.withColumns({"bbox": F.struct(*[F.lit(1).alias(k) for k in "xywh"]), "platform": F.lit("PC"), "hidden_reason": F.lit("visible"), "text": F.lit("t")})
    TB.write_positions(rows, path)
    with open(path + "/job=j1/broken.json", "w") as f:
        f.write("{not json\n")
    assert sorted(r["tag_id"] for r in TB.read_positions(spark, path).collect()) == [1, 2]


def test_geometry_files_do_not_grow_with_the_jobs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "scratch", lambda _: str(tmp_path / "t"))
    rows = load()[0]["positions_files"](spark, "/root/testdata/sf0.001")
    jobs = {r["job_id"] for r in rows.collect()}
    files = sorted((tmp_path / "t").rglob("*.json"))
    assert len(jobs) > 40 and len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a broken line costs its own document only
    lines = files[0].read_text().splitlines()
    lost = json.loads(lines[0])["job_id"]
    files[0].with_name(f".{files[0].name}.crc").unlink()
    files[0].write_text("\n".join([lines[0][:-9], *lines[1:]]) + "\n")
    left = TB.read_positions(spark, str(tmp_path / "t")).collect()
    assert {r["job_id"] for r in left} == jobs - {lost} and all(r["page_url"] is not None for r in left)


def test_gaps_of_jobs(spark):
    base = dt.datetime(2024, 1, 1)
    at = lambda s: base + dt.timedelta(seconds=s)
    rows = [("a", "view", at(0)), ("a", "view", at(89)), ("b", "view", at(0)), ("b", "view", at(95)), ("c", "page_capture", at(0)), ("c", "view", at(120))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "job_id string, step string, updated_at timestamp, seq int")
    gaps = {(r["job_id"], r["stalled"]) for r in Q.progress_gaps(df).collect()}
    assert gaps == {("a", False), ("b", True), ("c", False)}


def test_gaps_cross_slices_of_a_long_job(spark):
    """A job with most rows is ordered slice by slice, and no gap is lost at an edge; a null job is a job."""
    base, rng = dt.datetime(2024, 1, 1), random.Random(2)
    rows, want = [], set()
    for job, n in (("big", 3000), (None, 40), ("one", 1)):
        times = sorted(rng.sample(range(400_000), n))
        steps = [rng.choice(["view", "page_capture"]) for _ in times]
        rows += [(job, s, base + dt.timedelta(seconds=t), k) for k, (t, s) in enumerate(zip(times, steps))]
        for k in range(1, n):
            limit = 180 if steps[k - 1] == "page_capture" else 90
            want.add((job, k, times[k] - times[k - 1], limit, times[k] - times[k - 1] >= limit))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, step string, updated_at timestamp, seq int")
    got = Q.progress_gaps(df)
    assert {(r["job_id"], r["seq"], r["idle_seconds"], r["limit_seconds"], r["stalled"]) for r in got.collect()} == want
    assert got.count() == len(want)


def test_large_sites_and_projects_stay_whole(spark):
    site = "https://a.com"
    body = lambda locs: "<sitemapindex>" + "".join(f"<loc>{site}/m{i}.xml</loc>" for i in locs) + "</sitemapindex>"
    docs = [("a.com", f"{site}/sitemap.xml", body(range(40)))] + [("a.com", f"{site}/m{i}.xml", f"<urlset><loc>{site}/p{i}</loc></urlset>") for i in range(40)]
    locs = S.sitemap_locs(spark.createDataFrame(docs, "site string, doc_url string, body string"))
    robots = spark.createDataFrame([], "site string, pos int, sitemap_url string")
    rows = S.expand_sitemaps(locs, robots, spark.createDataFrame([("a.com", site)], "site string, origin string")).collect()
    assert sum(r["pages"] for r in rows) == 40
    job = F.struct(F.lit("j").alias("job_id"), F.lit("done").alias("status"), F.lit("pc").alias("viewport"), F.lit("u").alias("capture_url"))
    one = spark.range(1).select(F.lit(1).alias("project_id"), F.lit(1).alias("step"), F.lit("c").alias("cover_url"),
                                F.array().cast("array<struct<url:string,viewports:array<string>>>").alias("urls"), F.array_repeat(job, 1200).alias("jobs"))
    done = Q.project_rollup(one).first()
    assert (done["page_count"], done["analyzed_count"]) == (1200, 1200)
