"""robots.txt, sitemap and link-payload documents as tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import urls as U
from webplan.session import checkpoint_ready

# Paths tried on every site after the robots entries.
WELL_KNOWN_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]


def robots_sitemaps(docs: DataFrame) -> DataFrame:
    """(…, pos, sitemap_url) for every ``Sitemap:`` line of ``body``."""
    keep = [c for c in docs.columns if c != "body"]
    lines = docs.select(*keep, F.posexplode(F.split("body", "\r?\n")).alias("pos", "line"))
    url = F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1)
    return lines.select(*keep, "pos", url.alias("sitemap_url")).filter(F.col("sitemap_url") != "")


def _xml_text(c: Column) -> Column:
    out = F.trim(F.regexp_replace(c, r"<!\[CDATA\[|\]\]>", ""))
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def sitemap_locs(docs: DataFrame) -> DataFrame:
    """(…, is_index, pos, loc): every non-empty <loc>, decoded."""
    keep = [c for c in docs.columns if c != "body"]
    bodies = F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    return (
        docs.select(
            *keep, F.col("body").rlike(r"(?i)<sitemapindex[\s>]").alias("is_index"),
            F.posexplode(bodies).alias("pos", "raw"),
        )
        .select(*keep, "is_index", "pos", _xml_text(F.col("raw")).alias("loc"))
        .filter(F.col("loc") != "")
    )


def same_root_docs(docs: DataFrame, url: str, root: str) -> DataFrame:
    """Only http(s) documents of the site itself; the address comes back normalised."""
    full = lambda u: F.when(
        u["is_http"] & (U.root_domain(u["host"]) == F.col(root)),
        F.concat(u["origin"], u["path"], u["query"], u["fragment"]),
    )
    return docs.withColumn(url, U.with_url(F.col(url), full)).filter(F.col(url).isNotNull())


def expand_sitemaps(locs: DataFrame, robots: DataFrame, seeds: DataFrame, limit: int | None = None,
                    max_docs: int | None = None) -> DataFrame:
    """Breadth-first walk over sitemap documents that are already in the corpus.

    locs(site, doc_url, is_index, pos, loc), robots(site, pos, sitemap_url), seeds(site, origin)
    → (site, ord, doc_url, is_index, pages): documents visited, in visiting order.
    A caller may stop a site after ``max_docs`` documents, or once ``limit`` * 20 pages were listed by
    the documents before; otherwise everything reachable is visited.
    """
    spark = locs.sparkSession
    checkpoint_ready(spark)
    seeds = seeds.select("site", "origin")
    known = seeds.select(
        "site",
        F.posexplode(F.array(*[F.concat("origin", F.lit(p)) for p in WELL_KNOWN_PATHS])).alias("pos", "doc_url"),
    ).select("site", F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b")).alias("at"), "doc_url")
    listed = robots.select(
        "site", F.struct(F.lit(0).alias("a"), F.col("pos").cast("long").alias("b")).alias("at"),
        F.col("sitemap_url").alias("doc_url"),
    )
    first = _take_new(same_root_docs(listed.unionByName(known), "doc_url", "site"), None, max_docs)
    # a level is written once; what was visited before is read, not written anew
    level = first.select("site", "doc_url", F.row_number().over(_by("at")).alias("ord")).checkpoint()
    queue, index_locs = level, locs.filter("is_index").select("site", "doc_url", "pos", "loc")
    while not level.isEmpty():
        size = queue.groupBy("site").agg(F.max("ord").alias("_n"))
        found = level.join(index_locs, ["site", "doc_url"]).select(
            "site", F.struct(F.col("ord").alias("a"), F.col("pos").cast("long").alias("b")).alias("at"),
            F.col("loc").alias("doc_url"),
        )
        fresh = _take_new(same_root_docs(found, "doc_url", "site"), queue, max_docs)
        level = (
            fresh.join(size, "site")
            .select("site", "doc_url", (F.col("_n") + F.row_number().over(_by("at"))).alias("ord"))
            .filter(F.lit(True) if max_docs is None else F.col("ord") <= max_docs)
            .checkpoint()
        )
        queue = queue.unionByName(level)
    stats = locs.groupBy("site", "doc_url").agg(
        F.max("is_index").alias("is_index"),
        F.sum(F.when(F.col("is_index"), 0).otherwise(1)).alias("pages"),
    )
    before = F.coalesce(
        F.sum("pages").over(W.partitionBy("site").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    rows = queue.join(stats, ["site", "doc_url"], "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
    if limit is not None:
        rows = rows.withColumn("_before", before).filter(F.col("_before") < limit * 20)
    if max_docs is not None:
        rows = rows.filter(F.col("ord") <= max_docs)
    return rows.select("site", "ord", "doc_url", "is_index", "pages")


def _by(order: str):
    return W.partitionBy("site").orderBy(order)


def _take_new(rows: DataFrame, visited: DataFrame | None, n: int | None) -> DataFrame:
    """First sighting of each address not queued yet; at most ``n`` per site if asked."""
    once = rows.groupBy("site", "doc_url").agg(F.min("at").alias("at"))
    if visited is not None:
        once = once.join(visited.select("site", "doc_url"), ["site", "doc_url"], "left_anti")
    if n is None:
        return once.select("site", "doc_url", "at")
    salted = once.withColumn("_s", F.pmod(F.xxhash64("doc_url"), F.lit(64)))
    part = W.partitionBy("site", "_s").orderBy("at")
    return (
        salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
        .withColumn("_q", F.row_number().over(_by("at"))).filter(F.col("_q") <= n)
        .select("site", "doc_url", "at")
    )


def parse_link_payloads(payloads: DataFrame) -> DataFrame:
    """JSON bodies with ``links`` or ``data.links`` (strings or objects) → (…, pos, url, title, description)."""
    keep = [c for c in payloads.columns if c != "body"]
    raw = F.try_parse_json("body")
    top = F.try_variant_get(raw, "$.links", "array<variant>")
    inner = F.try_variant_get(raw, "$.data.links", "array<variant>")
    has_top = F.try_variant_get(raw, "$.links", "variant")
    items = F.when(has_top.isNotNull() & ~F.is_variant_null(has_top), top).otherwise(inner)
    rows = payloads.select(*keep, F.posexplode(items).alias("pos", "item"))
    kind = F.schema_of_variant("item")
    text = lambda path: F.trim(
        F.when(F.schema_of_variant(F.try_variant_get("item", path, "variant")) == "STRING",
               F.try_variant_get("item", path, "string"))
    )
    url = F.when(kind == "STRING", F.trim(F.try_variant_get("item", "$", "string"))).otherwise(text("$.url"))
    blank = lambda c: F.when(c != "", c)
    is_obj = kind.startswith("OBJECT")
    return rows.select(
        *keep, "pos", url.alias("url"),
        F.when(is_obj, blank(text("$.title"))).alias("title"),
        F.when(is_obj, blank(text("$.description"))).alias("description"),
    ).filter(F.coalesce(F.col("url"), F.lit("")) != "")
