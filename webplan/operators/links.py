"""Link inventories: filtering, deduplication, ranking and discovery steps.

A single site may own a third of all links, so nothing here gathers a site in one
task: duplicates collapse in partially aggregated ``groupBy`` steps and top-n runs
in two stages (per salt, then per site).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import urls as U

SALTS = 64

# Result sizes asked for one after the other during discovery.
STEP_CAPS = [20, 40, 80, 150, 300, 500, 1000, 2000, 5000]


def clamp_limit(n: Column, default: int, most: int = 5000) -> Column:
    """A wished number of links, from 1 to ``most``; ``default`` where none is given."""
    v = F.floor(n)
    chosen = F.when(n.isNull() | F.isnan(n.cast("double")) | (n == 0), F.lit(default)).otherwise(v)
    return F.greatest(F.lit(1), F.least(F.lit(most), chosen)).cast("int")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  Stage one keeps n rows per (key, salt), so a hot key is cut in
    parallel and stage two sees at most n * SALTS rows of it."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    last = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt")
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= n)
    )


def dedupe_links(links: DataFrame) -> DataFrame:
    """One row per (site, canonical address): the earliest by ``seq``.  Copies of one address
    collapse on the map side."""
    key = F.coalesce(U.canonical_link(F.col("url")), F.trim("url"))
    rest = [c for c in links.columns if c not in ("site", "url")]
    return (
        links.withColumn("url", key)
        .filter(F.col("url") != "")
        .groupBy("site", "url")
        .agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_first"))
        .select("site", "url", *[F.col("_first")[c].alias(c) for c in rest])
    )


def seeds_of(links: DataFrame) -> DataFrame:
    """site, seed_url, seed_host for the apex address of every site present."""
    seed = F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    return links.select("site").distinct().select("site", seed.alias("seed_url"), F.col("site").alias("seed_host"))


def with_seed(links: DataFrame, seeds: DataFrame | None) -> DataFrame:
    """Links with the seed_url and seed_host of their site; without ``seeds`` these are the apex address of the site.

    A given table of seeds is repeated per salt, so that the links of a hot site meet it in many tasks."""
    if seeds is None:
        return links.withColumns({"seed_url": F.concat(F.lit("https://"), F.col("site"), F.lit("/")), "seed_host": F.col("site")})
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = seeds.select("site", "seed_url", "seed_host", salts.alias("_salt"))
    rows = links.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return rows.join(spread, ["site", "_salt"]).drop("_salt")


def rank_links(links: DataFrame, seeds: DataFrame | None, limit: int) -> DataFrame:
    """Seed first, then the seed's host, then shallow paths, then by address; first ``limit`` per site."""
    canon = F.coalesce(U.canonical_link(F.col("seed_url")), F.col("seed_url"))
    known = with_seed(links, seeds).select(*links.columns, "seed_url", canon.alias("_canon"))
    keyed = known.withColumn("_host", U.strip_www(U.url_host(F.col("_canon")))).select(
        *links.columns,
        F.when(F.col("url").isin(F.col("_canon"), F.col("seed_url")), 0).otherwise(1).alias("_seed"),
        F.when((F.col("_host") != "") & (U.strip_www(U.url_host(F.col("url"))) == F.col("_host")), 0)
        .otherwise(1).alias("_away"),
        U.path_depth(F.col("url")).alias("depth"),
    )
    order = [F.col("_seed"), F.col("_away"), F.col("depth"), F.col("url")]
    return top_n(keyed, ["site"], order, limit, F.col("url")).drop("_seed", "_away")


def filter_links(links: DataFrame, seeds: DataFrame | None, subdomains: bool = False) -> DataFrame:
    """Adds ``kept_url`` (null when filtered out) following keep-or-rewrite."""
    canon = U.canonical_link(F.col("url"))
    root = U.root_domain(F.col("seed_host"))
    kept = (
        U.let(canon, lambda c: F.when(U.keep_url(c, root), c))
        if subdomains
        else U.keep_or_rewrite(F.col("url"), root, F.col("seed_host"))
    )
    return with_seed(links, seeds).withColumn("kept_url", kept).drop("seed_url", "seed_host")


def discover_union(seeds: DataFrame, sitemap: DataFrame, mapped: DataFrame, limit: int,
                   sitemap_only: bool = False) -> DataFrame:
    """Seed, sitemap and map links as one ranked list per site.  Map links are not used for a
    site whose sitemap alone fills the limit (or, with ``sitemap_only``, whose sitemap has any link)."""
    enough = F.count(F.lit(1)) >= (F.lit(1) if sitemap_only else F.lit(limit))
    filled = sitemap.groupBy("site").agg(enough.alias("ok")).filter("ok").select("site")
    start = seeds.select("site", F.col("seed_url").alias("url"), F.lit("seed").alias("source"), F.lit(0).alias("seq"))
    # one row per full site and salt, so that the links of a hot site spread over tasks
    filled = filled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rest = mapped.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(filled, ["site", "_salt"], "left_anti")
    cols = ["site", "url", "source", "seq"]
    every = start.select(*cols).unionByName(sitemap.select(*cols)).unionByName(rest.select(*cols))
    return rank_links(dedupe_links(every), seeds, limit)


def step_caps(limit: int) -> list[int]:
    return [c for c in STEP_CAPS if c < limit] + [limit]


def discovery_steps(available: DataFrame, limit: int) -> DataFrame:
    """Growing result sizes per site.  ``available`` has (site, n).  A step runs only when every
    earlier one came back full; ``added`` is what the step contributed."""
    caps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("cap")) for i, c in enumerate(step_caps(limit))])
    w = W.partitionBy("site").orderBy("step")
    rows = available.select("site", "n", F.explode(caps).alias("s")).select("site", "n", "s.step", "s.cap")
    return (
        rows.withColumn("total", F.least("n", "cap"))
        .withColumn("_prev", F.lag("total", 1, 0).over(w))
        .withColumn("_prev_cap", F.lag("cap", 1, 0).over(w))
        .filter(F.col("_prev") >= F.col("_prev_cap"))
        .select("site", "step", "cap", "total", (F.col("total") - F.col("_prev")).alias("added"))
    )


def best_family_match(entries: DataFrame) -> DataFrame:
    """Per registrable domain the host with most entries (first seen on a tie)."""
    per_host = entries.groupBy(U.root_domain(F.col("host")).alias("site"), "host").agg(
        F.count(F.lit(1)).alias("entries"), F.min("seq").alias("first_seq")
    )
    return per_host.groupBy("site").agg(
        F.max_by("host", F.struct(F.col("entries"), -F.col("first_seq"))).alias("best_host"),
        F.sum("entries").alias("entries"),
        F.count(F.lit(1)).alias("hosts"),
    )
