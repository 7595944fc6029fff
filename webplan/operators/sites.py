"""Rules of single sites, as a table joined on the registrable domain.

rules(root, kind, name, pattern, seq): ``root`` null means every site.  Kinds: ``mobile_class`` and ``desktop_class`` are
class patterns that tell a viewport, ``panel_class`` marks navigation panels, ``exclude_trigger`` names menu controls to
leave alone (pattern on their key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webplan.functions import urls as U

RULES = "root string, kind string, name string, pattern string, seq int"
KINDS = ["mobile_class", "desktop_class", "panel_class", "exclude_trigger"]
#: Copies of a site's rules, so that its pages meet them in as many tasks.
SALTS = 16
# Class rules known before any site was set up.
DEFAULT_RULES = [(None, "mobile_class", "kanu-mobile", "(?i)kanu-mobile", 0)]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULES)


def with_site_rules(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``site_rules``: map from kind to the rules of the row's site, those of every site first.

    The rules are a setup table of a few rows per site; rows are joined to one row per site, which is repeated per salt so
    that the pages of a hot site spread over tasks.  The rules of every site are one value, read once without a join."""
    item = F.struct("seq", "name", "pattern")
    own = rules.filter("root is not null").groupBy("root", "kind").agg(F.array_sort(F.collect_list(item)).alias("r"))
    own = own.groupBy(F.col("root").alias("_root")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "r"))).alias("_own"))
    common = rules.filter("root is null").groupBy("kind").agg(F.array_sort(F.collect_list(item)).alias("r"))
    common = common.agg(F.map_from_entries(F.collect_list(F.struct("kind", "r"))).alias("_all"))
    none = F.array().cast("array<struct<seq:int,name:string,pattern:string>>")
    of = lambda column, kind: F.coalesce(F.try_element_at(column, F.lit(kind)), none)
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_root", U.site_of(F.col(url))).withColumn("_salt", F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int"))
    joined = salted.join(own, ["_root", "_salt"], "left").withColumn("_all", common.scalar())
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(of(F.col("_all"), k), of(F.col("_own"), k)).alias("v")) for k in KINDS])
    return joined.withColumn("site_rules", F.map_from_entries(entries)).select(*rows.columns, "site_rules")


def rule_hits(rules: Column, kind: str, text: Column) -> Column:
    """Names of the rules of a kind whose pattern the text holds, in order."""
    hits = F.filter(rules[kind], lambda r: F.rlike(text, r["pattern"]))
    return F.transform(hits, lambda r: r["name"])
