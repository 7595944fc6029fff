"""Keyed tables: upserts, selections, registries, cache lookups and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webplan.functions import text as T
from webplan.functions import urls as U

ANALYSIS_KEY = ["project_id", "url_norm", "viewport"]
GEOMETRY_SCHEMA = (
    "job_id string, viewport string, page_url string, positions array<struct<tag_id:int,selector_hint:string,"
    "bbox:struct<x:int,y:int,w:int,h:int>,platform:string,hidden_reason:string,text:string>>"
)


def upsert_page_analyses(base: DataFrame, updates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Newest payload per key; a null selection keeps the one stored before.

    Both sides have keys, payload, page_name, selection, updated_at, seq.  One aggregate with
    map-side combine, so repeated updates of one key never meet in a sort."""
    keys = keys or ANALYSIS_KEY
    order = F.struct("_new", "updated_at", "seq")
    rows = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct("payload", "page_name"), order).alias("v"),
        F.max_by("selection", F.when(F.col("selection").isNotNull(), order)).alias("selection"),
        F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("versions"),
    ).select(*keys, "v.*", "selection", "updated_at", "versions")


def patch_selection_map(base: DataFrame, patches: DataFrame) -> DataFrame:
    """base(page_key, selection map), patches(page_key, selection map, seq): right side wins per key.

    Entries are merged as rows, so a page with many patches is combined before any map is built."""
    rows = base.select("page_key", F.lit(-1).cast("long").alias("seq"), F.explode_outer("selection").alias("k", "v")).unionByName(
        patches.select("page_key", F.col("seq").cast("long").alias("seq"), F.explode("selection").alias("k", "v"))
    )
    last = rows.groupBy("page_key", "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("page_key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("selection")
    )


def merge_selection(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds a true entry for every candidate without one; never overrides."""
    keys = ["page_key", "tag_id"]
    fresh = candidates.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    return existing.select(*keys, "selected").unionByName(fresh.withColumn("selected", F.lit(True)))


def registry_with_defaults(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    s = stored.select("name", F.col("meaning").alias("_s"))
    return defaults.join(s, "name", "full_outer").select("name", F.coalesce("_s", "meaning").alias("meaning"))


def explode_description_json(docs: DataFrame) -> DataFrame:
    """{"events": {key: {...}}, "properties": {name: {...}}} → (…, kind, key, trigger, description, note)."""
    schema = "events map<string,struct<trigger:string,description:string,note:string>>, properties map<string,struct<description:string,note:string>>"
    keep = [c for c in docs.columns if c != "body"]
    doc = docs.select(*keep, F.from_json("body", schema).alias("d"))
    events = doc.select(*keep, F.lit("event").alias("kind"), F.explode("d.events").alias("key", "v")).select(
        *keep, "kind", "key", "v.trigger", "v.description", "v.note")
    props = doc.select(*keep, F.lit("property").alias("kind"), F.explode("d.properties").alias("key", "v")).select(
        *keep, "kind", "key", F.lit(None).cast("string").alias("trigger"), "v.description", "v.note")
    return events.unionByName(props)


def cache_split(requests: DataFrame, analyses: DataFrame, forced: DataFrame) -> DataFrame:
    """requests(url_norm, viewport, alias) with ``cached`` and the page name to show.

    Forced requests (by address, or address and viewport) never hit."""
    by_view = forced.filter("viewport is not null").select("url_norm", "viewport", F.lit(True).alias("_f1")).distinct()
    by_url = forced.filter("viewport is null").select("url_norm", F.lit(True).alias("_f2")).distinct()
    known = analyses.select("url_norm", "viewport", F.col("page_name").alias("_name"), F.lit(True).alias("_hit"))
    rows = (
        requests.join(by_view, ["url_norm", "viewport"], "left").join(by_url, "url_norm", "left")
        .join(known, ["url_norm", "viewport"], "left")
    )
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("_f1", "_f2", F.lit(False))
    return rows.withColumn("cached", hit).withColumn(
        "page_name", F.when(hit, F.coalesce(T.blank_null(F.col("alias")), F.col("_name")))
    ).drop("_f1", "_f2", "_hit", "_name")


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > now).join(users, "user_id")


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Newest row per key as an aggregate; ``order`` must identify one row."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*")


def merge_discovered(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Per address, non-null new fields replace old ones."""
    rows = old.select("url", *fields, F.lit(0).cast("long").alias("o")).unionByName(
        new.select("url", *fields, (F.col("seq") + 1).cast("long").alias("o")))
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("o"))).alias(f)
    return rows.groupBy("url").agg(*[last(f) for f in fields])


def text_search(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows in which the lower-cased needle occurs in any of the columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    return rows.filter(hay.contains(needle.strip().lower()))


def user_sort(rows: DataFrame, column: str, ascending: bool, *ties: str) -> DataFrame:
    key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return rows.orderBy(key.asc() if ascending else key.desc(), *ties)


def recent_projects(projects: DataFrame, user: str) -> DataFrame:
    return projects.filter(F.col("user_id") == user).orderBy(F.desc("updated_at"), "project_id")


# ------------------------------------------------------------------ files


def write_positions(positions: DataFrame, path: str, job_folders: bool = True) -> None:
    """One geometry document per (job, viewport), positions sorted by tag.

    With ``job_folders`` every job has a folder of its own, for few jobs that are read singly.  Without, documents share
    the files of their task, one a line, so that the number of files does not grow with the jobs."""
    item = F.struct("tag_id", "selector_hint", "bbox", "platform", "hidden_reason", "text")
    docs = positions.filter("tag_id > 0").groupBy("job_id", "viewport", "page_url").agg(
        F.array_sort(F.collect_list(item)).alias("positions"))
    if not job_folders:
        return docs.write.mode("overwrite").json(path)
    # the key stays inside the document too, so a single file can be read on its own
    docs.withColumn("job", F.col("job_id")).write.mode("overwrite").partitionBy("job").json(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions as rows, with or without folders per job; documents that cannot be read count as absent."""
    docs = spark.read.schema(GEOMETRY_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return docs.filter("_corrupt_record is null and job_id is not null").select(
        "job_id", "viewport", "page_url", F.explode("positions").alias("p")).select("job_id", "viewport", "page_url", "p.*")


def append_snapshot(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("site_key").parquet(path)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per site with its file name."""
    out = latest_per_key(snapshots, ["site_key"], F.col("saved_at"), F.col("seq"))
    return out.withColumn("file_name", T.snapshot_name(F.col("site_key"), F.col("saved_at")))


def write_event_sheets(sheets: DataFrame, path: str) -> None:
    sheets.write.mode("overwrite").partitionBy("site", "sheet").option("header", True).csv(path)


def assemble_spec(screens: DataFrame, events: DataFrame) -> DataFrame:
    """Nested specification document per session: screens, each with its events in key order."""
    ev = events.groupBy("session_id", "screen_id").agg(
        F.array_sort(F.collect_list(F.struct("stable_key", "event_id", "event_name"))).alias("events"))
    rows = screens.join(ev, ["session_id", "screen_id"], "left")
    screen = F.struct("screen_id", "screen_name", "page_url_pattern", "detected_by",
                      F.coalesce("events", F.array().cast("array<struct<stable_key:string,event_id:string,event_name:string>>")).alias("events"))
    per = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(screen)).alias("screens"))
    return per.select(
        "session_id",
        F.to_json(F.struct(F.lit("1.0").alias("spec_version"), "session_id", F.lit("unified-v1").alias("naming_convention"),
                           F.array(F.lit("ga4")).alias("platform_targets_recommended"), "screens")).alias("spec"),
    )


def url_norm(url: str = "url") -> Column:
    return U.normalize_page_url(F.col(url))
