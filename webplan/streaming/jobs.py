"""Structured Streaming jobs over job progress, tag events and selections; those with state of their own are in ``state``.

A streaming job takes a streaming DataFrame and returns one; the caller chooses sink and trigger.  Event time is the
update time of a row: rows older than the watermark are dropped, otherwise the latest event time wins.

Keyed state is kept per key and slice of event time (``latest_rows``), so the watermark can let old slices go; a key
that is updated later opens a new slice.  ``fold_slices`` is the batch view over what the sink holds: the newest row per
key, however many batches and slices it was spread over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import text as T

# ------------------------------------------------------------------ latest row per key


def latest_rows(rows: DataFrame, keys: list[str], fields: list[str], ts: str = "ts", seq: str = "seq",
                delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Newest row per key and slice of event time (update mode): keys, slice, row, at, updates.

    State is one row per key and slice, dropped once the watermark has passed the slice."""
    at = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    return rows.withWatermark(ts, delay).groupBy(*keys, F.window(ts, span).alias("slice")).agg(
        F.max_by(F.struct(*fields), at).alias("row"), F.max(at).alias("at"), F.count(F.lit(1)).alias("updates")
    )


def fold_slices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Emitted slices, each perhaps several times -> newest row per key: keys, fields, ts, updates."""
    once = rows.groupBy(*keys, "slice").agg(
        F.max_by("row", "at").alias("row"), F.max("at").alias("at"), F.max("updates").alias("updates"))
    return once.groupBy(*keys).agg(
        F.max_by("row", "at").alias("row"), F.max("at").alias("at"), F.sum("updates").alias("updates")
    ).select(*keys, "row.*", F.col("at.ts").alias("ts"), "updates")


# ------------------------------------------------------------------ job progress


def job_latest(progress: DataFrame, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Newest state and percentage per job and slice (update mode); see ``fold_jobs``."""
    pct = G.stage_percent(F.col("stage"), F.col("current"), F.col("total"))
    at = F.struct("updated_at", "current")
    alive = F.when(F.col("stage") != "failed", at)
    return progress.withWatermark("updated_at", delay).groupBy("job_id", F.window("updated_at", span).alias("slice")).agg(
        F.max_by(F.struct("stage", "status", "current", "total"), at).alias("s"), F.max(at).alias("at"),
        F.max_by(pct, alive).alias("percent"), F.max(alive).alias("percent_at"), F.count(F.lit(1)).alias("updates"))


def fold_jobs(rows: DataFrame) -> DataFrame:
    """Emitted job slices -> newest state per job; a failed job keeps the percentage it had."""
    once = rows.groupBy("job_id", "slice").agg(
        F.max_by("s", "at").alias("s"), F.max("at").alias("at"), F.max_by("percent", "percent_at").alias("percent"),
        F.max("percent_at").alias("percent_at"), F.max("updates").alias("updates"))
    return once.groupBy("job_id").agg(
        F.max_by("s", "at").alias("s"), F.max("at").alias("at"), F.max_by("percent", "percent_at").alias("percent"),
        F.sum("updates").alias("updates"),
    ).select("job_id", "s.*", F.col("at.updated_at").alias("updated_at"), F.coalesce("percent", F.lit(0)).alias("percent"), "updates")


# ------------------------------------------------------------------ tag events


def tag_event_name():
    """Name of an event that carries none: clicks are called click, others by their type."""
    return F.coalesce(T.blank_null(F.col("event_name")), F.col("event_type"))


def fold_tag_events(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One micro-batch of tag events against the stored table.

    Returns the new store (key: session, screen, stable_key; the newest row overwrites) and the
    counts: a key seen for the first time is upserted, a repeat is skipped though it overwrites."""
    keys = ["session_id", "screen_id", "stable_key"]
    rows = batch.withColumn("event_name", tag_event_name())
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct("event_name", "event_type", "seq"), "seq").alias("v"), F.count(F.lit(1)).alias("n"))
    known = store.select(*keys).withColumn("_old", F.lit(True))
    joined = newest.join(known, keys, "left")
    fresh = F.col("_old").isNull()
    counts = joined.groupBy("session_id").agg(
        F.sum("n").alias("accepted"), F.sum(F.when(fresh, 1).otherwise(0)).alias("upserted"),
        F.sum(F.when(fresh, F.col("n") - 1).otherwise(F.col("n"))).alias("skipped"),
    )
    keep = store.join(newest.select(*keys), keys, "left_anti")
    return keep.unionByName(newest.select(*keys, "v.*")), counts


def tag_event_state(events: DataFrame, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """The same keyed state as a stream of slices (update mode); ``fold_slices`` gives the newest row per key, whose
    ``updates`` are the accepted events: one upserted, the others skipped though they overwrite."""
    named = events.withColumn("event_name", tag_event_name())
    return latest_rows(named, ["session_id", "screen_id", "stable_key"], ["event_name", "event_type"], delay=delay, span=span)


PATCHABLE = ["event_name", "qa_status", "source", "notes"]


def patch_tag_events(patches: DataFrame, store: DataFrame) -> DataFrame:
    """Patches for known events only (stream-static join); null fields leave the stored value."""
    known = store.select("event_id", *[F.col(f).alias(f"_{f}") for f in PATCHABLE])
    return patches.join(known, "event_id").select("event_id", *[F.coalesce(f, f"_{f}").alias(f) for f in PATCHABLE])


def selection_state(patches: DataFrame, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """Latest boolean per page and element as slices (update mode); anything else is ignored."""
    return latest_rows(patches.filter(F.col("selected").isNotNull()), ["page_key", "tag_id"], ["selected"], delay=delay, span=span)
