"""Checks, failure classes, hint merging and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import geometry as G
from webplan.functions import text as T
from webplan.functions import urls as U

# Address and message wording behind redirect and failure classes.
AUTH_SIGNAL = (
    r"(?i)(?:^|[./?&=_-])(login|log-in|signin|sign-in|auth|authenticate|sso|oauth|account/login|member/login)(?:$|[./?&=_-])"
)
MEMBER_SIGNAL = r"(?i)(?:^|/)(myshop|mypage|my-page|cart|order|wishlist|wish|member)(?:/|$)"
SESSION_DEAD = (
    "deno repl|repl exited|repl not ready|failed to execute code in browser session|browser session|has been closed"
    "|target page|concurrencylimited|concurrent"
)
TRANSIENT = (
    r"has been closed|target page|execution timed out|timeout|timed out|concurrent|page\.content\(\)|browser session"
    "|net::|socket hang up|econnreset|navigate|deno repl|repl not ready|repl exited|failed to execute code in browser session"
)
# Precedence of hint sources.
HINT_RANK = {"stagehand": 3, "scrapegraph": 2, "skyvern": 1}


def redirect_check(expected: Column, current: Column) -> Column:
    """null when the landing address is fine, else auth_redirect, member_redirect or external_redirect."""

    def judge(v):
        e, c = v["e"], v["c"]
        path = lambda u: F.lower(F.coalesce(T.blank_null(F.regexp_replace(u["path"], r"/+$", "")), F.lit("/")))
        same = U.strip_www(e["host"]) == U.strip_www(c["host"])
        moved = path(e) != path(c)
        auth = F.concat(c["host"], c["path"], c["query"]).rlike(AUTH_SIGNAL)
        left = e["path"].rlike(MEMBER_SIGNAL) & ~path(c).startswith(F.concat(path(e), F.lit("/"))) & ~c["path"].rlike(MEMBER_SIGNAL)
        return F.when(e["is_http"] & c["is_http"], (
            F.when(same & moved & auth, F.lit("auth_redirect"))
            .when(same & moved & left, F.lit("member_redirect"))
            .when(~same & auth, F.lit("auth_redirect"))
            .when(~same, F.lit("external_redirect"))
        ))

    return U.let(F.struct(U.parse(expected).alias("e"), U.parse(current).alias("c")), judge)


def is_member_area(url: Column) -> Column:
    return U.with_url(url, lambda u: F.when(u["is_http"], u["path"]).otherwise(u["raw"]).rlike(MEMBER_SIGNAL))


def failure_kind(message: Column, url: Column) -> Column:
    m = T.nz(message)
    low = F.lower(m)
    member = F.coalesce(is_member_area(url), F.lit(False))
    dead = low.rlike(SESSION_DEAD)
    late = low.rlike("timeout|timed out")
    return (
        F.when(m.rlike(r"^LOGIN_REQUIRED\|[^|]*\|") | low.rlike("로그인 필요|login_required"), F.lit("login_required"))
        .when(member & dead, F.lit("login_required"))
        .when(dead & ~low.contains("concurrent"), F.lit("session_dead"))
        .when(late & member, F.lit("login_required")).when(late, F.lit("timeout"))
        .when(low.contains("cancelled") | (m == "중단됨"), F.lit("cancelled"))
        .when(low.contains("concurrent"), F.lit("session_dead"))
        .otherwise(F.lit("other"))
    )


def failure_reason(message: Column) -> Column:
    low = F.lower(T.nz(message))
    return (
        F.when(low.rlike("openrouter|llm|extract"), F.lit("extract_error"))
        .when(low.rlike("firecrawl|scrape"), F.lit("firecrawl_error"))
        .when(low.contains("timeout"), F.lit("timeout")).when(low.contains("budget"), F.lit("budget_exceeded"))
        .otherwise(F.lit("unknown"))
    )


def is_transient(message: Column) -> Column:
    return F.lower(T.nz(message)).rlike(TRANSIENT)


# ------------------------------------------------------------------ statistics


def platform_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    p = F.coalesce("platform", F.lit("All"))
    return rows.groupBy(*keys).agg(
        F.count_if(p == "PC").alias("pc"), F.count_if(p == "MO").alias("mo"), F.count_if(p == "All").alias("all"),
        F.count(F.lit(1)).alias("total"),
    )


def visibility_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per hidden reason; ``balanced`` says visible + hidden = total."""
    out = rows.groupBy(*keys).agg(
        F.count_if(F.col("hidden_reason") == "visible").alias("visible"),
        *[F.count_if(F.col("hidden_reason") == r).alias(r) for r in (
            "display_none", "visibility_hidden", "opacity_zero", "zero_size", "offscreen", "collapsed_parent")],
        F.count(F.lit(1)).alias("total"),
    )
    hidden = F.col("display_none") + F.col("visibility_hidden") + F.col("opacity_zero") + F.col("zero_size") + F.col(
        "offscreen") + F.col("collapsed_parent")
    return out.withColumn("balanced", F.col("visible") + hidden == F.col("total"))


def stage_funnel(elements: DataFrame, suggestions: DataFrame, keys: list[str]) -> DataFrame:
    """raw → tagged → input → named → dropped per page, with drops by reason.

    elements(keys…, matched, tagged, used), suggestions(keys…, event_name, dropped_reason)."""
    a = elements.groupBy(*keys).agg(
        F.count_if("matched").alias("raw"), F.count_if("tagged").alias("tagged"), F.count_if("used").alias("input")
    )
    by_reason = suggestions.filter(F.col("dropped_reason").isNotNull()).groupBy(*keys, "dropped_reason").agg(
        F.count(F.lit(1)).alias("n"))
    drops = by_reason.groupBy(*keys).agg(
        F.sum("n").alias("dropped"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dropped_reason", "n")))).alias("dropped_by_reason"),
    )
    named = suggestions.groupBy(*keys).agg(F.count_if(T.nz(F.col("event_name")) != "").alias("named"))
    return a.join(named, keys, "left").join(drops, keys, "left").select(
        *keys, "raw", "tagged", "input", F.coalesce("named", F.lit(0)).alias("named"), F.coalesce("dropped", F.lit(0)).alias("dropped"),
        "dropped_by_reason",
    )


def capture_qc(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One report per capture job with ordered errors and warnings; ok means no errors.

    jobs(job_id, png_bytes, page_width, page_height, modal_cleared, positions_saved),
    candidates(job_id, tag_id, bbox, element_capture_url, capture_found, no_capture)."""
    real = F.col("tag_id") > 0
    boxed = G.bbox_area(F.col("bbox")) > 0
    lost = real & F.col("element_capture_url").isNull() & ~boxed
    c = candidates.groupBy("job_id").agg(
        F.count_if(real).alias("candidate_count"), F.count_if(real & boxed).alias("with_overlay_bbox"),
        F.count_if(real & F.col("capture_found")).alias("capture_found_count"),
        F.count_if(real & F.col("no_capture")).alias("no_capture_count"), F.count_if(lost).alias("missing_count"),
    )
    # the sample in a warning is the first eight ids
    first = F.row_number().over(W.partitionBy("job_id").orderBy("tag_id"))
    sample = candidates.filter(lost).select("job_id", "tag_id", first.alias("_n")).filter(F.col("_n") <= 8).groupBy("job_id").agg(
        F.array_sort(F.collect_list("tag_id")).alias("missing_sample"))
    rows = jobs.join(c, "job_id", "left").join(sample, "job_id", "left").withColumn(
        "missing_sample", F.coalesce("missing_sample", F.array().cast("array<int>"))).fillna(0, [
        "candidate_count", "with_overlay_bbox", "capture_found_count", "no_capture_count", "missing_count", "png_bytes",
        "positions_saved",
    ])
    when, lit, cat = F.when, F.lit, F.concat
    n, ok = F.col("candidate_count"), F.col("capture_found_count")
    errors = F.array_compact(F.array(
        when(F.col("png_bytes") < 8000, cat(lit("png_too_small bytes="), "png_bytes")),
        when((F.col("page_width") <= 0) | (F.col("page_height") <= 0), cat(lit("invalid_page_size "), "page_width", lit("x"), "page_height")),
        when(~F.coalesce("modal_cleared", lit(True)), lit("modal_not_cleared")),
        when(F.col("positions_saved") <= 0, lit("positions_json_missing")),
        when((n > 0) & (ok == 0), lit("no_element_captures")),
    ))
    warnings = F.array_compact(F.array(
        when(F.col("missing_count") > 0, cat(lit("missing_capture count="), "missing_count", lit(" sample="), F.array_join("missing_sample", ","))),
        when((F.col("positions_saved") > 0) & (F.col("with_overlay_bbox") == 0),
             cat(lit("positions_saved="), "positions_saved", lit(" but no overlay_bbox on candidates"))),
        when((ok > 0) & (ok < n * 0.3), cat(lit("low_element_capture ok="), ok, lit(" total="), n)),
    ))
    return rows.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("ok", F.size("errors") == 0)


def position_report(issues: DataFrame, positions: DataFrame) -> DataFrame:
    """Per page: elements with an issue (one each, wrong overrides suspicious), count checked, ok.

    issues(page_id, tag_id, status, reason, seq)."""
    severity = F.when(F.col("status") == "wrong", 1).otherwise(0)
    # a later "wrong" replaces an earlier issue; otherwise the first one stays
    rank = F.struct(severity, F.when(F.col("status") == "wrong", F.col("seq")).otherwise(-F.col("seq")))
    worst = issues.groupBy("page_id", "tag_id").agg(F.max_by(F.struct("status", "reason"), rank).alias("i"))
    per_page = worst.groupBy("page_id").agg(
        F.count_if(F.col("i.status") == "wrong").alias("wrong"), F.count_if(F.col("i.status") != "wrong").alias("suspicious"))
    checked = positions.groupBy("page_id").agg(F.count(F.lit(1)).alias("checked_count"))
    return checked.join(per_page, "page_id", "left").fillna(0, ["wrong", "suspicious"]).withColumn(
        "ok", (F.col("wrong") + F.col("suspicious")) == 0
    )


# ------------------------------------------------------------------ folds over arrivals


def merge_hints(hints: DataFrame) -> DataFrame:
    """One hint per element from several sources, as if folded in arrival order.

    Higher confidence wins, then source rank (unknown sources rank last), and the earlier one on a full tie; the winner
    keeps its fields, gaps are filled from the loser, notes are joined winner first.
    hints(page_id, tag_id, source, event_name, confidence, note, seq), and parameters (an array) where these are at hand.

    In closed form: a hint leads when it beats all before it.  The last leader is the winner; a field is that of the last
    leader that has it, else of the first hint that has it; notes are those of leaders, newest first, then of the others
    as they came.  Only the notes of an element, which are its result, are ever held together."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HINT_RANK.items() for x in kv]), F.col("source")), F.lit(0))
    worth = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), rank.alias("r"))
    before = W.partitionBy("page_id", "tag_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = hints.withColumn("_w", worth).withColumn("_best", F.max("_w").over(before))
    rows = rows.withColumn("_leads", F.col("_best").isNull() | (F.col("_w") > F.col("_best")))

    def filled(name: str, blank: Column) -> Column:
        last = F.max_by(name, F.when(F.col("_leads") & ~blank, F.col("seq")))
        return F.coalesce(last, F.min_by(name, F.when(~blank, F.col("seq")))).alias(name)

    order = F.when(F.col("_leads"), -F.col("seq").cast("long")).otherwise(F.col("seq").cast("long"))
    note = F.struct((~F.col("_leads")).alias("late"), order.alias("at"), "note")
    notes = F.array_sort(F.collect_list(F.when(F.coalesce("note", F.lit("")) != "", note)))
    lead = lambda c: F.max_by(c, F.when(F.col("_leads"), F.col("seq"))).alias(c)
    more = [filled("parameters", F.coalesce(F.size("parameters"), F.lit(0)) <= 0)] if "parameters" in hints.columns else []
    out = rows.groupBy("page_id", "tag_id").agg(lead("source"), filled("event_name", F.col("event_name").isNull()), lead("confidence"), notes.alias("_notes"), *more)
    joined = F.array_join("_notes.note", " | ")
    return out.select("page_id", "tag_id", "source", "event_name", "confidence", F.when(joined != "", joined).alias("note"), *(["parameters"] if more else []))


def merge_snapshots(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Best measurement per element: visible, then larger area, then earlier."""
    rest = [c for c in entries.columns if c not in keys]
    area = F.coalesce(F.col("bbox.w") * F.col("bbox.h"), F.lit(0))
    return entries.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.coalesce("is_visible", F.lit(False)), area, -F.col("seq"))).alias("b")
    ).select(*keys, "b.*")


def finalize_suggestions(model: DataFrame, hints: DataFrame, allowed: DataFrame) -> DataFrame:
    """Model rows for allowed elements (last wins); named hints fill the elements left out."""
    keys = ["page_id", "tag_id"]
    fields = ["category", "action", "label", "merge_label", "event_name"]
    named = model.join(allowed.select(*keys), keys, "left_semi").groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.col("seq")).alias("v")).select(*keys, "v.*")
    spare = hints.filter(T.nz(F.col("event_name")) != "").join(allowed.select(*keys), keys, "left_semi").join(
        named.select(*keys), keys, "left_anti")
    name = F.col("event_name")
    filled = spare.select(
        *keys, F.lit("unknown").alias("category"), name.alias("action"), name.alias("label"), name.alias("merge_label"),
        T.derive_event_name(F.lit("unknown"), name).alias("event_name"),
    )
    return named.unionByName(filled)


# ------------------------------------------------------------------ boxes and progress


def union_bbox(members: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all valid member boxes; null when there is none."""
    b = members.filter(G.has_bbox(F.col("bbox")))
    out = b.groupBy(*keys).agg(
        F.min("bbox.x").alias("x"), F.min("bbox.y").alias("y"), F.max(F.col("bbox.x") + F.col("bbox.w")).alias("r"),
        F.max(F.col("bbox.y") + F.col("bbox.h")).alias("b"),
    ).select(*keys, G.box(F.col("x"), F.col("y"), F.col("r") - F.col("x"), F.col("b") - F.col("y")).alias("union_bbox"))
    return members.select(*keys).distinct().join(out, keys, "left")


def crop_source(members: DataFrame) -> DataFrame:
    """Per taxonomy row the capture (job, else address, and viewport) with most boxes; first seen on a tie.

    members(row_key, job_id, capture_url, viewport, bbox, seq)."""
    job = F.coalesce(T.blank_null(U.capture_job_id(F.col("capture_url"))), T.blank_null(F.col("job_id")))
    key = F.coalesce(job, F.col("capture_url"))
    g = members.withColumn("source", key).filter("source is not null").groupBy("row_key", "source", "viewport").agg(
        F.count_if(G.has_bbox(F.col("bbox"))).alias("boxes"), F.min("seq").alias("first"))
    return g.groupBy("row_key").agg(
        F.max_by(F.struct("source", "viewport", "boxes"), F.struct(F.col("boxes"), -F.col("first"))).alias("b")
    ).select("row_key", "b.*")


def member_bbox(members: DataFrame, pages: DataFrame, positions: DataFrame) -> DataFrame:
    """Box of a member: its own, else the one on the analysed page, else the stored positions."""
    valid = lambda c: F.when(G.has_bbox(c), c)
    p = pages.select("page_key", "viewport", "tag_id", F.col("bbox").alias("_p"), F.col("job_id").alias("_job"))
    f = positions.select(F.col("job_id").alias("_job"), "tag_id", F.col("bbox").alias("_f"))
    rows = members.join(p, ["page_key", "viewport", "tag_id"], "left").join(f, ["_job", "tag_id"], "left")
    box = F.coalesce(valid(F.col("bbox")), valid(F.col("_p")), valid(F.col("_f")))
    source = F.when(G.has_bbox(F.col("bbox")), F.lit("member")).when(G.has_bbox(F.col("_p")), F.lit("page")).when(
        G.has_bbox(F.col("_f")), F.lit("file"))
    return rows.withColumns({"bbox": box, "bbox_source": source}).drop("_p", "_f", "_job")


FINISHED = ["done", "failed", "login_required"]


def job_latest(progress: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """Newest state per job with its percentage; a failed job keeps the percentage it had.

    progress(job_id, stage, current, total, status, updated_at).  The percentage before a failure is
    the newest one of the rows that did not fail."""
    pct = G.stage_percent(F.col("stage"), F.col("current"), F.col("total"))
    return progress.groupBy("job_id").agg(
        F.max_by(F.struct("stage", "status", "current", "total"), F.struct("updated_at", "current")).alias("s"),
        F.max("updated_at").alias("updated_at"),
        F.max_by(pct, F.when(F.col("stage") != "failed", F.struct("updated_at", "current"))).alias("percent"),
        F.count(F.lit(1)).alias("updates"), *(extra or []),
    ).select("job_id", "s.*", "updated_at", F.coalesce("percent", F.lit(0)).alias("percent"), "updates")


def batch_progress(jobs: DataFrame) -> DataFrame:
    """jobs(batch_id, status, percent, captured, capturable) → totals per batch."""
    out = jobs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status").isin(FINISHED)).alias("finished"), F.sum("percent").alias("_p"),
        F.sum("captured").alias("capture_done"), F.sum("capturable").alias("capture_total"),
    )
    pct = G.js_round(F.col("capture_done") / F.col("capture_total") * 100)
    return out.withColumn("percent", G.js_round(F.col("_p") / F.col("total")).cast("int")).withColumn(
        "capture_pct", F.when(F.col("capture_total") > 0, F.least(F.lit(100), pct)).otherwise(F.lit(100)).cast("int")
    ).withColumn("capture_phase", F.when(F.col("capture_done") < F.col("capture_total"), F.lit("running")).otherwise(F.lit("done"))
                 ).drop("_p")


STALL_SECONDS = 90
CAPTURE_STALL_SECONDS = 180
CAPTURE_STEPS = ["page_capture", "element_capture"]


def stall_limit(step: Column) -> Column:
    return F.when(step.isin(CAPTURE_STEPS), F.lit(CAPTURE_STALL_SECONDS)).otherwise(F.lit(STALL_SECONDS))


#: Seconds of a job that are ordered in one task.
GAP_SLICE = 3600


def progress_gaps(progress: DataFrame) -> DataFrame:
    """Idle seconds before each update of a job against the limit of the step it was waiting in.

    A job is ordered in slices of time, each in a task of its own; the first update of a slice waits since the last one
    of the slice before, which comes from a table of one row per job and slice.  Rows without updated_at have no gap."""
    rows = progress.filter("updated_at is not null").withColumn("_part", F.floor(F.unix_seconds("updated_at") / GAP_SLICE))
    w = W.partitionBy("job_id", "_part").orderBy("updated_at", "seq")
    before = F.lag(F.struct("updated_at", "step")).over(w)
    last = rows.groupBy("job_id", "_part").agg(F.max_by(F.struct("updated_at", "step"), F.struct("updated_at", "seq")).alias("_last"))
    carried = last.select(F.col("job_id").alias("_job"), F.col("_part").alias("_slice"), F.lag("_last").over(W.partitionBy("job_id").orderBy("_part")).alias("_carried"))
    joined = rows.withColumn("_before", before).join(carried, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("_part") == F.col("_slice")))
    held = F.coalesce("_before", "_carried")
    idle = (F.unix_micros("updated_at") - F.unix_micros(held["updated_at"])) / 1000000.0
    rows = joined.select(*[F.col(f"`{c}`") for c in progress.columns], F.floor(idle).alias("idle_seconds"), held["step"].alias("waiting_in"))
    return rows.filter("idle_seconds is not null").withColumn("limit_seconds", stall_limit(F.col("waiting_in"))).withColumn(
        "stalled", F.col("idle_seconds") >= F.col("limit_seconds")
    )


def project_rollup(projects: DataFrame) -> DataFrame:
    """projects(project_id, step, cover_url, urls array<struct<url,viewports>>,
    jobs array<struct<job_id,status,viewport,capture_url>>) → one summary row each."""
    urls, jobs = F.col("urls"), F.col("jobs")
    inputs = F.aggregate(urls, F.lit(0), lambda n, u: n + F.greatest(F.lit(1), F.coalesce(F.size(u["viewports"]), F.lit(1))))
    done = F.filter(jobs, lambda j: j["status"] == "done")
    cover_of = lambda j: F.coalesce(
        T.blank_null(j["capture_url"]),
        F.when(T.blank_null(j["job_id"]).isNotNull(), F.concat(
            F.lit("/api/dev/captures/"), F.trim(j["job_id"]), F.lit("/"), F.when(j["viewport"] == "mo", F.lit("mo")).otherwise(F.lit("pc")),
            F.lit(".png"))))
    covers = F.filter(F.transform(done, cover_of), lambda c: c.isNotNull())
    return projects.select(
        "project_id",
        F.when(F.size(jobs) > 0, F.size(jobs)).otherwise(inputs).alias("page_count"),
        F.size(done).alias("analyzed_count"),
        F.coalesce(T.blank_null(F.col("cover_url")), F.get(covers, F.lit(0))).alias("cover_url"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.when(F.col("step") != 0, F.col("step")), F.lit(1)))).alias("current_step"),
    )
