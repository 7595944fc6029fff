"""Attaching event names: registry lookup, rule namer, batches, model responses and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webplan.functions import params as P
from webplan.functions import text as T
from webplan.session import settle

Namer = Callable[[DataFrame], DataFrame]
# Keys under which a response may hold its rows; rows per batch and depth of splits.
RESPONSE_KEYS = ["suggestions", "results", "items", "candidates", "data"]
BATCH_ROWS = 35
MAX_SPLIT_DEPTH = 5


def registry_lookup(rows: DataFrame, name: str, registry: DataFrame, out: str = "registry_name") -> DataFrame:
    """Registry spelling of ``name``: itself, else its spelling without white space, else the first registered name
    that is equal without white space.

    registry(name[, seq]): ``seq`` is the order of registration; without it the alphabet decides."""
    exact = registry.select(F.col("name").alias("_exact"), F.col("name").alias("_e")).distinct()
    own = T.canonical_event_name(F.col("name"))
    order = F.struct("seq", "name") if "seq" in registry.columns else F.col("name")
    loose = registry.groupBy(own.alias("_loose")).agg(
        F.coalesce(F.max(F.when(F.col("name") == own, F.col("name"))), F.min_by("name", order)).alias("_l"))
    key = T.canonical_event_name(F.col(name))
    cols = rows.columns
    return (
        rows.join(exact, T.trimmed(F.col(name)) == F.col("_exact"), "left")
        .join(loose, (key == F.col("_loose")) & (key != ""), "left")
        .select(*cols, F.coalesce("_e", "_l").alias(out))
    )


def last_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the greatest ``seq`` per key; rows that tie, or have no such column, are ordered by all fields."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*(["seq"] if "seq" in rest else []), *[c for c in rest if c != "seq"])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*keys, "_v.*")


def rule_namer(elements: DataFrame, reason: str = "rule") -> DataFrame:
    """Deterministic names: landmark decides the area, else the section heading, else unknown."""
    heading = T.blank_null(F.col("section_heading"))
    area = F.when(F.col("landmark") == "gnb", F.lit("global/gnb")).when(
        F.col("landmark") == "fnb", F.lit("global/fnb")
    ).otherwise(F.coalesce(heading, F.lit("unknown")))
    action = F.when(area == "global/gnb", F.lit("click_gnb")).when(area == "global/fnb", F.lit("click_fnb")).otherwise(
        F.lit("click")
    )
    label = F.coalesce(T.blank_null(F.col("label")), F.lit("[button]"))
    return elements.select(
        "page_id", "tag_id", area.alias("category"), action.alias("action"), label.alias("label"),
        label.alias("merge_label"), F.lit(T.CLICK_EVENT).alias("event_name"),
        F.array().cast(P.PARAMS).alias("parameters"), F.lit(f"ambiguous — manual review ({reason})").alias("reason"),
    )


def apply_namer(elements: DataFrame, namer: Namer = rule_namer) -> DataFrame:
    """Run a naming step and make it lossless: unknown ids are dropped, missing ids get rule names.

    Of several rows for an id the last by ``seq`` stays, or without one the greatest."""
    keys = ["page_id", "tag_id"]
    elements = settle(elements)
    named = settle(last_per_key(namer(elements).join(elements.select(*keys), keys, "left_semi"), keys))
    missing = elements.join(named.select(*keys), keys, "left_anti")
    return named.unionByName(rule_namer(missing, "missing_from_response"), allowMissingColumns=True)


def lossless_check(expected: DataFrame, got: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Per group: ids that are missing from, or extra in, ``got``.  Empty when nothing was lost."""
    a = expected.select(*keys).distinct().withColumn("_in", F.lit(True))
    b = got.select(*keys).distinct().withColumn("_out", F.lit(True))
    return (
        a.join(b, keys, "full_outer")
        .groupBy(*group)
        .agg(F.count_if(F.col("_out").isNull()).alias("missing"), F.count_if(F.col("_in").isNull()).alias("extra"))
        .filter("missing > 0 or extra > 0")
    )


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int = BATCH_ROWS) -> DataFrame:
    """Consecutive chunks of ``size`` rows per key with a ``first-last`` range label."""
    w = W.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(w)
    rows = rows.withColumn("_i", i).withColumn("_n", n).withColumn("batch_no", F.floor(F.col("_i") / size).cast("int"))
    first = F.col("batch_no") * size
    last = F.least(first + size, F.col("_n")) - 1
    return rows.withColumn("range_label", F.concat(first.cast("int"), F.lit("-"), last.cast("int"))).drop("_i", "_n")


def split_truncated(batches_: DataFrame, max_depth: int = MAX_SPLIT_DEPTH) -> DataFrame:
    """Next round of batches.  ``batches_`` has first, last, depth, outcome (ok | truncated | failed).

    A truncated batch of more than one row below the depth limit becomes two halves (the left one
    takes the odd row); every other unfinished batch ends with a fallback reason."""
    size = F.col("last") - F.col("first") + 1
    deep = F.col("depth") >= max_depth
    split = (F.col("outcome") == "truncated") & (size > 1) & ~deep
    reason = F.when(F.col("outcome") == "failed", F.lit("retry_exhausted")).when(
        (F.col("outcome") == "truncated") & ~split, F.when(deep, F.lit("max_split_depth")).otherwise(F.lit("truncated_at_size_1"))
    )
    mid = (F.col("first") + F.ceil(size / 2) - 1).cast("int")
    part = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))
    parts = F.when(split, F.array(part(F.col("first"), mid), part(mid + 1, F.col("last")))).otherwise(
        F.array(part(F.col("first"), F.col("last")))
    )
    rest = [c for c in batches_.columns if c not in ("first", "last", "depth")]
    return batches_.select(
        *rest, F.when(split, F.col("depth") + 1).otherwise(F.col("depth")).cast("int").alias("depth"),
        split.alias("retry"), reason.alias("fallback_reason"), F.explode(parts).alias("p"),
    ).select(*rest, "depth", "retry", "fallback_reason", "p.first", "p.last",
             F.concat("p.first", F.lit("-"), "p.last").alias("range_label"))


# ------------------------------------------------------------------ model responses


def strip_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def response_class(text: Column, finish_reason: Column, error: Column) -> Column:
    """OK, TRUNCATED, RETRYABLE_ERROR or FATAL for one model response."""
    body = strip_fence(T.nz(text))
    msg = F.lower(T.nz(error))
    opens = lambda a, b: F.regexp_count(body, F.lit(a)) > F.regexp_count(body, F.lit(b))
    cut = body.rlike(r"^[\[{]") & F.try_parse_json(body).isNull() & (opens(r"\{", r"\}") | opens(r"\[", r"\]"))
    retry = msg.rlike(
        "rate limit|429| 500| 502| 503| 504|network|fetch failed|econnreset|etimedout|socket hang up"
    ) | (msg.contains("openrouter") & msg.contains("after retries"))
    return (
        F.when((F.coalesce(finish_reason, F.lit("")) == "length")
               | msg.rlike("unexpected end of json input|unterminated string|response truncated") | cut, F.lit("TRUNCATED"))
        .when(retry, F.lit("RETRYABLE_ERROR"))
        .when((msg != "") | F.try_parse_json(body).isNull(), F.lit("FATAL"))
        .otherwise(F.lit("OK"))
    )


def parse_suggestions(responses: DataFrame, registry: DataFrame) -> DataFrame:
    """Suggestion rows of a table of model responses (batch_id, page_id, text, finish_reason, error).

    Responses that are not usable yield no rows; see ``response_class`` for their fate."""
    body = F.try_parse_json(strip_fence(F.col("text")))
    as_array = lambda path: F.try_variant_get("_json", path, "array<variant>")
    rows = responses.withColumn("_json", body).filter(F.col("_json").isNotNull())
    items = F.coalesce(as_array("$"), *[as_array(f"$.{k}") for k in RESPONSE_KEYS])
    text = lambda v, path: F.when(
        F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string")
    )
    rows = rows.select(
        "batch_id", "page_id", T.blank_null(text("_json", "$.page_category")).alias("page_category"),
        F.posexplode(items).alias("seq", "v"),
    )
    tag_kind = F.schema_of_variant(F.try_variant_get("v", "$.tag_id", "variant"))
    spaced = lambda path: T.display_spacing(T.nz(text("v", path)))
    rows = rows.filter(tag_kind.rlike("^(BIGINT|DECIMAL|DOUBLE|INT)")).select(
        "batch_id", "page_id", "page_category", "seq", F.try_variant_get("v", "$.tag_id", "int").alias("tag_id"),
        spaced("$.category").alias("category"), T.blank_null(text("v", "$.action")).alias("_action"),
        spaced("$.label").alias("_label"), spaced("$.merge_label").alias("_merge"),
        T.blank_null(text("v", "$.new_event_name")).alias("_new"), T.blank_null(text("v", "$.new_event_reason")).alias("_why"),
        T.blank_null(text("v", "$.event_name")).alias("_event"), text("v", "$.rationale").alias("rationale"),
        F.transform(
            F.coalesce(F.try_variant_get("v", "$.parameters", "array<variant>"), F.array().cast("array<variant>")),
            lambda p: F.struct(text(p, "$.name").alias("name"), text(p, "$.value_hint").alias("value_hint")),
        ).alias("parameters"),
    ).filter("category <> ''")
    label = F.coalesce(T.blank_null(F.col("_label")), F.col("category"))
    rows = rows.withColumn("label", label).withColumn("merge_label", F.coalesce(T.blank_null(F.col("_merge")), label))
    rows = rows.withColumn("_raw", F.coalesce("_new", "_event", F.lit(T.CLICK_EVENT)))
    rows = registry_lookup(rows, "_raw", registry)
    event = T.sanitize_event_name(F.col("_raw"), F.col("registry_name"))
    rows = rows.withColumn("event_name", event)
    created = F.col("_new").isNotNull() & F.col("registry_name").isNull() & (F.col("event_name") != T.CLICK_EVENT)
    return rows.select(
        "batch_id", "page_id", "page_category", "seq", "tag_id", "category",
        F.coalesce("_action", T.action_from_event(F.col("event_name"))).alias("action"), "label", "merge_label", "event_name",
        P.allow_extras(F.filter("parameters", lambda p: p["name"].isNotNull())).alias("parameters"),
        created.alias("registry_created"), F.when(created, F.coalesce("_why", "rationale")).alias("reason"),
    )


def page_category_vote(batches_: DataFrame, override: Column, hint: Column) -> DataFrame:
    """One page category per page: override, else the first batch that named one, else the hint.

    batches_(page_id, batch_no, page_category, override, hint)."""
    model = F.min_by(T.blank_null(F.col("page_category")), F.when(T.blank_null(F.col("page_category")).isNotNull(), F.col("batch_no")))
    return batches_.groupBy("page_id").agg(
        F.coalesce(F.max(T.blank_null(override)), model, F.max(T.blank_null(hint)), F.lit(T.DEFAULT_PAGE)).alias("page_category")
    )


def registry_delta(suggestions: DataFrame, registry: DataFrame, default_reason: str = "LLM 정의 이벤트") -> DataFrame:
    """Names this run created (with the reason its first row gives) and names it reused.

    suggestions(event_name, registry_created, reason, seq).  A known name whose first row claims to
    have created it is neither."""
    named = registry_lookup(suggestions.filter(T.nz(F.trim("event_name")) != ""), "event_name", registry)
    key = F.coalesce("registry_name", T.trimmed(F.col("event_name")))
    first = named.groupBy(key.alias("event_name")).agg(
        F.max(F.col("registry_name").isNotNull()).alias("known"),
        F.min_by(F.struct("registry_created", "reason"), "seq").alias("f"),
    )
    status = F.when(~F.col("known"), F.lit("created")).when(~F.col("f.registry_created"), F.lit("reused"))
    return first.select(
        "event_name", status.alias("status"),
        F.when(~F.col("known"), F.coalesce("f.reason", F.lit(default_reason))).alias("reason"),
    ).filter("status is not null")
