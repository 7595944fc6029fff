"""Streaming jobs that keep their own state: runs of jobs with time limits, sessions that expire, running totals.

State lives in the session's state store (``stateful`` sets the one that these jobs need).  Rows are taken in the order of
event time: what is newer than the watermark waits in the state of its key, so a row that arrives late, but within the
watermark's delay, finds its place.  Where one key may hold a great part of all rows it is split over salts first; a
second state per key adds up what the salts report, at most one row per salt and batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webplan.functions import urls as U
from webplan.operators import quality as Q
from webplan.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: seconds after which a job ends however often it reports.
HARD_CAP_SECONDS = 300
# Item states that a cancelled batch turns into errors, and the message they get.
CANCELLABLE = ["queued", "running", "collecting", "naming"]
CANCELLED_TEXT = "중단됨"
# Events that end a discovery.
TERMINAL = ["done", "stopped", "error"]
#: Fixed value: days that a session lives after it was opened or renewed.
SESSION_DAYS = 14
#: Parts into which the rows of one key are split before totals are added up.
SALTS = 16
#: Parts into which groups are dealt; each is split over the salts.
PARTS = 512
#: Items of a bucket that its state holds in one value.
FEW = 4096
_MICROS = 1_000_000


def stateful(spark: SparkSession) -> None:
    """Let the session run these jobs: their state store, and this package on the executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(micros: int) -> int:
    """The first millisecond not before a time: watermarks and timers count in these."""
    return -(-micros // 1000)


class Ordered(StatefulProcessor):
    """A key's rows in the order of event time: ``step`` sees each once the watermark has passed it.

    Rows have ``us`` (event time in microseconds) and ``seq`` (order of equal times)."""

    FIELDS = ""  # columns of a waiting row, without us and seq
    HELD = ""  # columns of the key's own state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us bigint, seq bigint, {self.FIELDS}")
        self.own = handle.getValueState("own", self.HELD)

    def names(self) -> list[str]:
        return ["us", "seq", *[f.split()[0] for f in self.FIELDS.split(", ")]]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [tuple(r[n] for n in self.names()) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())

    def advance(self, key, watermark: int) -> Iterator[Row]:
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in rows if _millis(r[0]) <= watermark]
        later = rows[len(due) :]
        held = tuple(self.own.get()) if self.own.exists() else None
        for row in due:
            held, told = self.step(key, held, row)
            yield from told
        held, told = self.end(key, held, watermark)
        yield from told
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if held is None:
            self.own.clear()
        else:
            self.own.update(held)
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        next_times = ([_millis(later[0][0])] if later else []) + ([_millis(self.deadline(held))] if held is not None else [])
        if next_times:
            self.handle.registerTimer(min(next_times))

    def deadline(self, held: tuple) -> int:
        raise NotImplementedError

    def step(self, key, held, row) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def end(self, key, held, watermark: int) -> tuple[tuple | None, list[Row]]:
        raise NotImplementedError

    def close(self) -> None:
        pass


# ------------------------------------------------------------------ jobs with limits


class JobRuns(Ordered):
    FIELDS = "step string, finished boolean"
    HELD = "start bigint, last bigint, step string, updates bigint"

    def deadline(self, held: tuple) -> int:
        start, last, step, _ = held
        limit = Q.CAPTURE_STALL_SECONDS if step in Q.CAPTURE_STEPS else Q.STALL_SECONDS
        return min(last + limit * _MICROS, start + HARD_CAP_SECONDS * _MICROS)

    def told(self, key, held: tuple) -> Row:
        start, last, step, updates = held
        at = self.deadline(held)
        status = "timeout" if at == start + HARD_CAP_SECONDS * _MICROS else "stalled"
        return Row(job_id=key[0], step=step, started_us=start, last_us=last, ended_us=at, updates=updates, status=status)

    def step(self, key, held, row):
        us, _, step, finished = row
        told = []
        if held is not None and us >= self.deadline(held):
            told, held = [self.told(key, held)], None
        if finished:
            return None, told
        start, updates = (us, 0) if held is None else (held[0], held[3])
        return (start, us, step, updates + 1), told

    def end(self, key, held, watermark):
        if held is not None and _millis(self.deadline(held)) <= watermark:
            return None, [self.told(key, held)]
        return held, []


def stalled_jobs(progress: DataFrame, delay: str = "15 seconds") -> DataFrame:
    """Every run of a job that had to be ended, judged by event time (append mode).

    progress(job_id, step, updated_at, seq, finished).  A run begins with a job's first update, or the first after its last
    run; it ends silently with a finished row.  It is *stalled* when no update came for 90 s, or 180 s if the newest one
    was a capture step, and ends by *timeout* 300 s after its beginning, updates or not; of both, the earlier counts.  An
    update at the very end belongs to the next run.  One state and one timer per job, moved by each update."""
    rows = progress.withWatermark("updated_at", delay).select(
        "job_id", F.unix_micros("updated_at").alias("us"), F.col("seq").cast("long").alias("seq"), "step", F.coalesce("finished", F.lit(False)).alias("finished"), "updated_at")
    return rows.groupBy("job_id").transformWithState(
        JobRuns(), "job_id string, step string, started_us bigint, last_us bigint, ended_us bigint, updates bigint, status string", "Append", "EventTime")


# ------------------------------------------------------------------ sessions


class Sessions(Ordered):
    FIELDS = "user_id string"
    HELD = "user_id string, opened bigint, renewed bigint, renewals bigint"

    def deadline(self, held: tuple) -> int:
        return held[2] + SESSION_DAYS * 86400 * _MICROS

    def row(self, key, held: tuple, event: str, at: int) -> Row:
        return Row(session_id=key[0], user_id=held[0], event=event, at_us=at, expires_us=self.deadline(held), renewals=held[3])

    def step(self, key, held, row):
        us, _, user = row
        told = []
        if held is not None and us >= self.deadline(held):
            told, held = [self.row(key, held, "purged", self.deadline(held))], None
        event, held = ("opened", (user, us, us, 0)) if held is None else ("renewed", (user, held[1], us, held[3] + 1))
        return held, [*told, self.row(key, held, event, us)]

    def end(self, key, held, watermark):
        if held is not None and _millis(self.deadline(held)) <= watermark:
            return None, [self.row(key, held, "purged", self.deadline(held))]
        return held, []


def session_expiry(sessions: DataFrame, delay: str = "1 minute") -> DataFrame:
    """What happens to sessions (append mode): session_id, user_id, event (opened | renewed | purged), at_us, expires_us,
    renewals.

    sessions(session_id, user_id, created_at, seq): a row opens a session, or renews it while it lives.  A session that
    was not renewed for 14 days leaves the state by itself when the watermark passes its end and is told once as purged;
    a row at or after that end opens a new one.  The state holds living sessions only."""
    rows = sessions.withWatermark("created_at", delay).select(
        "session_id", F.unix_micros("created_at").alias("us"), F.col("seq").cast("long").alias("seq"), "user_id", "created_at")
    return rows.groupBy("session_id").transformWithState(
        Sessions(), "session_id string, user_id string, event string, at_us bigint, expires_us bigint, renewals bigint", "Append", "EventTime")


def purged_sessions(sessions: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The sessions that have left (append mode), each told once when the watermark passes its end: session_id, user_id (of
    its newest row), opened_us, expires_us, renewals.

    sessions(session_id, user_id, created_at, seq), and what a session is, as in ``session_expiry``.  The state is a session
    window per living session, closed by the watermark; no row passes through Python.  A window's end still belongs to it,
    so the gap is a microsecond short of a session's life, and a watermark at that very microsecond closes it."""
    at = F.struct("created_at", "seq")
    gap = F.session_window("created_at", f"{SESSION_DAYS - 1} days 23 hours 59 minutes 59 seconds 999 milliseconds 999 microseconds").alias("session")
    rows = sessions.withWatermark("created_at", delay).groupBy("session_id", gap).agg(
        F.max_by("user_id", at).alias("user_id"), F.count(F.lit(1)).alias("rows"))
    return rows.select("session_id", "user_id", F.unix_micros("session.start").alias("opened_us"), (F.unix_micros("session.end") + 1).alias("expires_us"),
                       (F.col("rows") - 1).alias("renewals"))


def living(events: DataFrame, now: Column) -> DataFrame:
    """The sessions that are valid at ``now``, from the rows of session_expiry up to then."""
    rows = events.filter(F.col("at_us") <= F.unix_micros(now))
    order = F.struct("at_us", (F.col("event") != "purged").cast("int").alias("o"), "renewals")
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("user_id", "event", "expires_us"), order).alias("v")).select("session_id", "v.*")
    return last.filter((F.col("event") != "purged") & (F.col("expires_us") > F.unix_micros(now))).drop("event")


# ------------------------------------------------------------------ totals by retraction


class Changes(StatefulProcessor):
    """Newest state per item of a bucket, and how a batch changes the counts: one row per group, bucket and batch.

    Each key and each access to the state is a call out of Python, so groups share buckets, and the first ``limit`` items of a
    bucket are held in one value that a batch reads and writes once; those that come after them have an entry each."""

    def __init__(self, limit: int = FEW):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", "items array<struct<group_id:string,item_id:string,us:bigint,seq:bigint,status:string>>")
        self.items = handle.getMapState("items", "group_id string, item_id string", "us bigint, seq bigint, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest, cancel = {}, set()
        for r in rows:
            item, at = (r["group_id"], r["item_id"]), (r["us"], r["seq"])
            if item not in newest or at > newest[item][0]:
                newest[item] = (at, r["status"])
            if r["cancel"]:
                cancel.add(item[0])
        held = self.few.get()
        few = {(group, item): tuple(rest) for group, item, *rest in (held[0] if held is not None else [])}
        full = len(few) >= self.limit  # only then items may have entries of their own
        changed = False
        deltas: dict[str | None, dict[str, int]] = {group: {} for group in cancel}
        for item, (at, status) in newest.items():
            known = few.get(item)
            if known is None and full:
                known = self.items.getValue(item)
            delta = deltas.setdefault(item[0], {})
            if known is not None:
                if tuple(known[:2]) >= at:
                    continue
                delta[known[2]] = delta.get(known[2], 0) - 1
            if item in few or len(few) < self.limit:
                few[item], changed = (*at, status), True
            else:
                self.items.updateValue(item, (*at, status))
            delta[status] = delta.get(status, 0) + 1
        if changed:
            self.few.update(([(*item, *rest) for item, rest in few.items()],))
        for group, delta in deltas.items():
            delta = {k: v for k, v in delta.items() if v}
            if delta or group in cancel:
                yield Row(group_id=group, status=list(delta), change=list(delta.values()), cancel=group in cancel)

    def close(self) -> None:
        pass


class Totals(StatefulProcessor):
    """Counts per status of a part's groups: what the salts report is added, and the totals told after every batch.  The first
    ``limit`` groups of a part are held in one value, as in ``Changes``."""

    def __init__(self, limit: int = FEW):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", "groups array<struct<group_id:string,counts:map<string,bigint>,cancel:boolean,version:bigint>>")
        self.others = handle.getMapState("others", "group_id string", "counts map<string,bigint>, cancel boolean, version bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        told: dict[str | None, tuple[dict[str, int], bool]] = {}
        for r in rows:
            delta, cancel = told.get(r["group_id"], ({}, False))
            for status, change in zip(r["status"], r["change"]):
                delta[status] = delta.get(status, 0) + change
            told[r["group_id"]] = (delta, cancel or r["cancel"])
        held = self.few.get()
        few = {group: tuple(rest) for group, *rest in (held[0] if held is not None else [])}
        full, changed = len(few) >= self.limit, False
        for group, (delta, cancel) in told.items():
            known = few.get(group)
            if known is None and full:
                known = self.others.getValue((group,))
            counts, cancelled, version = ({}, False, 0) if known is None else known
            counts = {k: counts.get(k, 0) + delta.get(k, 0) for k in {**counts, **delta}}
            now = ({k: v for k, v in counts.items() if v}, cancelled or cancel, version + 1)
            if group in few or len(few) < self.limit:
                few[group], changed = now, True
            else:
                self.others.updateValue((group,), now)
            yield Row(group_id=group, counts=now[0], cancel=now[1], version=now[2])
        if changed:
            self.few.update(([(group, *rest) for group, rest in few.items()],))

    def close(self) -> None:
        pass


def status_totals(items: DataFrame, salts: int = SALTS, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """Running counts of items per status (append mode, one row per group and batch that changed it): group_id, counts
    (status -> items), cancel, version (rising).

    items(group_id, item_id, status, cancel, ts, seq).  Every item is counted in its newest status by (ts, seq); a newer one
    takes it out of the old count and into the new, an older one changes nothing.  A null status counts as ''.  Groups are
    dealt over buckets, and one with a great part of all items is split over salts; totals see one row per salt and batch."""
    part = lambda group: F.pmod(F.xxhash64(group), F.lit(parts))
    rows = items.select(
        F.col("group_id").cast("string").alias("group_id"), F.pmod(F.xxhash64("item_id"), F.lit(salts)).alias("salt"),
        part(F.col("group_id").cast("string")).alias("part"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce("status", F.lit("")).alias("status"), F.coalesce("cancel", F.lit(False)).alias("cancel"), F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"))
    changes = rows.groupBy("part", "salt").transformWithState(
        Changes(few), "group_id string, status array<string>, change array<bigint>, cancel boolean", "Append", "None")
    return changes.withColumn("part", part(F.col("group_id"))).groupBy("part").transformWithState(
        Totals(few), "group_id string, counts map<string,bigint>, cancel boolean, version bigint", "Append", "None")


def newest_totals(rows: DataFrame) -> DataFrame:
    """The last totals per group of what ``status_totals`` has told."""
    return rows.groupBy("group_id").agg(F.max_by(F.struct("counts", "cancel"), "version").alias("v")).select("group_id", "v.*")


def _count(*statuses: str) -> Column:
    return sum((F.coalesce(F.element_at("counts", F.lit(s)), F.lit(0)) for s in statuses), F.lit(0)).cast("long")


def _all() -> Column:
    return F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)


def batch_status(totals: DataFrame) -> DataFrame:
    """Totals of ``status_totals``, of a stream or of its newest rows -> state per batch: batch_id, total, cancelled,
    done_count, stopped_items, status.  A cancelled batch turns its unfinished items into errors."""
    finished, unfinished = _count("done", "error", "login_required"), _count(*CANCELLABLE)
    rows = totals.select("*", _all().alias("total"), finished.alias("finished"), unfinished.alias("open_items"))
    return rows.select(
        F.col("group_id").alias("batch_id"), "total", F.col("cancel").alias("cancelled"),
        F.when(F.col("cancel"), F.least("total", F.col("finished") + F.col("open_items"))).otherwise(F.col("finished")).alias("done_count"),
        F.when(F.col("cancel"), F.col("open_items")).otherwise(F.lit(0).cast("long")).alias("stopped_items"),
        F.when(F.col("cancel") | (F.col("finished") >= F.col("total")), F.lit("done")).otherwise(F.lit("running")).alias("status"),
        *[c for c in ("version",) if c in totals.columns])


def capture_progress(totals: DataFrame) -> DataFrame:
    """Totals of ``status_totals`` -> counts per capture status and job."""
    return totals.select(F.col("group_id").alias("job_id"), *[_count(k).alias(k) for k in ("pending", "capturing", "done", "failed")], _all().alias("total"),
                         *[c for c in ("version",) if c in totals.columns])


# ------------------------------------------------------------------ discovery


class Found(StatefulProcessor):
    """Addresses of a salted part of a site that were not seen before, and their number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "us bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, end = {}, None
        for r in rows:
            if r["event"] is not None:
                end = max(end or (r["us"], r["event"]), (r["us"], r["event"]))
            elif r["url"] not in first or r["us"] < first[r["url"]]:
                first[r["url"]] = r["us"]
        fresh = [u for u in sorted(first) if not self.seen.containsKey((u,))]
        for u in fresh:
            self.seen.updateValue((u,), (first[u],))
        if fresh or end:
            yield Row(site=key[0], urls=fresh, event=end[1] if end else None, us=end[0] if end else max(first[u] for u in fresh))

    def close(self) -> None:
        pass


class Running(StatefulProcessor):
    """A site's discovery: the seed first, then its addresses, the total so far, and how it ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.site = handle.getValueState("site", "total bigint, version bigint, ended bigint, event string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, version, ended, event = (0, 0, None, None) if not self.site.exists() else tuple(self.site.get())
        if not version:
            total = 1
            yield Row(site=key[0], kind="seed", url=f"https://{key[0]}/", event=None, total=None, version=1)
        version += 1
        for r in rows:
            for u in r["urls"]:
                yield Row(site=key[0], kind="link", url=u, event=None, total=None, version=version)
            total += len(r["urls"])
            if r["event"] is not None and (ended is None or (r["us"], r["event"]) > (ended, event)):
                ended, event = r["us"], r["event"]
        self.site.update((total, version, ended, event))
        yield Row(site=key[0], kind="total", url=None, event=event or "running", total=total, version=version)

    def close(self) -> None:
        pass


def stream_discovery(batches: DataFrame, salts: int = SALTS) -> DataFrame:
    """A discovery as it runs (append mode): site, kind (seed | link | total), url, event, total, version.

    batches(site, url, event, ts); a terminal row has an event and no address.  The seed of a site comes before all else,
    every address once, and after each batch that brought something a row with the number of addresses so far, the seed
    included, and the state: running, or the newest terminal event, after which what was found stays counted.

    A site's addresses are split over salted keys, each with a map of the addresses it has seen; its totals see one row per
    salt and batch."""
    seed = F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    key = F.coalesce(U.canonical_link(F.col("url")), F.trim("url"))
    rows = batches.select("site", F.when(F.col("event").isin(TERMINAL), F.col("event")).alias("event"), key.alias("url"), F.unix_micros("ts").alias("us"))
    rows = rows.filter("site is not null").filter(F.col("event").isNotNull() | ((F.coalesce("url", F.lit("")) != "") & (F.col("url") != seed)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(salts)))
    found = rows.groupBy("site", "salt").transformWithState(Found(), "site string, urls array<string>, event string, us bigint", "Append", "None")
    return found.groupBy("site").transformWithState(
        Running(), "site string, kind string, url string, event string, total bigint, version bigint", "Append", "None")


def discovery_totals(rows: DataFrame) -> DataFrame:
    """The newest total per site of what stream_discovery has told: site, total, state."""
    return rows.filter("kind = 'total'").groupBy("site").agg(F.max_by(F.struct("total", F.col("event").alias("state")), "version").alias("v")).select("site", "v.*")


# ------------------------------------------------------------------ tag events


class Screens(StatefulProcessor):
    """The tag events of one screen: which are new, which overwrite, and the screen itself if it was unknown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "stable_key string", "us bigint, seq bigint, event_name string, event_type string")
        self.screen = handle.getValueState("screen", "created bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session, screen = key
        base = dict(session_id=session, screen_id=screen, accepted=None, upserted=None, skipped=None, stable_key=None, event_name=None, event_type=None, us=None, seq=None)
        newest, count = {}, {}
        for r in rows:
            at = (r["us"], r["seq"])
            count[r["stable_key"]] = count.get(r["stable_key"], 0) + 1
            if r["stable_key"] not in newest or at > newest[r["stable_key"]][0]:
                newest[r["stable_key"]] = (at, r["event_name"], r["event_type"])
        if not self.screen.exists():
            self.screen.update((min(v[0][0] for v in newest.values()),))
            yield Row(kind="screen", **base)
        upserted = 0
        for stable, (at, name, kind) in newest.items():
            known = self.events.getValue((stable,)) if self.events.containsKey((stable,)) else None
            upserted += known is None
            if known is None or tuple(known[:2]) < at:
                self.events.updateValue((stable,), (*at, name, kind))
                yield Row(kind="event", **{**base, "stable_key": stable, "event_name": name, "event_type": kind, "us": at[0], "seq": at[1]})
        accepted = sum(count.values())
        yield Row(kind="counts", **{**base, "accepted": accepted, "upserted": upserted, "skipped": accepted - upserted})

    def close(self) -> None:
        pass


def tag_event_changes(events: DataFrame, name: Column) -> DataFrame:
    """Tag events into the store, batch by batch (append mode): kind, session_id, screen_id, accepted, upserted, skipped,
    stable_key, event_name, event_type, us, seq.

    events(session_id, screen_id, stable_key, event_type, ts, seq) named by ``name``.  Per batch and screen: one *counts* row
    (a key seen for the first time is upserted, every other row skipped though it overwrites), one *event* row per key
    whose stored value changed, and one *screen* row when the screen was unknown; its name is its id, its address pattern
    ``*``, and it was detected by route.  A batch of n rows reads and writes the state of n keys at most."""
    rows = events.select("session_id", "screen_id", F.coalesce("stable_key", F.lit("")).alias("stable_key"), name.alias("event_name"), "event_type",
                         F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("session_id", "screen_id").transformWithState(
        Screens(), "kind string, session_id string, screen_id string, accepted bigint, upserted bigint, skipped bigint, stable_key string, event_name string, event_type string, us bigint, seq bigint",
        "Append", "None")


def created_screens(changes: DataFrame) -> DataFrame:
    """The screens that tag events have created, as rows of the screen table."""
    return changes.filter("kind = 'screen'").select("session_id", "screen_id", F.col("screen_id").alias("screen_name"), F.lit("*").alias("page_url_pattern"), F.lit("route").alias("detected_by"))


def stored_events(changes: DataFrame) -> DataFrame:
    """The stored tag events: the newest row per session, screen and key."""
    keys = ["session_id", "screen_id", "stable_key"]
    rows = changes.filter("kind = 'event'")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("event_name", "event_type"), F.struct("us", "seq")).alias("v")).select(*keys, "v.*")
