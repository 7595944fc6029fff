"""Streaming jobs: rows arrive in three parts, each a run of its own over the same checkpoint; some batches are repeated."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from webplan.catalog.streams import run
from webplan.streaming import jobs as J
from webplan.streaming import state as ST

BASE = dt.datetime(2024, 1, 1)


def at(seconds=0.0, **more):
    return BASE + dt.timedelta(seconds=seconds, **more)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def arrive(spark, parts, schema, job, repeat=False):
    """Parts of rows one after the other through ``job``; with ``repeat`` the last batch of every run is done twice."""
    ST.stateful(spark)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    def once():
        def save(frame, batch):
            frame.write.mode("overwrite").parquet(f"{folder}/sink/batch={batch}")

        stream = spark.readStream.schema(schema).parquet(f"{folder}/source")
        job(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()

    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/source")
        once()
        if repeat:
            commits = f"{folder}/state/commits"
            last = max(int(x) for x in os.listdir(commits) if x.isdigit())
            for name in (str(last), f".{last}.crc"):
                if os.path.exists(f"{commits}/{name}"):
                    os.remove(f"{commits}/{name}")
            once()
    return spark.read.parquet(f"{folder}/sink").drop("batch")


JOBS = "job_id string, step string, updated_at timestamp, seq int, finished boolean"


def test_jobs_stall_time_out_or_finish(spark):
    row = lambda job, s, step="view", finished=False: (job, step, at(s), int(s * 10), finished)
    first = [row("a", 0), row("a", 89), row("b", 0), row("c", 0, "page_capture"), row("cap", 0), row("edge", 0), row("done", 0)]
    first += [row("cap", 60)]
    # out of order, but within the delay: 75 comes after 89 of another job, and still counts
    second = [row("c", 120), row("cap", 120), row("b", 75), row("b", 160), row("edge", 90), row("cap", 180), row("cap", 240), row("done", 80, finished=True), row("cap", 299), row("cap", 301, "page_capture"), row("long", 150, "element_capture")]
    third = [row("b", 500), row("z", 2000)]
    got = {(r["job_id"], r["started_us"] // 10**6 % 86400, r["last_us"] // 10**6 % 86400, r["ended_us"] // 10**6 % 86400, r["updates"], r["status"], r["step"])
           for r in arrive(spark, [first, second, third], JOBS, ST.stalled_jobs, repeat=True).collect()}
    assert got == {
        ("a", 0, 89, 179, 2, "stalled", "view"), ("b", 0, 160, 250, 3, "stalled", "view"), ("b", 500, 500, 590, 1, "stalled", "view"),
        # after the capture step came another: its limit counts, not the longer one
        ("c", 0, 120, 210, 2, "stalled", "view"),
        # reports every minute, and ends at 300 s; the update of 301 s begins a new run
        ("cap", 0, 299, 300, 6, "timeout", "view"), ("cap", 301, 301, 481, 1, "stalled", "page_capture"),
        # an update at the very end is too late
        ("edge", 0, 0, 90, 1, "stalled", "view"), ("edge", 90, 90, 180, 1, "stalled", "view"),
        ("long", 150, 150, 330, 1, "stalled", "element_capture"),
    }


def test_sessions_leave_by_themselves_and_are_told_once(spark):
    day = lambda d: at(days=d)
    parts = [[("u", "p", day(0), 1), ("v", "q", day(0), 1)], [("v", "q", day(10), 2), ("w", "r", day(13), 3)], [("x", "s", day(20), 4), ("u", "p", day(20), 5)], [("x", "s", day(23), 6)]]
    rows = arrive(spark, parts, "session_id string, user_id string, created_at timestamp, seq int", ST.session_expiry, repeat=True)
    told = sorted((r["session_id"], r["event"], (r["at_us"] - 1704067200 * 10**6) // (86400 * 10**6), r["renewals"]) for r in rows.collect())
    assert told == [("u", "opened", 0, 0), ("u", "opened", 20, 0), ("u", "purged", 14, 0), ("v", "opened", 0, 0), ("v", "renewed", 10, 1), ("w", "opened", 13, 0), ("x", "opened", 20, 0)]
    assert {r["session_id"] for r in ST.living(rows, F.lit(day(15))).collect()} == {"v", "w"}
    assert {r["session_id"] for r in ST.living(rows, F.lit(day(25))).collect()} == {"u", "w", "x"}


def test_sessions_that_left_come_from_windows(spark):
    """A row at the very end opens the next session, one a microsecond earlier renews; each end is told once."""
    day = lambda d, **more: at(days=d, **more)
    last = day(14) - dt.timedelta(microseconds=1)
    parts = [[("u", "p", day(0), 1), ("v", "q", day(0), 1), ("w", "r", day(0), 1)], [("v", "q", last, 2), ("w", "s", day(14), 2)], [("z", "z", day(20), 3)], [("z", "z", day(28, hours=1), 4)]]
    rows = arrive(spark, parts, "session_id string, user_id string, created_at timestamp, seq int", ST.purged_sessions, repeat=True)
    hours = lambda us: (us - 1704067200 * 10**6) / (3600 * 10**6)
    told = sorted((r["session_id"], r["user_id"], hours(r["opened_us"]), r["renewals"], round(hours(r["expires_us"]))) for r in rows.collect())
    assert told == [("u", "p", 0, 0, 336), ("v", "q", 0, 1, 672), ("w", "r", 0, 0, 336), ("w", "s", 336, 0, 672)]


ITEMS = "group_id string, item_id string, status string, cancel boolean, ts timestamp, seq int"


def test_totals_follow_every_change(spark):
    """A change takes an item out of the old count; older and repeated rows change nothing; one job holds most items."""
    parts = [
        [("big", f"i{k}", "pending", False, at(0), k) for k in range(300)] + [("j", "x", "pending", False, at(0), 1), (None, None, None, None, at(0), 1)],
        [("big", f"i{k}", "done", False, at(10), k) for k in range(100)] + [("big", "i0", "capturing", False, at(5), 0)] + [("j", "x", "done", False, at(9), 2)],
        [("big", "i1", "failed", False, at(20), 1), ("j", "x", "pending", False, at(1), 9)],
    ]
    rows = arrive(spark, parts, ITEMS, ST.status_totals, repeat=True)
    told = {(r["group_id"], r["version"]): dict(r["counts"]) for r in rows.collect()}
    assert told == {("big", 1): {"pending": 300}, ("big", 2): {"pending": 200, "done": 100}, ("big", 3): {"pending": 200, "done": 99, "failed": 1},
                    ("j", 1): {"pending": 1}, ("j", 2): {"done": 1}, (None, 1): {"": 1}}
    p = {r["job_id"]: tuple(r)[1:] for r in ST.capture_progress(ST.newest_totals(rows)).collect()}
    assert p == {"big": (200, 0, 99, 1, 300), "j": (0, 0, 1, 0, 1), None: (0, 0, 0, 0, 1)}


@pytest.mark.parametrize("few", [2, 4096])
def test_many_groups_share_few_keys(spark, few):
    """A bucket holds many groups, and counts the same where its one value is full."""
    first = [(f"g{g}", f"i{i}", "pending", False, at(0), 1) for g in range(6) for i in range(4)]
    parts = [first, [(f"g{g}", "i1", "done", g == 3, at(9), 2) for g in range(6)] + [("g0", "i9", "failed", False, at(1), 1)]]
    rows = arrive(spark, parts, ITEMS, lambda r: ST.status_totals(r, salts=1, parts=1, few=few), repeat=True).collect()
    want = {(f"g{g}", 1): ({"pending": 4}, False) for g in range(6)} | {(f"g{g}", 2): ({"pending": 3, "done": 1} | ({"failed": 1} if g == 0 else {}), g == 3) for g in range(6)}
    assert {(r["group_id"], r["version"]): (dict(r["counts"]), r["cancel"]) for r in rows} == want


def test_a_cancelled_batch_is_done(spark):
    parts = [[("b", "1", "done", False, at(0), 1), ("b", "2", "naming", False, at(0), 2), ("b", "3", "queued", False, at(0), 3), ("c", "1", "running", False, at(0), 1)],
             [("b", "2", "naming", True, at(5), 4), ("c", "1", "error", False, at(5), 2)]]
    rows = ST.batch_status(ST.newest_totals(arrive(spark, parts, ITEMS, ST.status_totals)))
    assert {tuple(r) for r in rows.collect()} == {("b", 3, True, 3, 2, "done"), ("c", 1, False, 1, 0, "done")}


def test_a_discovery_tells_its_totals_as_it_runs(spark):
    """The seed comes first; addresses come once; a site with most rows is split; what a stopped discovery found stays."""
    parts = [
        [("a.com", f"https://a.com/{k}", None, at(k)) for k in range(200)] + [("b.com", "https://b.com/y", None, at(0)), (None, "https://c.com/", None, at(0))],
        [("a.com", "https://a.com/7#again", None, at(300)), ("a.com", "https://a.com/", None, at(300)), ("a.com", "https://a.com/new", None, at(301)), ("b.com", None, "odd", at(301))],
        [("a.com", None, "stopped", at(400)), ("a.com", "https://a.com/late", None, at(401))],
    ]
    rows = arrive(spark, parts, "site string, url string, event string, ts timestamp", ST.stream_discovery, repeat=True)
    got = rows.collect()
    totals = sorted((r["site"], r["version"], r["total"], r["event"]) for r in got if r["kind"] == "total")
    assert totals == [("a.com", 1, 201, "running"), ("a.com", 2, 202, "running"), ("a.com", 3, 203, "stopped"), ("b.com", 1, 2, "running")]
    links = [(r["site"], r["url"]) for r in got if r["kind"] in ("seed", "link")]
    assert len(links) == len(set(links)) == 205 and ("a.com", "https://a.com/") in links
    assert all(r["version"] == 1 for r in got if r["kind"] == "seed")
    assert {tuple(r) for r in ST.discovery_totals(rows).collect()} == {("a.com", 203, "stopped"), ("b.com", 2, "running")}


def test_tag_events_create_screens_and_overwrite(spark):
    schema = "session_id string, screen_id string, stable_key string, event_type string, event_name string, ts timestamp, seq int"
    parts = [[("s", "home", "k1", "click", None, at(0), 1), ("s", "home", "k1", "click", "named", at(1), 2), ("s", "home", "k2", "view", "", at(0), 3)],
             [("s", "home", "k1", "click", "old", at(0.5), 4), ("s", "home", "k2", "view", "new", at(9), 5), ("s", "cart", "k1", "click", None, at(9), 6)]]
    rows = arrive(spark, parts, schema, lambda r: ST.tag_event_changes(r, J.tag_event_name()), repeat=True)
    counts = sorted(tuple(r)[1:6] for r in rows.filter("kind = 'counts'").collect())
    assert counts == [("s", "cart", 1, 1, 0), ("s", "home", 2, 0, 2), ("s", "home", 3, 2, 1)]
    assert {tuple(r) for r in ST.created_screens(rows).collect()} == {("s", x, x, "*", "route") for x in ("home", "cart")}
    assert {tuple(r)[:4] for r in ST.stored_events(rows).collect()} == {("s", "home", "k1", "named"), ("s", "home", "k2", "new"), ("s", "cart", "k1", "click")}


def test_newest_rows_by_slices(spark):
    steps = ["pending", "capturing", "done"]
    rows = [("j", "i1", s, at(hours=20 * n), n) for n, s in enumerate(steps)] + [("j", "i2", "pending", at(), 9)]
    keys = ["job_id", "item_id"]
    df = spark.createDataFrame(rows, "job_id string, item_id string, status string, ts timestamp, seq int")
    newest = J.fold_slices(run(df, "ts", lambda r: J.latest_rows(r, keys, ["status"]), "update"), keys)
    assert {(r["item_id"], r["status"], r["updates"]) for r in newest.collect()} == {("i1", "done", 3), ("i2", "pending", 1)}
