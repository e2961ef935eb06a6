"""Streams that keep documents, counts and intervals: any order, repeats and restarts leave what a batch finds."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from almanac.operators import history, shelf
from almanac.plans.queries import QUERIES
from almanac.sources import tables
from almanac.sources.schemas import DIMENSIONS, EVENTS
from almanac.sources.storage import table, written
from almanac.sources.tables import SNAPSHOT, actions, announcements
from almanac.streaming import counts, documents, folds, revisions

DATA = "/root/testdata/sf0.001"


def event_files(spark, folder, parts, seed):
    """Writes events in `parts` shuffled files, a third of them twice; returns a function that adds the files from one place to another."""
    rows = spark.read.parquet(f"{DATA}/events.parquet").collect()
    random.Random(seed).shuffle(rows)
    pieces = [rows[i::parts] for i in range(parts)]
    pieces += pieces[::3]

    def add(first, last):
        for piece in pieces[first:last]:
            spark.createDataFrame(piece, EVENTS).coalesce(1).write.mode("append").parquet(folder)

    return add, len(pieces)


def test_documents_after_shuffled_repeated_files_and_a_restart(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("events", "documents", "progress"))
    add, n = event_files(spark, source, 9, 1)
    scores = written(tables.catalog(spark, DATA).select("item_id", *DIMENSIONS), "scores")
    keep = lambda: documents.keep_documents(actions(folds.raw_events(spark, f"{source}", 2)), scores, path, progress, buckets=4).awaitTermination()
    add(0, n // 2)
    keep()
    half = {r["user_id"]: r["doc"] for r in documents.read_documents(spark, path).collect()}
    add(n // 2, n)
    keep()  # goes on from the states it left
    want = {r["user_id"]: r["doc"] for r in QUERIES["state_encode"](spark, DATA).collect()}
    got = {r["user_id"]: r["doc"] for r in documents.read_documents(spark, path).collect()}
    assert got == want and half != want


LOG = "seq long, ts timestamp, user_id long, item_id long, action string, shelf_status string, dimension string, score decimal(3,1), note string"


def entries_of(actions_, watermark=None):
    state = {"wishes": {}, "marks": {}, "ratings": {}, "notes": {}}
    for a in actions_:
        documents.take(state, *a, watermark)
    return sorted(documents.entries(state), key=str)


def test_any_order_of_actions_leaves_the_same_state():
    draw = random.Random(3)
    log = []
    for seq in range(200):
        kind = draw.choice(documents.ACTIONS)
        log.append((kind, str(draw.randrange(5)), seq, seq, draw.choice(["", "note", "playing"]), draw.choice(DIMENSIONS), str(draw.randrange(10, 100) / 10)))
    want = entries_of(log)
    for _ in range(20):
        shuffled = log + draw.sample(log, 50)
        draw.shuffle(shuffled)
        assert entries_of(shuffled) == want


def test_entries_by_hand():
    toggle, rate = lambda i, seq: ("toggle", i, seq, seq, None, None, None), lambda i, seq, d, s: ("rate", i, seq, seq, None, d, s)
    none = (None,) * 4
    assert entries_of([toggle("1", 1), toggle("1", 2), toggle("2", 3), toggle("2", 3)]) == [("wishlist", "2", 3, None, *none)]
    assert entries_of([("shelf_set", "1", 1, 1, "playing", None, None), ("shelf_clear", "1", 2, 2, None, None, None)]) == []
    assert entries_of([rate("1", 1, "story", "2.0"), ("rate_reset", "1", 2, 2, None, None, None), rate("1", 3, "music", "9.1")]) == [("rating", "1", 2, None, None, None, None, "9.1")]
    assert entries_of([rate("1", 1, "story", "2.0"), ("rate_reset", "1", 2, 2, None, None, None)]) == []
    assert entries_of([("note", "1", 2, 2, "", None, None), ("note", "1", 1, 1, "old", None, None)]) == [("note", "1", 2, "", *none)]


def test_late_toggles_and_what_is_forgotten():
    state = {"wishes": {}, "marks": {}, "ratings": {}, "notes": {}}
    for seq, at in ((1, 100), (2, 900)):
        documents.take(state, "toggle", "7", seq, at, None, None, None, 0)
    documents.forget(state, 500)
    assert state["wishes"]["7"] == [2, 2, {"2": 900}]
    documents.take(state, "toggle", "7", 1, 100, None, None, None, 500)  # came before: late, and not counted again
    documents.take(state, "shelf_set", "7", 1, 100, "paused", None, None, 500)
    assert state["wishes"]["7"][0] == 2 and state["marks"]["7"] == [1, "paused"]


def test_documents_with_a_watermark_equal_a_batch_in_order(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("events", "documents", "progress"))
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("event_id").collect()
    for i in range(0, len(events), len(events) // 3 + 1):
        spark.createDataFrame(events[i : i + len(events) // 3 + 1], EVENTS).coalesce(1).write.mode("append").parquet(source)
        documents.keep_documents(actions(folds.raw_events(spark, source)), tables.catalog(spark, DATA), path, progress, late="2 days").awaitTermination()
    want = {r["user_id"]: r["doc"] for r in QUERIES["state_encode"](spark, DATA).collect()}
    assert {r["user_id"]: r["doc"] for r in documents.read_documents(spark, path).collect()} == want


def test_a_user_without_state_has_no_document(spark):
    schema = documents.ENTRIES
    rows = spark.createDataFrame([(1, "none", *[None] * 7), (2, "note", 5, 1, "x", *[None] * 4), (3, "rating", 99, -1, None, "1.0", None, None, None)], schema)
    scores = tables.catalog(spark, DATA)
    got = {r["user_id"]: r["doc"] for r in documents.documents(rows, scores).collect()}
    assert got == {1: None, 2: '{"notes":{"5":"x"}}', 3: got[3]} and '"gameplay":1.0' in got[3]


def test_sink_keeps_two_versions_and_tells_errors_apart(spark, tmp_path):
    path = str(tmp_path / "sink")
    merge = folds.merge_into(path, ["k"], 2)
    rows = lambda *pairs: spark.createDataFrame(pairs, "k long, v string")
    for number in range(5):
        merge(rows(*((k, f"{number}") for k in range(number, number + 6))), number)
    merge(rows(*((k, "4") for k in range(4, 10))), 4)  # the last batch again
    found = folds.snapshot(spark, path, rows((0, "")).schema)
    assert {r["k"]: r["v"] for r in found.collect()} == {0: "0", 1: "1", 2: "2", 3: "3", **{k: "4" for k in range(4, 10)}}
    assert all(len(list(p.iterdir())) <= 2 for p in (tmp_path / "sink").glob("bucket=*"))
    assert folds.snapshot(spark, str(tmp_path / "none"), rows((0, "")).schema) is None
    with pytest.raises(Exception):
        folds.snapshot(spark, "nosuchscheme://x/y", rows((0, "")).schema)


def test_states_hold_items_not_in_the_catalog(spark):
    log = actions(table(spark, DATA, "events"))
    assert shelf.wishlist_current(log).where("item_id = -1").count() > 0 and QUERIES["stream_documents"](spark, DATA).where(F.col("doc").contains('"-1"')).count() > 0


def batch_counts(spark, feed, orders):
    """Counts of the feed so far, from scratch."""
    items = orders.select(F.col("o_orderkey").alias("item_id"))
    rows = history.derived_status(items, history.current_dates(feed.dropDuplicates(["seq"])), SNAPSHOT).collect()
    found = {("status", "all"): len(rows)}
    for r in rows:
        date = r["official_date"]
        for key in (("status", r["status"]), ("dated", "undated" if date is None else "dated"), *([("month", f"{date:%Y-%m}")] if date else [])):
            found[key] = found.get(key, 0) + 1
    return found


def test_counts_and_revisions_after_every_batch_and_a_replay(spark, tmp_path):
    source, kept, dates = (str(tmp_path / n) for n in ("events", "counts", "revisions"))
    orders = table(spark, DATA, "orders")
    items = orders.select(F.col("o_orderkey").alias("item_id"))
    add, n = event_files(spark, source, 4, 2)
    shown = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    for i in range(n):
        add(i, i + 1)
        feed = announcements(folds.raw_events(spark, source), orders)
        for again in (False, True):
            if again:  # as after a crash before the batch was marked as done
                for place in (kept, dates):
                    for done in Path(f"{place}-progress/commits").glob(f"*{i}*"):
                        done.unlink()
            counts.keep_counts(feed, items, kept, f"{kept}-progress", buckets=3).awaitTermination()
            revisions.keep_revisions(feed, dates, f"{dates}-progress", buckets=3).awaitTermination()
        so_far = announcements(spark.read.schema(EVENTS).parquet(source), orders).dropDuplicates(["seq"])
        assert {(r["kind"], r["value"]): r["n"] for r in counts.read_counts(spark, kept).collect()} == batch_counts(spark, so_far, orders)
        columns = ("item_id", "revision", "seq", "old_date", "new_date", "days_moved", "direction")
        rows = revisions.read_revisions(spark, dates)
        assert shown(revisions.date_history(rows), *columns) == shown(history.date_history(so_far), *columns)
    for day in ("2023-12-31", "2024-01-07", "2024-01-15", "2024-03-01"):
        want = history.current_dates(so_far.where(F.col("published_on") <= F.lit(day).cast("date")))
        assert shown(revisions.as_of(rows, day), "item_id", "new_date", "seq") == shown(want, "item_id", "new_date", "seq")


def feed_rows(spark, *rows):
    return spark.createDataFrame([(seq, None, item, day, kind, new) for seq, item, day, kind, new in rows], "seq long, ts timestamp, item_id long, published_on string, kind string, new_date string").withColumns({c: F.col(c).cast("date") for c in ("published_on", "new_date")})


def test_signed_changes_by_hand(spark, tmp_path):
    path = str(tmp_path / "counts")
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    counts.begin(items, path)
    counts.begin(items, path)
    old = folds.snapshot(spark, f"{path}/totals", counts.TOTALS)
    assert {tuple(r) for r in old.collect()} == {("status", "all", 3), ("status", "development", 3), ("dated", "undated", 3)}
    new = feed_rows(spark, (5, 1, "2024-01-01", "announcement", "1998-04-15"), (6, 2, "2024-01-01", "announcement", "1999-01-01")).select("item_id", "seq", "new_date")
    by = {tuple(r) for r in counts.changes(new, spark.createDataFrame([(2, 1, None)], counts.DATES)).collect()}
    assert by == {("status", "development", -2), ("status", "released", 1), ("status", "upcoming", 1), ("dated", "undated", -2), ("dated", "dated", 2), ("month", "1998-04", 1), ("month", "1999-01", 1)}
    back = feed_rows(spark, (9, 1, "2024-01-01", "date_change", None)).select("item_id", "seq", "new_date")
    by = {tuple(r) for r in counts.changes(back, new).collect()}
    assert by == {("status", "released", -1), ("status", "development", 1), ("dated", "dated", -1), ("dated", "undated", 1), ("month", "1998-04", -1)}


def test_intervals_by_hand(spark):
    rows = feed_rows(spark, (1, 7, "2024-01-01", "announcement", "2025-01-01"), (3, 7, "2024-01-09", "date_change", "2025-03-01"), (2, 7, "2024-01-05", "interview", None), (2, 7, "2024-01-05", "interview", None), (5, 7, "2024-01-07", "date_change", "2025-02-01"), (4, 7, None, "date_change", "2025-02-02"), (1, 8, "2024-01-03", "announcement", "2025-01-01"))
    found = revisions.intervals(rows.select(*revisions.STATED))
    assert {(r["item_id"], r["seq"]): (r["revision"], str(r["old_date"]), str(r["valid_to"])) for r in found.collect()} == {
        (7, 1): (1, "None", "2024-01-05"), (7, 2): (2, "2025-01-01", "2024-01-07"), (7, 3): (3, "None", "2024-01-07"), (7, 4): (4, "2025-03-01", "2024-01-07"), (7, 5): (5, "2025-02-02", "None"), (8, 1): (1, "None", "None"),
    }
    known = lambda day: {(r["item_id"], r["seq"]) for r in revisions.as_of(found, day).collect()}
    assert [known(f"2024-01-0{d}") for d in (1, 4, 5, 6, 7, 9)] == [{(7, 1)}, {(7, 1), (8, 1)}, {(7, 2), (8, 1)}, {(7, 2), (8, 1)}, {(7, 5), (8, 1)}, {(7, 5), (8, 1)}]
    assert known("2023-12-31") == set()
