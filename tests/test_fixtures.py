"""Hand-made edge cases of filters, orders, dates, state, history, quality and streams."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from almanac.functions import columns as C
from almanac.operators import calendar, history, predicates, quality, ranking, shelf
from almanac.plans.queries import QUERIES
from almanac.sources.schemas import DIMENSIONS, EVENTS
from almanac.sources.tables import actions
from almanac.streaming import folds

ITEMS = "item_id long, ordinal long, title string, original_title string, developer string, publisher string, country string, region string, status string, release_date date, platforms array<string>, genres array<string>, fit string, score_mode string, featured boolean, gameplay decimal(3,1), story decimal(3,1), visuals decimal(3,1), music decimal(3,1)"


def item(i, date=None, featured=None, scores=(5, 5, 5, 5), status="released", **more):
    row = {"item_id": i, "ordinal": i, "title": f"title {i}", "original_title": "o", "developer": "dev", "publisher": "pub", "country": "land", "region": "ASIA", "status": status, "release_date": date and dt.date.fromisoformat(date), "platforms": ["AF"], "genres": ["g"], "fit": "fits", "score_mode": "initial", "featured": featured}
    return {**row, **dict(zip(DIMENSIONS, (Decimal(str(s)) if s is not None else None for s in scores))), **more}


def frame(spark, items):
    names = [f.split(" ")[0] for f in ITEMS.split(", ")]
    return spark.createDataFrame([tuple(x[n] for n in names) for x in items], ITEMS)


def ids(df):
    return [r["item_id"] for r in df.collect()]


def test_orders_and_ties(spark):
    items = frame(spark, [item(1), item(2, "2020-01-01", True), item(3, "2021-01-01", None), item(4, "2021-01-01", False), item(5, None, True), item(6, "2019-01-01", scores=(5, 5, 5, 5.1))])
    order = lambda o: [r["item_id"] for r in ranking.top(items, o, 10).orderBy("rank").collect()]
    assert order("recommend") == [2, 5, 3, 4, 6, 1]
    assert order("date-asc") == [6, 2, 3, 4, 1, 5]
    assert order("date-desc") == [3, 4, 2, 6, 1, 5]
    assert order("score") == [6, 1, 2, 3, 4, 5]
    assert [r["rank"] for r in ranking.top(items, "score", 2).collect()] == [1, 2]


def test_mean_and_its_text(spark):
    rows = frame(spark, [item(1, scores=(8.8, 8.9, 8.9, 8.8)), item(2, scores=(9, 9, 9, 10)), item(3, scores=(9.0, 9.2, 9.4, 9.4)), item(4, scores=(None, 1, 1, 1))])
    got = [(r[0], r[1]) for r in rows.orderBy("item_id").select(C.mean_score(), C.one_decimal(C.mean_score())).collect()]
    assert got == [(Decimal("8.850"), "8.9"), (Decimal("9.250"), "9.3"), (Decimal("9.250"), "9.3"), (None, None)]


@pytest.mark.parametrize(("query", "found"), [("RING", [1, 5]), ("　 ring ", [1, 5]), ("100%", [2]), ("a_c", [3]), ("x  y", [4]), ("le 2o", []), ("fits", []), ("", [1, 2, 3, 4, 5])])
def test_keyword(spark, query, found):
    items = frame(spark, [item(1, title="The Ring"), item(2, title="100% pure"), item(3, developer="A_C"), item(4, country="x  y"), item(5, genres=["other", "String", None], title=None)])
    assert sorted(ids(predicates.select_items(items, query=query))) == found


def test_filters_and_counts(spark):
    items = frame(spark, [item(1, platforms=None), item(2, platforms=["AF", "NO"], region="EUROPE"), item(3, status="upcoming"), item(4, status="development")])
    assert ids(predicates.select_items(items, platform="NO")) == [2]
    assert sorted(ids(predicates.select_items(items, status="all", platform="all", region=None))) == [1, 2, 3, 4]
    assert predicates.result_counts(items, region="EUROPE").first() == (1, 4)
    facets = {r["status"]: r["n"] for r in predicates.facet_counts(items).collect()}
    assert facets == {"all": 4, "released": 2, "upcoming": 1, "development": 1} and sum(facets.values()) == 2 * facets["all"]
    assert ids(predicates.lookup_or_first(items, 3)) == [3] and ids(predicates.lookup_or_first(items, 99)) == [1]


@pytest.mark.parametrize(("as_of", "days", "label"), [("2020-05-08 15:59:59", 2, "D-2"), ("2020-05-08 16:00:00", 1, "D-1"), ("2020-05-09 15:59:59", 1, "D-1"), ("2020-05-09 16:00:00", 0, "TODAY"), ("2020-05-10 15:59:59", 0, "TODAY"), ("2020-05-10 16:00:00", -1, "OUT NOW")])
def test_countdown(spark, as_of, days, label):
    items = frame(spark, [item(1, "2020-05-10"), item(2, None), item(3, "2020-05-10", status="development")])
    got = {r[0]: (r[1], r[2]) for r in items.select("item_id", C.days_to_release("release_date", as_of), C.countdown("status", "release_date", as_of)).collect()}
    assert got == {1: (days, label), 2: (None, "TBA"), 3: (days, "TBA")}


def test_calendar(spark):
    items = frame(spark, [item(1, "2021-02-03"), item(2, "2020-12-01"), item(3, "2021-02-03"), item(4)])
    assert {(r["release_month"], r["n"]) for r in calendar.month_counts(items).collect()} == {("2021-02", 2), ("2020-12", 1)}
    assert ids(calendar.calendar_rows(items).orderBy("release_date", "ordinal")) == [2, 1, 3]
    assert ids(calendar.undated(items)) == [4] and calendar.dated_counts(items).first() == (3, 1)


LOG = "seq long, ts timestamp, user_id long, item_id long, action string, shelf_status string, dimension string, score decimal(3,1), note string"


def log(spark, rows):
    return spark.createDataFrame([(i, None, u, it, a, *(x.get(k) for k in ("shelf_status", "dimension", "score", "note"))) for i, u, it, a, x in rows], LOG)


def test_toggles_count_once_however_delivered(spark):
    rows = [(1, 1, 1, "toggle", {}), (2, 1, 2, "toggle", {}), (3, 1, 2, "toggle", {}), (4, 1, 3, "toggle", {}), (5, 1, 3, "toggle", {}), (6, 1, 3, "toggle", {})]
    assert sorted(ids(shelf.wishlist_current(log(spark, (rows + rows)[::-1])))) == [1, 3]


def test_shelf_ratings_and_notes(spark):
    items = frame(spark, [item(1, scores=(1, 2, 3, 4)), item(2, scores=(5, 6, 7, 8))])
    ten = Decimal("10.0")
    rate = lambda d: {"dimension": d, "score": ten}
    history_ = log(spark, [
        (1, 1, 1, "shelf_set", {"shelf_status": "playing"}), (2, 1, 1, "shelf_set", {"shelf_status": "finished"}), (3, 1, 2, "shelf_set", {"shelf_status": "paused"}), (4, 1, 2, "shelf_clear", {}), (5, 1, -1, "shelf_set", {"shelf_status": "playing"}),
        (6, 1, 1, "rate", rate("story")), (7, 1, 2, "rate", rate("music")), (8, 1, 2, "rate_reset", {}), (9, 2, 2, "rate", rate("gameplay")), (10, 2, 2, "rate_reset", {}), (11, 2, 2, "rate", rate("visuals")), (12, 1, -1, "rate", rate("story")),
        (13, 1, 1, "note", {"note": "x"}), (14, 1, 1, "note", {"note": ""}), (15, 3, 2, "toggle", {}), (16, 3, 2, "note", {"note": "mine"}), (17, 4, 1, "note", {"note": "alone"}),
    ])
    marks, notes, wishes = shelf.shelf_current(history_), shelf.notes_current(history_), shelf.wishlist_current(history_)
    ratings = shelf.ratings_current(history_, items)
    assert {tuple(r) for r in marks.collect()} == {(1, 1, "finished"), (1, -1, "playing")}
    got = {(r["user_id"], r["item_id"]): tuple(r[d] and float(r[d]) for d in DIMENSIONS) for r in ratings.collect()}
    assert got == {(1, 1): (1, 10, 3, 4), (2, 2): (5, 6, 10, 8), (1, -1): (None, 10, None, None)}
    rows = {(r["user_id"], r["item_id"]): r for r in shelf.my_shelf(items, wishes, marks, ratings, notes).collect()}
    assert set(rows) == {(1, 1), (3, 2)}
    assert rows[1, 1]["note_text"] == "fits" and rows[3, 2]["note_text"] == "mine" and rows[3, 2]["shelf_label"] == "愿望单" and rows[1, 1]["shelf_label"] == "已通关"
    stats = {r["user_id"]: tuple(r)[1:] for r in shelf.shelf_stats(items, wishes, marks, ratings).collect()}
    assert stats == {1: (0, 0, 1, 2), 2: (0, 0, 0, 1), 3: (1, 0, 0, 0)}
    assert {tuple(r) for r in shelf.orphans(items, wishes, marks, ratings, notes).collect()} == {("shelf", 1, -1), ("rating", 1, -1)}


def test_documents(spark, tmp_path):
    rows = [(1, '{"wishlist":["5"],"shelf":{"5":"playing"},"notes":{"6":""}}'), (2, "null"), (3, '{"wishlist":["5"'), (4, '{"unknown":1,"ratings":{"7":{"gameplay":9.5}}}'), (5, None), (6, "{}")]
    got = {r["user_id"]: r for r in shelf.decode_documents(spark.createDataFrame(rows, "user_id long, doc string")).collect()}
    assert (got[1]["wishlist"], got[1]["shelf"], got[1]["ratings"], got[1]["notes"], got[1]["corrupt"]) == (["5"], {"5": "playing"}, {}, {"6": ""}, False)
    assert got[3]["corrupt"] and got[3]["wishlist"] == [] and got[2]["wishlist"] == [] and got[5]["notes"] == {} and not got[6]["corrupt"]
    assert got[4]["ratings"]["7"]["gameplay"] == Decimal("9.5") and got[4]["ratings"]["7"]["music"] is None
    docs = spark.createDataFrame(rows[:2], "user_id long, doc string")
    shelf.write_state(docs, str(tmp_path / "state"))
    shelf.write_state(docs.where("user_id = 1").withColumn("doc", F.lit("{}")), str(tmp_path / "state"))
    assert {r["user_id"]: r["doc"] for r in spark.read.parquet(str(tmp_path / "state")).collect()} == {1: "{}", 2: "null"}


def test_history(spark):
    d = dt.date
    rows = [(1, 1, d(2020, 1, 1), "announcement", d(2021, 1, 1)), (2, 1, d(2020, 2, 1), "date_change", d(2021, 3, 1)), (3, 1, d(2020, 3, 1), "rumour", d(2030, 1, 1)), (4, 1, d(2020, 4, 1), "interview", d(2021, 2, 1)), (5, 1, d(2020, 5, 1), "interview", d(2021, 2, 1)), (6, 2, d(2020, 1, 1), "rumour", d(2022, 1, 1)), (7, 3, d(2020, 1, 1), None, None)]
    feed = spark.createDataFrame(rows, "seq long, item_id long, published_on date, kind string, new_date date")
    assert [(r["item_id"], r["new_date"]) for r in history.current_dates(feed).collect()] == [(1, d(2021, 2, 1))]
    assert [r["direction"] for r in history.date_history(feed).orderBy("seq").collect()] == ["first", "delayed", "earlier", "unchanged"]
    assert sorted(r["seq"] for r in history.unverified(feed).collect()) == [3, 6, 7]
    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    got = {r["item_id"]: r["status"] for r in history.derived_status(items, history.current_dates(feed), "2021-02-01").collect()}
    assert got == {1: "released", 2: "development"}


def test_quality_rules_report_every_violation(spark):
    day = dt.date(1998, 4, 15)
    good = {"title": "t", "source_url": "https://x", "checked_at": day, "evidence": "e" * 18, "platforms": ["AF"], "declared_status": "released", "declared_date": day, "region": "ASIA", "signal": "official", "score_mode": "initial", "release_date": day, "date_label": "1998.04.15", **{d: Decimal("5.0") for d in DIMENSIONS}}
    bad = {"Q2": {"title": " "}, "Q3": {"source_url": "HTTPS://x"}, "Q4": {"checked_at": None}, "Q5": {"evidence": "e" * 17}, "Q6": {"platforms": []}, "Q7.story": {"story": Decimal("10.1")}, "Q9": {"declared_date": None}, "Q10": {"declared_date": day + dt.timedelta(1)}, "Q16.region": {"region": "X"}, "Q16.signal": {"signal": None}, "Q16.platforms": {"platforms": ["ZZ"]}, "Q18": {"date_label": "1998-04-15"}}
    more = {"Q8": {"declared_status": "development", "score_mode": "expected"}, "Q11": {"declared_status": "upcoming", "score_mode": "expected"}, "Q17": {"score_mode": "expected"}}
    rows = [("good", good)] + [(k, {**good, **x}) for k, x in (bad | more).items()]
    schema = "item_id string, title string, source_url string, checked_at date, evidence string, platforms array<string>, declared_status string, declared_date date, region string, signal string, score_mode string, release_date date, date_label string, " + ", ".join(f"{d} decimal(3,1)" for d in DIMENSIONS)
    items = spark.createDataFrame([(k, *x.values()) for k, x in rows], schema)
    rules = quality.item_rules("1998-04-15", ("AF",), ("ASIA",))
    found = {(r["key"], r["rule_id"]) for r in quality.violations(items, rules, "item", "item_id").collect()}
    assert found == {(k, k) for k in bad | more}
    counts = {r["rule_id"]: (r["checked"], r["failed"]) for r in quality.summary(items, rules).collect()}
    assert all(counts[k][1] == 1 for k in bad | more) and counts["Q16.status"] == (len(rows), 0)
    clean, rest = quality.publish(items, rules)
    assert [r["item_id"] for r in clean.collect()] == ["good"] and rest.count() == len(rows) - 1
    twice = items.union(items.limit(1))
    assert [r["key"] for r in quality.repeated_keys(twice, "Q1", "item", "item_id").collect()] == ["good"]
    assert quality.too_few(items.limit(3), "Q12", "signal", 4).count() == 1 and quality.too_few(items, "Q12", "signal", 4).count() == 0


def test_stream_equals_batch_with_repeated_and_shuffled_files(spark, tmp_path):
    events = spark.read.schema(EVENTS).parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    events.orderBy(F.rand(3)).repartition(3).write.parquet(folder)
    events.limit(300).write.mode("append").parquet(folder)  # delivered again
    batch = actions(events)
    stream = folds.read_events(spark, folder, files_per_batch=1, late="400 days")
    state = folds.run_to_end(folds.wish_counts(actions(stream)), shelf.KEY, "wishes")
    assert {tuple(r) for r in state.where("n % 2 = 1").select(*shelf.KEY).collect()} == {tuple(r) for r in shelf.wishlist_current(batch).select(*shelf.KEY).collect()}
    marks = folds.run_to_end(folds.shelf_marks(actions(stream)), shelf.KEY, "shelf").where("shelf_status IS NOT NULL")
    assert {tuple(r) for r in marks.collect()} == {tuple(r) for r in shelf.shelf_current(batch).collect()}


def test_registered_streams_equal_batch_on_many_shuffled_files(spark, tmp_path):
    events = spark.read.schema(EVENTS).parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy(F.rand(3)).repartition(20).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    for stream, batch in (("stream_wishlist", "wishlist_current"), ("stream_shelf", "shelf_current"), ("stream_release_date", "current_release_date")):
        got, want = QUERIES[stream](spark, str(tmp_path)), QUERIES[batch](spark, str(tmp_path))
        shared = [c for c in got.columns if c in want.columns]
        assert {tuple(r) for r in got.select(shared).collect()} == {tuple(r) for r in want.select(shared).collect()}, stream


def test_titles_of_unicode_space_and_dates_with_a_line_break_fail(spark):
    rules = {r.rule_id: r.ok for r in [*quality.item_rules("1998-04-15", (), ()), *quality.signal_rules()]}
    titles = spark.createDataFrame([("\u3000",), ("\xa0 \t",), (" a\u3000",)], "title string")
    assert [r[0] for r in titles.select(rules["Q2"]).collect()] == [False, False, True]
    dates = spark.createDataFrame([("2020-01-01\n",), ("2020-01-01",), ("x2020-01-01",)], "date string")
    assert [r[0] for r in dates.select(rules["Q13"]).collect()] == [False, True, False]
