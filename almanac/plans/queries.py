"""Every query by name: (spark, sf_dir) -> DataFrame.

Dates and decimals leave as text and doubles, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import columns as C
from almanac.operators import bitmaps, calendar, history, predicates, quality, ranking, shelf, state, trigrams
from almanac.sources import tables
from almanac.sources.schemas import DIMENSIONS, PLATFORM_LABELS, SCORE_MODE_LABELS, STATUS_LABELS
from almanac.sources.storage import new_folder, table, written
from almanac.sources.stored import StoredCatalog, store_catalog
from almanac.streaming import counts, documents, folds, revisions

# What a caller asks for.
USER, ITEM, MISSING_ITEM = 7, 3, -1
AS_OF = "1998-04-15 03:00:00"
FILTERS = {"status": "released", "platform": "RF", "region": "ASIA", "query": "  RING "}
SHORT = "B2"
KNOWN_ON = "2024-01-15"
SINCE, UNTIL, LEAST_SCORE = "1997-01-01", "1998-12-31", 6.5
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def _joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def _doubles(names=DIMENSIONS) -> list[Column]:
    return [F.col(d).cast("double").alias(d) for d in names]


def _brief(items: DataFrame) -> DataFrame:
    return items.select("item_id", "title", "developer", "region", "status", _text("release_date"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.actions(table(spark, sf_dir, "events"))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.announcements(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders"))


def _state(log: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    return {"wishlist": shelf.wishlist_current(log), "shelf": shelf.shelf_current(log), "ratings": shelf.ratings_current(log, items), "notes": shelf.notes_current(log)}


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's ids, which need no join."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))


# Scans and projections


@query
def catalog_scan(spark, sf_dir):
    items = tables.catalog(spark, sf_dir)
    return items.select("item_id", "ordinal", "title", "original_title", "developer", "publisher", "country", "region", "status", "signal", _text("release_date"), "date_label", _joined("platforms"), _joined("genres"), *_doubles(), "score_mode", "featured")


@query
def signal_scan(spark, sf_dir):
    return _feed(spark, sf_dir).select("seq", "item_id", _text("published_on"), "kind", _text("new_date"))


@query
def source_ledger(spark, sf_dir):
    items = tables.catalog(spark, sf_dir, sources=True)
    return items.select("item_id", "title", "developer", "evidence", C.label("status", STATUS_LABELS).alias("status_label"), _text("checked_at"), "source_label", "source_url")


@query
def card_projection(spark, sf_dir):
    mine = state.fold(_log(spark, sf_dir).where(F.col("user_id") == USER)).drop("user_id", "note")
    rows = tables.catalog(spark, sf_dir).join(mine, "item_id", "left")
    rows = rows.withColumns({**dict(zip(DIMENSIONS, state.scores())), "wished": F.coalesce("wished", F.lit(False))})
    genres = F.array_join(F.slice("genres", 1, 3), ",").alias("genres")
    return rows.select("item_id", "country", "signal", "date_label", "title", "original_title", "summary", genres, C.labels_joined("platforms", PLATFORM_LABELS).alias("platform_labels"), *_doubles(), C.label("status", STATUS_LABELS).alias("status_label"), C.countdown("status", "release_date", AS_OF).alias("countdown"), "wished")


@query
def platform_explode(spark, sf_dir):
    labels = F.broadcast(spark.createDataFrame(list(PLATFORM_LABELS.items()), "platform string, platform_label string"))  # one row a code
    return tables.catalog(spark, sf_dir).select("item_id", F.explode("platforms").alias("platform")).join(labels, "platform", "left").select("item_id", "platform", "platform_label")


@query
def scalar_formats(spark, sf_dir):
    items = tables.catalog(spark, sf_dir)
    date = lambda f, n: F.date_format("release_date", f).alias(n)
    index = F.concat(F.upper(F.substring(F.lpad(F.col("item_id").cast("string"), 2, "0"), 1, 2)), F.lit(" / "), F.substring("date_label", 1, 4)).alias("art_index")
    return items.select("item_id", date("yyyy.MM.dd", "dotted"), date("yyyy-MM", "month"), date("yyyy", "year"), date("MM", "month_number"), date("dd", "day"), index, F.array_join("platforms", " · ").alias("platforms"), C.one_decimal(C.mean_score()).alias("mean_text"))


@query
def countdown(spark, sf_dir):
    items = tables.catalog(spark, sf_dir, details=False)
    return items.select("item_id", C.days_to_release("release_date", AS_OF).cast("bigint").alias("days"), C.countdown("status", "release_date", AS_OF).alias("countdown"))


# Filters and lookups


@query
def radar(spark, sf_dir):
    plain = {k: v for k, v in FILTERS.items() if k not in ("platform", "query")}  # what orders and customers decide
    some = predicates.select_items(tables.catalog(spark, sf_dir, details=False, status=plain["status"]), **plain)
    found = ranking.top(predicates.select_items(tables.with_details(spark, sf_dir, some, some.select("item_id")), **FILTERS), "recommend", 20)
    return found.select("rank", "item_id", "title", "developer", "region", "status", _text("release_date"), "featured", C.mean_score().cast("double").alias("mean"))


@query
def filter_status(spark, sf_dir):
    return _brief(tables.catalog(spark, sf_dir, status="upcoming"))


@query
def filter_platform(spark, sf_dir):
    return _brief(predicates.select_items(tables.catalog(spark, sf_dir), platform="NO"))


@query
def filter_region(spark, sf_dir):
    return _brief(predicates.select_items(tables.catalog(spark, sf_dir), region="EUROPE"))


@query
def search_keyword(spark, sf_dir):
    return _brief(predicates.select_items(tables.catalog(spark, sf_dir), query="　Econ "))


@query
def filter_date_score_range(spark, sf_dir):
    return _brief(predicates.in_ranges(tables.catalog(spark, sf_dir), SINCE, UNTIL, LEAST_SCORE))


@query
def undated_items(spark, sf_dir):
    return calendar.undated(tables.catalog(spark, sf_dir)).select("item_id", "title", "status")


@query
def lookup_or_first(spark, sf_dir):
    items = tables.catalog(spark, sf_dir)
    one = lambda key: predicates.lookup_or_first(items, key).select(F.lit(key).cast("bigint").alias("asked"), "item_id", "title")
    return one(ITEM).union(one(MISSING_ITEM))


@query
def item_dossier(spark, sf_dir):
    log = _log(spark, sf_dir).where((F.col("user_id") == USER) & (F.col("item_id") == ITEM))
    items = tables.catalog(spark, sf_dir, sources=True).where(F.col("item_id") == ITEM)
    row = shelf.item_dossier(items, _state(log, items), USER, ITEM)
    return row.select("item_id", "title", "original_title", "developer", "country", "summary", "fit", "caution", *_doubles(), F.col("mean").cast("double").alias("mean"), "mode_label", "note", "shelf_label", "wished", "source_label", "source_url", _text("checked_at"), "evidence")


# Stored tables and indexes, built from the whole catalog


def _stored(spark, sf_dir) -> StoredCatalog:
    return store_catalog(tables.catalog(spark, sf_dir), new_folder(spark, "catalog"))


def _index(spark, stored: StoredCatalog, build: Callable[[DataFrame, str], None]) -> str:
    path = new_folder(spark, "index")
    build(stored.items(spark), path)
    return path


@query
def lookup_stored(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    one = lambda key: stored.lookup_or_first(spark, key).select(F.lit(key).cast("bigint").alias("asked"), "item_id", "title")
    return one(ITEM).union(one(MISSING_ITEM))


@query
def search_trigrams(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return _brief(trigrams.search(spark, _index(spark, stored, trigrams.build), stored, "　Econ "))


@query
def search_short_keyword(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    return _brief(trigrams.search(spark, _index(spark, stored, trigrams.build), stored, SHORT))


@query
def bitmap_counts(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    filters = dict(FILTERS)
    found = bitmaps.of_items(trigrams.search(spark, _index(spark, stored, trigrams.build), stored, filters.pop("query")))
    return bitmaps.result_counts(spark.read.parquet(_index(spark, stored, bitmaps.build)), found, **filters)


@query
def bitmap_facets(spark, sf_dir):
    index = spark.read.parquet(_index(spark, _stored(spark, sf_dir), bitmaps.build))
    parts = []
    for facet in bitmaps.FACETS:
        parts.append(bitmaps.facet_counts(index, facet).select(F.lit(facet).alias("facet"), F.lit(False).alias("filtered"), F.col(facet).alias("value"), "n"))
        others = {k: v for k, v in FILTERS.items() if k in bitmaps.FACETS and k != facet}
        parts.append(bitmaps.facet_counts(index, facet, **others).select(F.lit(facet), F.lit(True), facet, "n"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


# Orders


def _ordered(name: str, order: str) -> None:
    def run(spark, sf_dir):
        if order == "score":  # which needs the scores of all items
            found = ranking.top(tables.catalog(spark, sf_dir), order, 20)
        else:
            keys = ranking.top(tables.catalog(spark, sf_dir, details=False), order, 20)
            found = tables.with_details(spark, sf_dir, keys, F.broadcast(keys.select("item_id")))  # 20 rows
        return found.select("rank", "item_id", "title", _text("release_date"), "featured", C.mean_score().cast("double").alias("mean"))

    run.__name__ = name
    query(run)


_ordered("sort_recommend_topk", "recommend")
_ordered("sort_date_asc_topk", "date-asc")
_ordered("sort_date_desc_topk", "date-desc")
_ordered("sort_score_topk", "score")


@query
def signal_latest(spark, sf_dir):
    return ranking.latest_signals(_feed(spark, sf_dir), 4).select("display_index", "seq", "item_id", F.date_format("published_on", "yyyy.MM.dd").alias("published"), "kind")


# Aggregates and the calendar


@query
def score_mean(spark, sf_dir):
    return tables.catalog(spark, sf_dir).select("item_id", C.mean_score().cast("double").alias("mean"))


@query
def effective_scores(spark, sf_dir):
    items = tables.catalog(spark, sf_dir)
    pairs = state.on_shelf(state.fold(_log(spark, sf_dir))).join(items.select("item_id", "score_mode", *DIMENSIONS), "item_id")
    rows = pairs.select(*shelf.KEY, *state.scores(), state.mode_label())
    return rows.select("user_id", "item_id", *_doubles(), C.mean_score().cast("double").alias("mean"), *((F.col(d) * 10).cast("double").alias(f"{d}_bar") for d in DIMENSIONS), "mode_label")


@query
def result_counts(spark, sf_dir):
    return predicates.result_counts(tables.catalog(spark, sf_dir), **FILTERS)


@query
def facet_status(spark, sf_dir):
    return predicates.facet_counts(tables.catalog(spark, sf_dir, details=False))


@query
def dated_counts(spark, sf_dir):
    return calendar.dated_counts(tables.catalog(spark, sf_dir, details=False))


@query
def release_calendar(spark, sf_dir):
    return calendar.calendar_rows(tables.catalog(spark, sf_dir)).withColumn("release_date", _text("release_date"))


@query
def calendar_month_counts(spark, sf_dir):
    return calendar.month_counts(tables.catalog(spark, sf_dir, details=False))


# Personal state


@query
def wishlist_current(spark, sf_dir):
    return shelf.wishlist_current(_log(spark, sf_dir))


@query
def shelf_current(spark, sf_dir):
    return shelf.shelf_current(_log(spark, sf_dir))


@query
def ratings_current(spark, sf_dir):
    return shelf.ratings_current(_log(spark, sf_dir), tables.catalog(spark, sf_dir)).select(*shelf.KEY, *_doubles())


@query
def notes_current(spark, sf_dir):
    return shelf.notes_current(_log(spark, sf_dir)).withColumn("note_length", F.length("note").cast("bigint"))


@query
def personal_ids(spark, sf_dir):
    log = _log(spark, sf_dir)
    return shelf.personal_ids(shelf.wishlist_current(log), shelf.shelf_current(log))


@query
def my_shelf(spark, sf_dir):
    return state.my_shelf(tables.catalog(spark, sf_dir), state.fold(_log(spark, sf_dir))).select("user_id", "item_id", "shelf_label", "title", "note_text", *_doubles([*DIMENSIONS, "mean"]))


@query
def wish_flag(spark, sf_dir):
    items = tables.catalog(spark, sf_dir, details=False)
    return shelf.wish_flags(items, shelf.wishlist_current(_log(spark, sf_dir)), USER).select("item_id", "wished")


@query
def shelf_stats(spark, sf_dir):
    return state.shelf_stats(_ids(spark, sf_dir), state.fold(_log(spark, sf_dir)))


@query
def state_orphans(spark, sf_dir):
    return state.orphans(_ids(spark, sf_dir), state.fold(_log(spark, sf_dir)))


@query
def state_encode(spark, sf_dir):
    return state.documents(state.fold(_log(spark, sf_dir)), tables.catalog(spark, sf_dir))


def _broken_documents(spark, sf_dir) -> DataFrame:
    """The state documents, of which every seventh user's is cut off in the middle."""
    docs = state_encode(spark, sf_dir)
    return docs.withColumn("doc", F.when(F.col("user_id") % 7 == 0, F.expr("left(doc, length(doc) - 2)")).otherwise(F.col("doc")))


@query
def state_decode(spark, sf_dir):
    decoded = shelf.decode_documents(_broken_documents(spark, sf_dir))
    sizes = [F.size(n).cast("bigint").alias(f"n_{n}") for n in ("wishlist", "shelf", "ratings", "notes")]
    return decoded.select("user_id", *sizes, "corrupt")


@query
def state_explode(spark, sf_dir):
    return shelf.exploded_state(shelf.decode_documents(_broken_documents(spark, sf_dir)))


@query
def state_write(spark, sf_dir):
    path = new_folder(spark, "state")
    shelf.write_state(state_encode(spark, sf_dir), path)
    return shelf.read_state(spark, path)


@query
def state_quarantine(spark, sf_dir):
    return shelf.set_apart(_broken_documents(spark, sf_dir), new_folder(spark, "state"))[1]


# Change history


@query
def current_release_date(spark, sf_dir):
    return history.current_dates(_feed(spark, sf_dir)).select("item_id", _text("new_date"), "kind", _text("published_on"), "seq")


@query
def release_date_history(spark, sf_dir):
    return _history(history.date_history(_feed(spark, sf_dir)))


def _history(rows: DataFrame) -> DataFrame:
    return rows.select("item_id", "revision", "seq", "kind", _text("old_date"), _text("new_date"), F.col("days_moved").cast("bigint").alias("days_moved"), "direction")


@query
def unverified_claims(spark, sf_dir):
    return history.unverified(_feed(spark, sf_dir)).select("seq", "item_id", "kind", _text("published_on"), _text("new_date"))


@query
def derive_status(spark, sf_dir):
    items = tables.catalog(spark, sf_dir, details=False)
    return history.derived_status(items, history.current_dates(_feed(spark, sf_dir)), "1998-04-15").select("item_id", _text("official_date"), "status")


# Data quality


def _quality(spark, sf_dir):
    items = tables.catalog(spark, sf_dir, sources=True)
    signals = tables.with_page(_feed(spark, sf_dir), table(spark, sf_dir, "pages"), F.col("seq"))
    signals = signals.select("seq", F.when(F.col("seq") % 11 == 0, F.date_format("published_on", "yyyy.MM.dd")).otherwise(F.col("published_on").cast("string")).alias("date"), F.col("url").alias("source_url"), F.concat_ws(" ", "kind", F.col("item_id").cast("string")).alias("detail"), "kind")
    return items, signals, quality.item_rules(tables.SNAPSHOT, tuple(PLATFORM_LABELS), REGIONS), quality.signal_rules()


@query
def dq_violations(spark, sf_dir):
    items, signals, on_items, on_signals = _quality(spark, sf_dir)
    found = quality.violations(items, on_items, "item", "item_id").union(quality.violations(signals, on_signals, "signal", "seq"))
    return found.union(quality.repeated_keys(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "item_id"), "Q1", "item", "item_id")).union(quality.too_few(signals, "Q12", "signal", 4))


@query
def dq_summary(spark, sf_dir):
    items, signals, on_items, on_signals = _quality(spark, sf_dir)
    ids = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.count("*").alias("n")).agg(F.lit("Q1").alias("rule_id"), F.count("*").alias("checked"), F.count_if(F.col("n") > 1).alias("failed"))
    size = signals.agg(F.lit("Q12").alias("rule_id"), F.lit(1).cast("bigint").alias("checked"), F.count_if(F.lit(True)).alias("n")).select("rule_id", "checked", F.when(F.col("n") < 4, 1).otherwise(0).cast("bigint").alias("failed"))
    return quality.summary(items, on_items).union(quality.summary(signals, on_signals)).union(ids).union(size)


@query
def dq_publish(spark, sf_dir):
    items, _, on_items, _ = _quality(spark, sf_dir)
    good, bad, _ = quality.divert(items, on_items, new_folder(spark, "published"))
    return good.select("item_id", F.lit(True).alias("published"), F.lit("").alias("broken")).union(bad.select("item_id", F.lit(False), F.array_join("broken", ",")))


@query
def dq_publish_summary(spark, sf_dir):
    items, signals, on_items, on_signals = _quality(spark, sf_dir)
    found = [r for rows, rules in ((items, on_items), (signals, on_signals)) for r in quality.divert(rows, rules, new_folder(spark, "published"))[2]]
    return spark.createDataFrame(found, "rule_id string, checked bigint, failed bigint")


# Streams, run to the end of what is there


@query
def stream_wishlist(spark, sf_dir):
    return folds.stream_wishlist(spark, f"{sf_dir}/events.parquet")


@query
def stream_shelf(spark, sf_dir):
    return folds.stream_shelf(spark, f"{sf_dir}/events.parquet")


@query
def stream_release_date(spark, sf_dir):
    return folds.stream_release_date(spark, sf_dir).select("item_id", _text("new_date"), "kind", "seq")


@query
def stream_documents(spark, sf_dir):
    scores = written(tables.catalog(spark, sf_dir).select("item_id", *DIMENSIONS), "scores")
    return documents.stream_documents(spark, folds.raw_events(spark, f"{sf_dir}/events.parquet"), scores)


@query
def stream_counts(spark, sf_dir):
    return counts.stream_counts(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "orders"), _ids(spark, sf_dir))


@query
def stream_revisions(spark, sf_dir):
    return _history(revisions.date_history(revisions.stream_revisions(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "orders"))))


@query
def release_date_as_of(spark, sf_dir):
    known = revisions.as_of(revisions.stream_revisions(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "orders")), KNOWN_ON)
    return known.select("item_id", _text("new_date"), "kind", _text("published_on"), "seq")
