"""All four states of users in one fold of the action log, and what is read off them.

One grouped aggregate by user and item holds wish, mark, note and own scores, so that
shelves, statistics, orphans and documents scan the log once.  It combines before the
shuffle; only the numbers of toggles are told apart in one more step, since toggles
that are delivered twice count once.  Own scores stay sparse here: the catalog's are
filled in where it is joined anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.columns import label, mean_score, or_else
from almanac.operators.shelf import KEY
from almanac.sources.schemas import DIMENSIONS, OWN_SCORES_LABEL, SCORE_MODE_LABELS, SHELF_LABELS, WISHLIST_LABEL

OWN = tuple(f"own_{d}" for d in DIMENSIONS)


def fold(log: DataFrame) -> DataFrame:
    """(user_id, item_id, wished, wish_seq, shelf_status, noted, note, rated, four own scores) of pairs with any state.

    wished: toggled an odd number of times; shelf_status: the last one, if it wasn't
    cleared since; note: the last one, which may be empty; own scores: the last change
    of each dimension after the last reset.
    """
    did = lambda *names: F.col("action").isin(*names)
    last = lambda when, *values: F.max(F.when(when, F.struct("seq", *values)))
    folded = log.groupBy(*KEY).agg(
        F.count_distinct(F.when(did("toggle"), F.col("seq"))).alias("_toggles"), F.max(F.when(did("toggle"), F.col("seq"))).alias("wish_seq"),
        last(did("shelf_set", "shelf_clear"), "shelf_status").alias("_mark"), last(did("note"), "note").alias("_note"),
        F.coalesce(F.max(F.when(did("rate_reset"), F.col("seq"))), F.lit(-1)).alias("_reset"), *(last(did("rate") & (F.col("dimension") == d), "score").alias(f"_{d}") for d in DIMENSIONS),
    )
    own = [F.when(F.col(f"_{d}.seq") > F.col("_reset"), F.col(f"_{d}.score")).alias(o) for d, o in zip(DIMENSIONS, OWN)]
    rows = folded.select(*KEY, (F.col("_toggles") % 2 == 1).alias("wished"), "wish_seq", F.col("_mark.shelf_status").alias("shelf_status"), F.col("_note").isNotNull().alias("noted"), F.col("_note.note").alias("note"), *own)
    rows = rows.withColumn("rated", F.coalesce(*OWN).isNotNull())
    return rows.where(F.col("wished") | F.col("shelf_status").isNotNull() | F.col("noted") | F.col("rated"))


def on_shelf(state: DataFrame) -> DataFrame:
    """Pairs on a wishlist or shelf; ratings and notes alone don't count."""
    return state.where(F.col("wished") | F.col("shelf_status").isNotNull())


def scores(own: tuple[str, ...] = OWN) -> list[Column]:
    """The scores that hold: of a rated item the user's, filled up from the catalog's, else the catalog's."""
    return [F.coalesce(o, d).alias(d) for o, d in zip(own, DIMENSIONS)]


def mode_label() -> Column:
    return F.when(F.coalesce("rated", F.lit(False)), OWN_SCORES_LABEL).otherwise(label("score_mode", SCORE_MODE_LABELS)).alias("mode_label")


def my_shelf(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """The items of every user's shelf with label, note and scores; items that aren't in the catalog are left out."""
    rows = on_shelf(state).join(catalog.select("item_id", "title", "fit", *DIMENSIONS), "item_id")
    shown = rows.select(*KEY, F.coalesce(label("shelf_status", SHELF_LABELS), F.lit(WISHLIST_LABEL)).alias("shelf_label"), "title", or_else("note", "fit").alias("note_text"), *scores())
    return shown.withColumn("mean", mean_score())


def shelf_stats(items: DataFrame, state: DataFrame) -> DataFrame:
    """Per user with any wish, mark or rating: wishlist and ratings count all ids, playing and finished only items of the catalog."""
    known = items.select("item_id", F.lit(True).alias("_known"))
    rows = state.where(F.col("wished") | F.col("shelf_status").isNotNull() | F.col("rated")).join(known, "item_id", "left")
    marked = lambda status: F.count_if(F.col("_known") & (F.col("shelf_status") == status)).alias(status)
    return rows.groupBy("user_id").agg(F.count_if("wished").alias("wishlist_size"), marked("playing"), marked("finished"), F.count_if("rated").alias("rated"))


def orphans(items: DataFrame, state: DataFrame) -> DataFrame:
    """(kind, user_id, item_id): state on items that aren't in the catalog."""
    kinds = F.array_compact(F.array(F.when(F.col("wished"), F.lit("wishlist")), F.when(F.col("shelf_status").isNotNull(), F.lit("shelf")), F.when(F.col("rated"), F.lit("rating")), F.when(F.col("noted"), F.lit("note"))))
    return state.join(items.select("item_id"), "item_id", "left_anti").select(F.explode(kinds).alias("kind"), *KEY)


def documents(state: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, doc): each user's whole state as one JSON document; parts without entries are absent."""
    rows = state.join(catalog.select("item_id", *DIMENSIONS), "item_id", "left").select("user_id", F.col("item_id").cast("string").alias("item"), "item_id", "wished", "wish_seq", "shelf_status", "noted", "note", "rated", F.struct(*scores()).alias("scores"))
    listed = lambda when, *values: F.sort_array(F.collect_list(F.when(when, F.struct(*values))))
    entry = lambda value: (F.col("item").alias("key"), F.col(value).alias("value"))
    parts = rows.groupBy("user_id").agg(listed(F.col("wished"), "wish_seq", "item_id").alias("wishlist"), listed(F.col("shelf_status").isNotNull(), *entry("shelf_status")).alias("shelf"), listed(F.col("rated"), *entry("scores")).alias("ratings"), listed(F.col("noted"), *entry("note")).alias("notes"))
    some = lambda part, value: F.when(F.size(part) > 0, value).alias(part)
    wishes = some("wishlist", F.transform("wishlist", lambda x: x["item_id"].cast("string")))
    return parts.select("user_id", F.to_json(F.struct(wishes, *(some(p, F.map_from_entries(p)) for p in ("shelf", "ratings", "notes")))).alias("doc"))
