"""Personal state: folds of the action log, joins with the catalog, state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.columns import label, mean_score, or_else
from almanac.sources.schemas import DIMENSIONS, OWN_SCORES_LABEL, SCORE_MODE_LABELS, SHELF_LABELS, STATE, WISHLIST_LABEL

KEY = ["user_id", "item_id"]


def once(log: DataFrame) -> DataFrame:
    """Each event once, however often it was delivered."""
    return log.dropDuplicates(["seq"])


def wishlist_current(log: DataFrame) -> DataFrame:
    """(user_id, item_id, seq): items that were toggled an odd number of times; seq of the last toggle."""
    toggles = once(log).where(F.col("action") == "toggle").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    return toggles.where("n % 2 = 1").drop("n")


def shelf_current(log: DataFrame) -> DataFrame:
    """(user_id, item_id, shelf_status): the last status set, if it wasn't cleared since."""
    marks = log.where(F.col("action").isin("shelf_set", "shelf_clear"))
    return marks.groupBy(*KEY).agg(F.max_by("shelf_status", "seq").alias("shelf_status")).where("shelf_status IS NOT NULL")


def notes_current(log: DataFrame) -> DataFrame:
    """(user_id, item_id, note): the last note, which may be empty."""
    return log.where(F.col("action") == "note").groupBy(*KEY).agg(F.max_by("note", "seq").alias("note"))


def ratings_current(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """(user_id, item_id, four scores): overrides that hold now.

    The first change after a reset copies the catalog's scores; later changes
    replace one dimension each.  What no change touched is the catalog's.
    """
    rates = log.where(F.col("action").isin("rate", "rate_reset"))
    # One pass: the last reset, and the last change of each dimension with its place.
    last = [F.max(F.when((F.col("action") == "rate") & (F.col("dimension") == d), F.struct("seq", "score"))).alias(f"_{d}") for d in DIMENSIONS]
    reset = F.coalesce(F.max(F.when(F.col("action") == "rate_reset", F.col("seq"))), F.lit(-1)).alias("_reset")
    folded = rates.groupBy(*KEY).agg(reset, *last)
    after = {d: F.when(F.col(f"_{d}.seq") > F.col("_reset"), F.col(f"_{d}.score")) for d in DIMENSIONS}
    own = folded.select(*KEY, *(c.alias(f"_{d}") for d, c in after.items())).where(" OR ".join(f"_{d} IS NOT NULL" for d in DIMENSIONS))
    return own.join(catalog.select("item_id", *DIMENSIONS), "item_id", "left").select(*KEY, *(F.coalesce(f"_{d}", d).alias(d) for d in DIMENSIONS))


def personal_ids(wishlist: DataFrame, shelf: DataFrame) -> DataFrame:
    """Items on a user's wishlist or shelf; ratings and notes alone don't count."""
    return wishlist.select(*KEY).union(shelf.select(*KEY)).distinct()


def effective_scores(items: DataFrame, ratings: DataFrame, on: list[str] | None = None) -> DataFrame:
    """items with the user's whole set of scores, or else the catalog's, and the mode's label."""
    own = ratings.select(*(on or KEY), F.struct(*DIMENSIONS).alias("_own"))
    joined = items.join(own, on or KEY, "left")
    scores = F.coalesce("_own", F.struct(*DIMENSIONS))
    mode = F.when(F.col("_own").isNotNull(), OWN_SCORES_LABEL).otherwise(label("score_mode", SCORE_MODE_LABELS))
    return joined.withColumns({**{d: scores[d] for d in DIMENSIONS}, "mode_label": mode}).drop("_own")


def my_shelf(catalog: DataFrame, wishlist: DataFrame, shelf: DataFrame, ratings: DataFrame, notes: DataFrame) -> DataFrame:
    """The items of every user's shelf with label, note and scores; items that aren't in the catalog are left out."""
    rows = personal_ids(wishlist, shelf).join(catalog, "item_id").join(shelf, KEY, "left").join(notes, KEY, "left")
    return effective_scores(rows, ratings).select(*KEY, F.coalesce(label("shelf_status", SHELF_LABELS), F.lit(WISHLIST_LABEL)).alias("shelf_label"), "title", or_else("note", "fit").alias("note_text"), *DIMENSIONS, mean_score().alias("mean"))


def wish_flags(catalog: DataFrame, wishlist: DataFrame, user_id: int) -> DataFrame:
    """Every item, and whether this user wishes for it."""
    mine = wishlist.where(F.col("user_id") == user_id).select("item_id", F.lit(True).alias("_wished"))
    return catalog.join(mine, "item_id", "left").withColumn("wished", F.coalesce("_wished", F.lit(False))).drop("_wished")


def shelf_stats(catalog: DataFrame, wishlist: DataFrame, shelf: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per user: wishlist and ratings count all ids, playing and finished only items of the catalog."""
    known = catalog.select("item_id", F.lit(True).alias("_known"))
    marks = shelf.join(known, "item_id", "left").select("user_id", F.when(F.col("_known"), F.col("shelf_status")).alias("tag"))
    rows = wishlist.select("user_id", F.lit("wish").alias("tag")).union(ratings.select("user_id", F.lit("rating").alias("tag"))).union(marks)
    count = lambda tag: F.count_if(F.col("tag") == tag)
    return rows.groupBy("user_id").agg(count("wish").alias("wishlist_size"), count("playing").alias("playing"), count("finished").alias("finished"), count("rating").alias("rated"))


def orphans(catalog: DataFrame, wishlist: DataFrame, shelf: DataFrame, ratings: DataFrame, notes: DataFrame) -> DataFrame:
    """State on items that aren't in the catalog."""
    parts = [df.select(F.lit(kind).alias("kind"), *KEY) for kind, df in (("wishlist", wishlist), ("shelf", shelf), ("rating", ratings), ("note", notes))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).join(catalog.select("item_id"), "item_id", "left_anti").select("kind", *KEY)


def item_dossier(catalog: DataFrame, state: dict[str, DataFrame], user_id: int, item_id: int) -> DataFrame:
    """One item with everything that a user sees of it."""
    at = (F.col("user_id") == user_id) & (F.col("item_id") == item_id)
    mine = {name: df.where(at).drop("user_id") for name, df in state.items()}
    row = catalog.where(F.col("item_id") == item_id)
    row = effective_scores(row, mine["ratings"], ["item_id"]).join(mine["notes"], "item_id", "left").join(mine["shelf"], "item_id", "left")
    row = row.join(mine["wishlist"].select("item_id", F.lit(True).alias("_wished")), "item_id", "left")
    return row.withColumns({"mean": mean_score(), "note": F.coalesce("note", F.lit("")), "wished": F.coalesce("_wished", F.lit(False)), "shelf_label": label("shelf_status", SHELF_LABELS)}).drop("_wished")


def _map(df: DataFrame, name: str, value: Column) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(F.col("item_id").cast("string").alias("key"), value.alias("value"))))
    return df.groupBy("user_id").agg(F.map_from_entries(entries).alias(name))


def state_documents(wishlist: DataFrame, shelf: DataFrame, ratings: DataFrame, notes: DataFrame) -> DataFrame:
    """(user_id, doc): each user's whole state as one JSON document."""
    wishes = wishlist.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "item_id"))), lambda x: x["item_id"].cast("string")).alias("wishlist"))
    joined = wishes.join(_map(shelf, "shelf", F.col("shelf_status")), "user_id", "full").join(_map(ratings, "ratings", F.struct(*DIMENSIONS)), "user_id", "full").join(_map(notes, "notes", F.col("note")), "user_id", "full")
    return joined.select("user_id", F.to_json(F.struct("wishlist", "shelf", "ratings", "notes")).alias("doc"))


def decode_documents(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, kept columns, wishlist, shelf, ratings, notes, corrupt): absent parts are empty, a corrupt document is an empty state."""
    state = F.from_json("doc", STATE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = documents.withColumn("_s", state).withColumn("corrupt", F.col("_s").isNull() | F.col("_s._corrupt").isNotNull())
    empty = {f.name: F.array().cast(f.dataType) if f.name == "wishlist" else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{f.dataType.valueType.simpleString()}>")) for f in STATE.fields[:4]}
    return rows.select("user_id", *keep, *(F.when(F.col("corrupt") | F.col(f"_s.{n}").isNull(), e).otherwise(F.col(f"_s.{n}")).alias(n) for n, e in empty.items()), "corrupt")


def exploded_state(decoded: DataFrame) -> DataFrame:
    """(user_id, kind, item_id, value): one row for each entry of each document, from one pass."""
    none = F.lit(None).cast("string")
    entry = lambda kind, item, value: F.struct(F.lit(kind).alias("kind"), item.alias("item_id"), value.alias("value"))
    entries = lambda kind, value: F.transform(F.map_entries({"rating": "ratings", "note": "notes"}.get(kind, kind)), lambda e: entry(kind, e["key"], value(e["value"])))
    scores = lambda s: F.concat_ws("/", *(F.coalesce(s[d].cast("string"), F.lit("-")) for d in DIMENSIONS))
    every = F.concat(F.transform("wishlist", lambda x: entry("wishlist", x, none)), entries("shelf", lambda v: v), entries("rating", scores), entries("note", lambda v: v))
    return decoded.select("user_id", F.explode(every).alias("_e")).select("user_id", "_e.*")


def write_state(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace whole documents, in the buckets of users that are there; other buckets stay as they are."""
    bucketed = documents.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    bucketed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, doc) as write_state has left them."""
    return spark.read.schema("user_id long, doc string, bucket long").parquet(path).select("user_id", "doc")


def set_apart(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The decoded states (user_id, wishlist, shelf, ratings, notes), and the documents (user_id, doc) that can't be read.

    One pass writes both to folders of their own below a fresh path; unlike
    decode_documents, which reads a corrupt document as an empty state, it loses none.
    """
    decoded = decode_documents(documents, keep=("doc",))
    kept = decoded.withColumn("doc", F.when(F.col("corrupt"), F.col("doc")))
    kept.write.partitionBy("corrupt").parquet(path)
    found = documents.sparkSession.read.schema(kept.schema).parquet(path)
    return found.where(~F.col("corrupt")).drop("corrupt", "doc"), found.where("corrupt").select("user_id", "doc")
