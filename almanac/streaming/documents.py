"""A stream that keeps every user's whole state as one document.

Each user has one state: toggles, shelf marks, ratings and notes by item.  It holds
what an action's place in the log decides, so events may come in any order and more
than once: the last mark, note, reset and change of a dimension win by their numbers;
toggles are counted once each, by the numbers seen.  A batch touches the states of
its own users alone and emits all entries of each; the JVM fills ratings from the
catalog (the first change copies its scores) and writes whole documents, bucket by
bucket, under the batch's number.

Defined results: an event without a user or item and an unknown action are left out; a
user whose state is empty again has no document.  With `late`, the numbers of toggles
older than the watermark are let go, and toggles that come later than it are dropped,
since they can't be told from repeated ones; all other actions are taken however late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almanac.operators import shelf
from almanac.sources.schemas import DIMENSIONS
from almanac.sources.storage import new_folder
from almanac.sources.tables import actions
from almanac.streaming.folds import BUCKETS, merge_into, snapshot

ACTIONS = ("toggle", "shelf_set", "shelf_clear", "rate", "rate_reset", "note")
ENTRIES = "user_id long, kind string, item_id long, seq long, text string, " + ", ".join(f"{d} string" for d in DIMENSIONS)
DOCUMENT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("doc", T.StringType())])


def take(state: dict, action: str, item: str, seq: int, at: int, text: str | None, dimension: str | None, score: str | None, watermark: int | None) -> None:
    """One action into a user's state, which any order of actions leaves the same.

    wishes: item -> [toggles, last number, {number: time} of those that may come again];
    marks, notes: item -> [number, text]; ratings: item -> {dimension or "reset": [number, score]}.
    """
    if action == "toggle":
        if watermark is not None and at < watermark:
            return
        wish = state["wishes"].setdefault(item, [0, -1, {}])
        if str(seq) not in wish[2]:
            wish[2][str(seq)] = at
            wish[0] += 1
            wish[1] = max(wish[1], seq)
        return
    if action in ("rate", "rate_reset"):
        slot, key, value = state["ratings"].setdefault(item, {}), dimension if action == "rate" else "reset", score
    else:
        slot, key, value = state["notes" if action == "note" else "marks"], item, text if action != "shelf_clear" else None
    if key is not None and seq >= slot.get(key, [-1])[0]:
        slot[key] = [seq, value]


def forget(state: dict, watermark: int) -> None:
    """Let go of the numbers of toggles that can't come again."""
    for wish in state["wishes"].values():
        wish[2] = {seq: at for seq, at in wish[2].items() if at >= watermark}


def entries(state: dict) -> list[tuple]:
    """(kind, item, number, text, four scores) of everything that a user's state shows."""
    none = (None,) * len(DIMENSIONS)
    found = [("wishlist", item, last, None, *none) for item, (n, last, _) in state["wishes"].items() if n % 2]
    found += [("shelf", item, seq, text, *none) for item, (seq, text) in state["marks"].items() if text is not None]
    found += [("note", item, seq, text, *none) for item, (seq, text) in state["notes"].items()]
    for item, last in state["ratings"].items():
        reset = last.get("reset", [-1])[0]
        scores = [last[d][1] if d in last and last[d][0] > reset else None for d in DIMENSIONS]
        if any(s is not None for s in scores):
            found.append(("rating", item, reset, None, *scores))
    return found


def fold_user(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState, timed: bool = False) -> Iterator[pd.DataFrame]:
    """The user's state after a batch's actions, and all its entries; one of kind `none` if there are none."""
    state = json.loads(held.get[0]) if held.exists else {"wishes": {}, "marks": {}, "ratings": {}, "notes": {}}
    watermark = held.getCurrentWatermarkMs() if timed else None
    for frame in frames:
        for row in zip(*(frame[c] for c in ("action", "item_id", "seq", "at", "text", "dimension", "score"))):
            action, item, seq, at, *rest = row
            take(state, action, str(item), int(seq), int(at), *rest, watermark)
    if timed:
        forget(state, watermark)
    held.update((json.dumps(state),))
    rows = [(key[0], kind, int(item), *rest) for kind, item, *rest in entries(state)] or [(key[0], "none", *[None] * 7)]
    frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ENTRIES.split(", ")], dtype=object)
    yield frame.astype({"user_id": "int64", "item_id": "Int64", "seq": "Int64"})


def user_entries(log: DataFrame, late: str | None = None) -> DataFrame:
    """ENTRIES of all users that a batch of the action log touches."""
    if late is not None:
        log = log.withWatermark("ts", late)
    rows = log.where(F.col("action").isin(*ACTIONS) & F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("seq").isNotNull())
    text = F.when(F.col("action") == "note", F.col("note")).otherwise(F.col("shelf_status")).alias("text")
    rows = rows.select("ts", "user_id", "action", "item_id", "seq", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"), text, "dimension", F.col("score").cast("string").alias("score"))
    return rows.groupBy("user_id").applyInPandasWithState(partial(fold_user, timed=late is not None), ENTRIES, "state string", "update", GroupStateTimeout.NoTimeout)


def documents(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, doc) of the users in these entries; a null document for those without any."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    wishlist, marks = of("wishlist").select("user_id", "item_id", "seq"), of("shelf").select("user_id", "item_id", F.col("text").alias("shelf_status"))
    notes = of("note").select("user_id", "item_id", F.col("text").alias("note"))
    own = of("rating").select("user_id", "item_id", *(F.col(d).cast("decimal(3,1)").alias(f"_{d}") for d in DIMENSIONS))
    ratings = own.join(scores.select("item_id", *DIMENSIONS), "item_id", "left").select("user_id", "item_id", *(F.coalesce(f"_{d}", d).alias(d) for d in DIMENSIONS))
    return rows.select("user_id").distinct().join(shelf.state_documents(wishlist, marks, ratings, notes), "user_id", "left")


def keep_documents(log: DataFrame, scores: DataFrame, path: str, progress: str, late: str | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the stream over what has arrived: documents go to `path`, its progress to `progress`.

    scores: (item_id, four scores) of the catalog as a table, read in every batch.
    """
    merge = merge_into(path, ["user_id"], buckets)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()  # the states are folded once
        merge(documents(rows, scores), number)
        rows.unpersist()

    return user_entries(log, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, doc): the newest document of each user."""
    found = snapshot(spark, path, DOCUMENT)
    return (spark.createDataFrame([], DOCUMENT) if found is None else found).where("doc IS NOT NULL")


def stream_documents(spark: SparkSession, events: DataFrame, scores: DataFrame) -> DataFrame:
    """(user_id, doc) after all events that have arrived."""
    path = new_folder(spark, "documents")
    keep_documents(actions(events), scores, path, new_folder(spark, "documents-progress")).awaitTermination()
    return read_documents(spark, path)
