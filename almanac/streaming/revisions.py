"""Revisions of release dates as validity intervals, whatever order they arrive in.

A row is an official statement with the date before it and the days from which and up
to which it was the newest one.  A statement that arrives late is put between its
neighbours: the one before it ends earlier, the one after it has another date before it.
A batch rewrites the rows of its own items alone, in the buckets that hold them.

An item's statements are ordered by their numbers.  A statement holds from the day it
was published up to the first day on which one with a greater number was: where these
days run against the numbers it may never have held.  So exactly one statement holds
on any day from an item's first on.

Defined results: a repeated statement counts once; one without an item or a number is
left out, one without a day of publication never holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from almanac.operators import history
from almanac.sources.storage import new_folder
from almanac.sources.tables import announcements
from almanac.streaming.folds import BUCKETS, merge_into, raw_events, snapshot, touched_buckets

STATED = ("item_id", "seq", "kind", "published_on", "new_date")
INTERVALS = StructType([
    StructField("item_id", LongType()), StructField("seq", LongType()), StructField("kind", StringType()), StructField("published_on", DateType()), StructField("new_date", DateType()),
    StructField("revision", LongType()), StructField("old_date", DateType()), StructField("valid_to", DateType()),
])


def intervals(stated: DataFrame) -> DataFrame:
    """INTERVALS of whole items' statements (STATED); `published_on` is also the first day."""
    by_item = Window.partitionBy("item_id").orderBy("seq")
    after = by_item.rowsBetween(1, Window.unboundedFollowing)
    rows = stated.dropDuplicates(["item_id", "seq"])
    return rows.select(*STATED, F.row_number().over(by_item).cast("long").alias("revision"), F.lag("new_date").over(by_item).alias("old_date"), F.min("published_on").over(after).alias("valid_to"))


def keep_revisions(feed: DataFrame, path: str, progress: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the stream over what has arrived of a feed of announcements."""
    merge = merge_into(path, ["item_id"], buckets)

    def write(batch: DataFrame, number: int) -> None:
        arrived = history.official(batch).where("item_id IS NOT NULL AND seq IS NOT NULL").select(*STATED).persist()
        before = snapshot(batch.sparkSession, path, INTERVALS, before=number, buckets=touched_buckets(arrived, ["item_id"], buckets))
        rows = arrived
        if before is not None:
            rows = rows.unionByName(before.select(*STATED).join(arrived.select("item_id").distinct(), "item_id", "left_semi"))
        merge(intervals(rows), number)
        arrived.unpersist()

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    """INTERVALS as they stand."""
    found = snapshot(spark, path, INTERVALS)
    return spark.createDataFrame([], INTERVALS) if found is None else found


def date_history(rows: DataFrame) -> DataFrame:
    """The change record, as `history.date_history` has it, without a sort."""
    days = F.datediff("new_date", "old_date")
    return rows.withColumn("days_moved", days).withColumn("direction", history.direction(F.col("revision"), days))


def as_of(rows: DataFrame, day: str) -> DataFrame:
    """(item_id, new_date, kind, published_on, seq): what was known of each item at the end of a day."""
    at = F.lit(day).cast("date")
    return rows.where((F.col("published_on") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("item_id", "new_date", "kind", "published_on", "seq")


def stream_revisions(spark: SparkSession, path: str, orders: DataFrame) -> DataFrame:
    """INTERVALS after all announcements of the events at a path."""
    kept = new_folder(spark, "revisions")
    keep_revisions(announcements(raw_events(spark, path), orders), kept, new_folder(spark, "revisions-progress")).awaitTermination()
    return read_revisions(spark, kept)
