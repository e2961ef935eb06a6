"""Counts by status, month and dated or not, kept current by signed changes.

A statement that moves an item's date takes one from what the item counted under and
adds one to what it counts under now.  A batch reads the dates in its own items'
buckets, the ids of the catalog for a semi join, and the totals; nothing is recounted.
What an item counts under is decided by its newest official statement, so older ones
that come later, and repeated ones, change nothing; dates and totals are written under
the batch's number and computed from versions before it, so a batch that runs again
writes the same.

Defined results: every item begins without a date; a statement on an unknown item or
without a number is left out, one without a date leaves the item in development.  A
value that counts nothing has no row; `all` counts all items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from almanac.operators import history
from almanac.sources.storage import new_folder
from almanac.sources.tables import SNAPSHOT, announcements, status_of
from almanac.streaming.folds import BUCKETS, merge_into, raw_events, snapshot, touched_buckets

DATES = StructType([StructField("item_id", LongType()), StructField("seq", LongType()), StructField("new_date", DateType())])
TOTALS = StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("n", LongType())])


def counted_under(date: Column, day: str = SNAPSHOT) -> Column:
    """(kind, value) of everything that an item with this date counts under, besides `all`."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    month = F.when(date.isNotNull(), F.array(one("month", F.date_format(date, "yyyy-MM")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    return F.concat(F.array(one("status", status_of(date, day)), one("dated", F.when(date.isNull(), "undated").otherwise("dated"))), month)


def changes(new: DataFrame, old: DataFrame, day: str = SNAPSHOT) -> DataFrame:
    """(kind, value, n): what newer statements (item_id, seq, new_date) add to and take from the counts."""
    before = old.select("item_id", F.col("new_date").alias("_old"))
    signed = new.join(before, "item_id", "left").select(F.explode(F.array(F.struct(F.lit(-1).alias("by"), counted_under(F.col("_old"), day).alias("under")), F.struct(F.lit(1).alias("by"), counted_under(F.col("new_date"), day).alias("under")))).alias("s"))
    each = signed.select("s.by", F.explode("s.under").alias("u")).select("u.kind", "u.value", "by")
    return each.groupBy("kind", "value").agg(F.sum("by").cast("long").alias("n")).where("n <> 0")


def begin(items: DataFrame, path: str) -> None:
    """Totals before the first statement: no item has a date.  Counts the items once, where nothing is written yet."""
    if snapshot(items.sparkSession, f"{path}/totals", TOTALS) is not None:
        return
    n = items.agg(F.count("*").alias("n"))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("status", "all"), ("status", "development"), ("dated", "undated")))))
    merge_into(f"{path}/totals", ["kind", "value"], 1)(n.select(rows.alias("r"), "n").select("r.*", "n"), -1)


def keep_counts(feed: DataFrame, items: DataFrame, path: str, progress: str, day: str = SNAPSHOT, buckets: int = BUCKETS) -> StreamingQuery:
    """Start the stream over what has arrived of a feed; items: (item_id) of the catalog."""
    begin(items, path)
    known = items.select("item_id")
    put_dates, put_totals = merge_into(f"{path}/dates", ["item_id"], buckets), merge_into(f"{path}/totals", ["kind", "value"], 1)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = history.official(batch).where("item_id IS NOT NULL AND seq IS NOT NULL").groupBy("item_id").agg(F.max_by("new_date", "seq").alias("new_date"), F.max("seq").alias("seq"))
        newest = newest.join(known, "item_id", "left_semi").select("item_id", "seq", "new_date").persist()
        dates = snapshot(spark, f"{path}/dates", DATES, before=number, buckets=touched_buckets(newest, ["item_id"], buckets))
        totals = snapshot(spark, f"{path}/totals", TOTALS, before=number)
        dates = spark.createDataFrame([], DATES) if dates is None else dates
        moved = newest.join(dates.select("item_id", F.col("seq").alias("_seq")), "item_id", "left").where("_seq IS NULL OR seq > _seq").drop("_seq").persist()
        by = changes(moved, dates, day).select("kind", "value", F.col("n").alias("_by"))
        put_totals(by.join(totals, ["kind", "value"], "left").select("kind", "value", (F.coalesce("n", F.lit(0)) + F.col("_by")).alias("n")), number)
        put_dates(moved, number)
        moved.unpersist()
        newest.unpersist()

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value, n) as they stand."""
    return snapshot(spark, f"{path}/totals", TOTALS).where("n <> 0 OR value = 'all'")


def stream_counts(spark: SparkSession, path: str, orders: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, value, n) after all announcements of the events at a path."""
    kept = new_folder(spark, "counts")
    keep_counts(announcements(raw_events(spark, path), orders), items, kept, new_folder(spark, "counts-progress")).awaitTermination()
    return read_counts(spark, kept)
