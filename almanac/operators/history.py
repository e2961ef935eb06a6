"""Release dates as the newest official statement has them, and how they came about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.sources.schemas import OFFICIAL_KINDS
from almanac.sources.tables import SNAPSHOT, status_of


def official(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("kind").isin(*OFFICIAL_KINDS))


def unverified(feed: DataFrame) -> DataFrame:
    """Statements that never set a date."""
    return feed.where(~F.coalesce(F.col("kind").isin(*OFFICIAL_KINDS), F.lit(False)))


def current_dates(feed: DataFrame) -> DataFrame:
    """(item_id, new_date, kind, published_on, seq): the newest official statement on each item."""
    last = F.max_by(F.struct("new_date", "kind", "published_on", "seq"), "seq").alias("s")
    return official(feed).groupBy("item_id").agg(last).select("item_id", "s.*")


def date_history(feed: DataFrame) -> DataFrame:
    """Every official statement with the date before it, the change in days and its direction."""
    by_item = Window.partitionBy("item_id").orderBy("seq")
    rows = official(feed).select("item_id", "seq", "published_on", "kind", "new_date").withColumn("old_date", F.lag("new_date").over(by_item)).withColumn("revision", F.row_number().over(by_item).cast("bigint"))
    days = F.datediff("new_date", "old_date")
    return rows.withColumn("days_moved", days).withColumn("direction", direction(F.col("revision"), days))


def direction(revision: Column, days: Column) -> Column:
    """What a statement does to the date before it."""
    return F.when(revision == 1, "first").when(days < 0, "earlier").when(days > 0, "delayed").when(days == 0, "unchanged").otherwise("unknown")


def derived_status(items: DataFrame, dates: DataFrame, snapshot: str = SNAPSHOT) -> DataFrame:
    """(item_id, official_date, status): an item without an official date stays in development."""
    joined = items.select("item_id").join(dates.select("item_id", F.col("new_date").alias("official_date")), "item_id", "left")
    return joined.withColumn("status", status_of(F.col("official_date"), snapshot))
