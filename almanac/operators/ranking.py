"""Orders of the catalog.  Ties keep the catalog's own order; only the rows asked for are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from almanac.functions.columns import mean_score


def sort_keys(order: str) -> list[Column]:
    keys = {
        "recommend": [F.coalesce(F.col("featured"), F.lit(False)).desc(), F.col("release_date").desc_nulls_last()],
        "date-asc": [F.col("release_date").asc_nulls_last()],
        "date-desc": [F.col("release_date").desc_nulls_last()],
        "score": [mean_score().desc_nulls_last()],
    }
    return [*keys[order], F.col("ordinal").asc()]


def top(catalog: DataFrame, order: str = "recommend", k: int = 20) -> DataFrame:
    """The first k items in an order, with their rank."""
    return ranked(catalog, sort_keys(order), k)


def ranked(rows: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """k rows by keys, numbered from 1; the numbering sees these k rows alone."""
    return rows.orderBy(*keys).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))


def latest_signals(feed: DataFrame, k: int = 4) -> DataFrame:
    """The newest k announcements with their display index."""
    keys = [F.col("published_on").desc(), F.col("seq").desc()]
    return ranked(feed, keys, k).withColumn("display_index", F.concat(F.lit("0"), F.col("rank").cast("string")))
