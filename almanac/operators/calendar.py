"""The release calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.columns import label, labels_joined
from almanac.sources.schemas import PLATFORM_LABELS, STATUS_LABELS


def calendar_rows(catalog: DataFrame) -> DataFrame:
    """Dated items with their month; a reader orders them by release_date and ordinal."""
    dated = catalog.where(F.col("release_date").isNotNull())
    return dated.select(F.date_format("release_date", "yyyy-MM").alias("release_month"), F.date_format("release_date", "dd").alias("day"), "release_date", "ordinal", "item_id", "title", "original_title", label("status", STATUS_LABELS).alias("status_label"), labels_joined("platforms", PLATFORM_LABELS).alias("platform_labels"))


def undated(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("release_date").isNull())


def month_counts(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.col("release_date").isNotNull()).groupBy(F.date_format("release_date", "yyyy-MM").alias("release_month")).agg(F.count("*").alias("n"))


def dated_counts(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("release_date").alias("dated"), F.count_if(F.col("release_date").isNull()).alias("undated"))
