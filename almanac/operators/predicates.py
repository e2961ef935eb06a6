"""Faceted filters.  A value of None, "all" or a blank adds no predicate at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.columns import contains_keyword, keyword, mean_score

SEARCHED = ("title", "original_title", "developer", "publisher", "country")


def predicates(status: str | None = None, platform: str | None = None, region: str | None = None, query: str | None = None) -> list[Column]:
    found = []
    if status not in (None, "", "all"):
        found.append(F.col("status") == status)
    if platform not in (None, "", "all"):
        found.append(F.coalesce(F.array_contains("platforms", platform), F.lit(False)))
    if region not in (None, "", "all"):
        found.append(F.col("region") == region)
    if query and keyword(query):
        found.append(contains_keyword(query, *SEARCHED, arrays=("genres",)))
    return found


def select_items(catalog: DataFrame, **filters) -> DataFrame:
    """The items that meet all filters."""
    for predicate in predicates(**filters):
        catalog = catalog.where(predicate)
    return catalog


def in_ranges(catalog: DataFrame, since: str | None = None, until: str | None = None, least_score: float | None = None) -> DataFrame:
    """Items by release date and mean score; an open end adds no predicate."""
    if since is not None:
        catalog = catalog.where(F.col("release_date") >= F.lit(since).cast("date"))
    if until is not None:
        catalog = catalog.where(F.col("release_date") <= F.lit(until).cast("date"))
    if least_score is not None:
        catalog = catalog.where(mean_score() >= F.lit(str(least_score)).cast("decimal(5,3)"))
    return catalog


def result_counts(catalog: DataFrame, **filters) -> DataFrame:
    """Items shown under the filters, and all items, in one pass."""
    shown = F.lit(True)
    for predicate in predicates(**filters):
        shown = shown & predicate
    return catalog.agg(F.count_if(shown).alias("shown"), F.count("*").alias("total"))


def facet_counts(catalog: DataFrame, facet: str = "status") -> DataFrame:
    """Items by value of the facet and an `all` row, whatever the filters are."""
    counts = catalog.rollup(facet).agg(F.grouping(facet).alias("_all"), F.count("*").alias("n"))
    return counts.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(facet)).alias(facet), "n")


def lookup_or_first(catalog: DataFrame, item_id) -> DataFrame:
    """The item with this id; without one, the first item of the catalog."""
    return catalog.orderBy((F.col("item_id") == F.lit(item_id)).desc_nulls_last(), "ordinal").limit(1)
